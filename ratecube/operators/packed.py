"""Fields that pack several fixed-width codes into one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.functions import codes
from ratecube.functions.measures import percent
from ratecube.operators.shares import with_group_total

BLANKS = " \t\r\n"


def pieces(packed: str, width: int = codes.CODE_WIDTH) -> Column:
    """All slots of a field in order, untrimmed; none for a null field.

    One pass over the string cuts every slot, however many there are; cutting
    them one by one would walk a long string from its start for each slot.
    """
    cut = F.regexp_extract_all(F.col(packed), F.lit("(?s).{1,%d}" % width), F.lit(0))
    return F.coalesce(cut, F.array().cast("array<string>"))


def _trimmed(piece: Column) -> Column:
    return F.btrim(piece, F.lit(BLANKS))


def unpack_codes(
    records: DataFrame, packed: str, keep: list[str], width: int = codes.CODE_WIDTH
) -> DataFrame:
    """Long form: (keep, condition_slot, condition_code), slots counted from 1, blanks dropped."""
    long = records.select(*keep, F.posexplode(pieces(packed, width)).alias("slot", "piece"))
    return long.select(
        *keep,
        (F.col("slot") + 1).alias("condition_slot"),
        _trimmed(F.col("piece")).alias("condition_code"),
    ).filter(F.col("condition_code") != "")


def _code_counts(
    records: DataFrame, packed: str, group: list[str], width: int, once_per_record: bool
) -> DataFrame:
    """(group, condition_code, n, is_total): counts per code, and the number of
    records under the null code, both from one pass.

    Each record adds one null to its slots, which are exploded before they are
    trimmed, so that trimming is compiled code. `is_total` is an aggregate, not a
    test on the key, so that filtering on it stays above the shuffle, and codes
    and totals read the same shuffle.
    """
    slots = pieces(packed, width)
    if once_per_record:
        slots = F.array_distinct(F.transform(slots, _trimmed))
    marked = F.array_append(slots, F.lit(None).cast("string"))
    long = records.select(*group, F.explode(marked).alias("piece"))
    return (
        long.select(*group, _trimmed(F.col("piece")).alias("condition_code"))
        .filter(F.col("condition_code").isNull() | (F.col("condition_code") != ""))
        .groupBy(*group, "condition_code")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("condition_code").isNull()).alias("is_total"))
    )


def _against_total(counts: DataFrame, group: list[str], total: str, pct: str) -> DataFrame:
    totals = counts.groupBy(*group).agg(F.max(F.when(F.col("is_total"), F.col("n"))).alias(total))
    return (
        with_group_total(counts, totals, group, total)
        .filter(~F.col("is_total"))
        .select(*group, "condition_code", "n", total, percent(F.col("n"), F.col(total)).alias(pct))
    )


def code_frequency(
    records: DataFrame, packed: str, width: int = codes.CODE_WIDTH
) -> DataFrame:
    """Mentions of each code, as a percentage of records (may exceed 100)."""
    counts = _code_counts(records, packed, [], width, once_per_record=False)
    return _against_total(counts, [], "total_records", "pct_of_records")


def code_prevalence(
    records: DataFrame, packed: str, group: list[str], width: int = codes.CODE_WIDTH
) -> DataFrame:
    """Records that carry each code at least once, as a percentage of their group."""
    counts = _code_counts(records, packed, group, width, once_per_record=True)
    return _against_total(counts, group, "total_records", "pct_of_group")
