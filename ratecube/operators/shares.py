"""Shares, distributions, top-k and changes over time.

Group totals are aggregated and joined back rather than taken with an unordered
window: a window would bring every category of a group into one task, and the
number of categories may grow with the data. The totals come off the same
shuffle as the cells, so the input is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecube.functions.measures import percent, percent_change
from ratecube.operators.cells import count_events

#: Parts of a group when it meets its total.
GROUP_PARTS = 32
#: Parts of a group in the first round of `top_k`.
TOP_K_PARTS = 64


def with_group_total(
    table: DataFrame, totals: DataFrame, group: list[str], total: str
) -> DataFrame:
    """`table` with the column `total` of its group; null groups match each other.

    Without group keys the total is one number, read as a scalar subquery. The
    table's rows meet their totals by the group and a part of the rest of the row;
    each total is there once for each part. So a group of any size is spread over
    GROUP_PARTS tasks when the planner can't broadcast the totals.
    """
    if not group:
        return table.withColumn(total, totals.select(total).scalar())
    named = {key: f"{key}__group" for key in group}
    same = [F.col(key).eqNullSafe(F.col(other)) for key, other in named.items()]
    rest = [c for c in table.columns if c not in group]
    dealt = table.withColumn("group__part", F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(GROUP_PARTS)))
    spread = totals.select(*group, total, F.explode(F.sequence(F.lit(0), F.lit(GROUP_PARTS - 1))).alias("total__part"))
    joined = dealt.join(
        spread.withColumnsRenamed(named), [*same, F.col("group__part") == F.col("total__part")], "left"
    )
    return joined.select(*table.columns, total)


def share_within(
    cells: DataFrame,
    group: list[str],
    value: str = "n",
    name: str = "pct",
    shown: DataFrame | None = None,
) -> DataFrame:
    """Percent of each row in its group. Null groups take their own total.

    `shown` are the rows to report, when they are fewer than the `cells` that the
    totals are taken over.
    """
    total = f"{value}__total"
    totals = cells.groupBy(*group).agg(F.sum(value).alias(total))
    rows = cells if shown is None else shown
    joined = with_group_total(rows, totals, group, total)
    return joined.select(*rows.columns, percent(F.col(value), F.col(total)).alias(name))


def distribution(
    events: DataFrame, group: list[str], category: list[str], name: str = "pct"
) -> DataFrame:
    """(group, category, n, pct): how the events of each group spread over categories."""
    return share_within(count_events(events, [*group, *category]), group, "n", name)


def top_k(cells: DataFrame, group: list[str], k: int, value: str = "n") -> DataFrame:
    """The k largest rows of each group, with all rows that tie for the last place.

    The k-th largest value of each group is found first: the hash of a row deals its
    group into parts, of which each keeps k rows, and the k-th of those is the k-th
    of all. For small k each task already keeps only k rows of a part; for any k no
    task sorts more than a part of a group, or k rows of each part. Then every row
    that reaches the value is kept. So ties, of which there may be any number, are
    never gathered in one task as a ranked window would do.
    """
    part = F.pmod(F.xxhash64(*[c for c in cells.columns if c not in group]), F.lit(TOP_K_PARTS))

    def largest(table: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
        return table.withColumn("place", place).filter(F.col("place") <= k).drop("place")

    leaders = largest(cells.select(*group, value, part.alias("part")), [*group, "part"])
    least = largest(leaders, group).groupBy(*group).agg(F.min(value).alias("least"))
    reached = with_group_total(cells, least, group, "least").filter(F.col(value) >= F.col("least"))
    return reached.select(*cells.columns)


def sort_keys(order: list[str]) -> list[Column]:
    """Sort columns from names; a leading "-" sorts downwards. Nulls come last."""
    return [
        F.desc_nulls_last(name[1:]) if name.startswith("-") else F.asc_nulls_last(name)
        for name in order
    ]


def first_rows(table: DataFrame, order: list[str], k: int) -> DataFrame:
    """The first k rows by `order` (see `sort_keys`): each task keeps its own k."""
    return table.orderBy(*sort_keys(order)).limit(k)


def part_of_all(events: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """(keys, total, part, pct): events that meet a condition, out of all events."""
    return (
        events.groupBy(*keys)
        .agg(
            F.sum("n").alias("total"),
            F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("long"))).alias("part"),
        )
        .withColumn("pct", percent(F.col("part"), F.col("total")))
    )


def first_to_last(
    table: DataFrame, keys: list[str], year: str, value: str, first: int, last: int
) -> DataFrame:
    """(keys, value_first, value_last, pct_change) between two years."""
    picked = [
        F.max(F.when(F.col(year) == each, F.col(value))).alias(name)
        for each, name in ((first, "value_first"), (last, "value_last"))
    ]
    return (
        table.filter(F.col(year).isin(first, last))
        .groupBy(*keys)
        .agg(*picked)
        .withColumn("pct_change", percent_change(F.col("value_first"), F.col("value_last")))
    )


def widen(
    table: DataFrame,
    keys: list[str],
    name: str,
    names: list[str],
    value_prefix: dict[str, str],
) -> DataFrame:
    """Long to wide over a given list of names: one column per (value, name).

    `value_prefix` maps each value column to the prefix of its new columns. The
    names are given, so this is one aggregation without a pass to find them.
    """
    wide = [
        F.max(F.when(F.col(name) == each, F.col(value))).alias(f"{prefix}{each}")
        for each in names
        for value, prefix in value_prefix.items()
    ]
    return table.groupBy(*keys).agg(*wide)
