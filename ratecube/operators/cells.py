"""Cells: the small tables that every report is made of.

A record is a cell with ``n = 1``; a survey person is a cell with ``pop`` equal
to the weight. So each operator here takes records and already summed cells
alike, and a report may run off a stored cube instead of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.functions.measures import known, or_unknown


def as_events(records: DataFrame) -> DataFrame:
    """Records with a count of one each; a table that has counts stays as it is."""
    return records if "n" in records.columns else records.withColumn("n", F.lit(1).cast("long"))


def as_exposure(persons: DataFrame, weight: str = "perwt") -> DataFrame:
    """Persons with their weight as population; an unknown weight makes the sum unknown."""
    if "pop" in persons.columns:
        return persons
    return persons.withColumn("pop", or_unknown(F.col(weight)))


def count_events(events: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Events per key combination. Null is a group of its own."""
    return events.groupBy(*keys).agg(F.sum("n").alias(name))


def sum_exposure(exposure: DataFrame, keys: list[str], name: str = "pop") -> DataFrame:
    """Weighted population per key combination, null when a weight is unknown."""
    return exposure.groupBy(*keys).agg(known(F.sum("pop")).alias(name))


def merge_cells(events: DataFrame, exposure: DataFrame, keys: list[str]) -> DataFrame:
    """Events and population side by side: (keys, n, pop).

    The two tables are stacked and summed once, not joined: both partial sums run
    in the scan stages and meet in one shuffle of cells, a hot key is reduced
    before that shuffle, and null keys meet as equals. ``n`` is null where there
    are no events, ``pop`` where there is no exposure, NaN where it is unknown.
    """
    no_pop, no_n = F.lit(None).cast("double"), F.lit(None).cast("long")
    stacked = events.select(*keys, "n", no_pop.alias("pop")).unionByName(
        exposure.select(*keys, no_n.alias("n"), "pop")
    )
    return stacked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pop").alias("pop"))


def with_subtotal(cells: DataFrame, keys: list[str], over: str, label: str) -> DataFrame:
    """Cells by `keys`, and their sum over the key `over` as one more value `label`.

    Null groups of `over` stay null and count towards the subtotal.
    """
    return stack_groupings(
        cells,
        [keys, [key for key in keys if key != over]],
        keys,
        {over: F.when(F.grouping(over) == 1, F.lit(label)).otherwise(F.col(over))},
    )


def stack_groupings(
    cells: DataFrame,
    groupings: list[list[str]],
    keys: list[str],
    replace: dict[str, Column] | None = None,
) -> DataFrame:
    """Several groupings of the same cells as one table, in one pass.

    A key that a grouping leaves out is null in its rows; `replace` gives key
    columns that depend on ``grouping(key)``.
    """
    replace = replace or {}
    measures = [name for name in ("n", "pop") if name in cells.columns]
    labels = [column.alias(f"{name}__label") for name, column in replace.items()]
    summed = cells.groupingSets([[F.col(k) for k in g] for g in groupings], *[F.col(k) for k in keys]).agg(
        *[F.sum(name).alias(name) for name in measures], *labels
    )
    return summed.select(
        *[F.col(f"{key}__label").alias(key) if key in replace else F.col(key) for key in keys],
        *measures,
    )
