"""Crude, age-specific and directly standardised rates from merged cells.

All functions take the output of `merge_cells`: one row per key combination with
``n`` (null: no events) and ``pop`` (null: no exposure, NaN: unknown).

`anchor` says which side decides the cells that exist:

* ``"events"``: cells with events. Ages without events are not part of the
  group, so its population, and the crude rate from it, leave them out; a cell
  without population makes the whole standardised rate null.
* ``"exposure"``: cells with population. No events count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.functions import codes
from ratecube.functions.measures import known, or_unknown, ratio
from ratecube.functions.recodes import label_of

AGE = "age_group"


def check_weights(weights: list[tuple[str, float]]) -> None:
    total = sum(weight for _, weight in weights)
    if abs(total - 1) >= 1e-6:
        raise ValueError(f"standard weights add up to {total}, not to 1")


def anchored(cells: DataFrame, anchor: str = "exposure") -> DataFrame:
    if anchor == "events":
        return cells.filter(F.col("n").isNotNull())
    if anchor == "exposure":
        return cells.filter(F.col("pop").isNotNull()).withColumn(
            "n", F.coalesce("n", F.lit(0).cast("long"))
        )
    raise ValueError(f"anchor must be 'events' or 'exposure', not {anchor!r}")


def with_rate(cells: DataFrame, name: str = "rate", per: float = codes.PER_100K) -> DataFrame:
    """Rate of every cell: n / pop * per, null without population."""
    return cells.withColumn("pop", known(F.col("pop"))).withColumn(
        name, ratio(F.col("n"), F.col("pop"), per)
    )


def crude_rate(
    cells: DataFrame, keys: list[str], anchor: str = "events", per: float = codes.PER_100K
) -> DataFrame:
    """(keys, n, pop, rate) over everything in the cells, ages unknown included."""
    summed = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("pop").alias("pop"))
    return with_rate(anchored(summed, anchor), per=per)


def known_age(cells: DataFrame, age: str = AGE) -> DataFrame:
    return cells.filter(F.col(age) != codes.AGE_UNKNOWN)


def age_specific_rate(
    cells: DataFrame,
    anchor: str = "events",
    weights: list[tuple[str, float]] = codes.STANDARD_WEIGHTS,
    per: float = codes.PER_100K,
    age: str = AGE,
) -> DataFrame:
    """Every age cell with its rate, standard weight and weighted rate."""
    check_weights(weights)
    rated = with_rate(anchored(known_age(cells, age), anchor), "rate", per)
    return rated.withColumn("weight", F.expr(label_of(age, weights))).withColumn(
        "weighted_rate", F.col("rate") * F.col("weight")
    )


def _weighted_rate(weights: list[tuple[str, float]], per: float, age: str) -> Column:
    return ratio(F.col("n"), F.col("pop"), per) * F.expr(label_of(age, weights))


def _has_age(age: str) -> Column:
    return F.col(age).isNotNull() & (F.col(age) != codes.AGE_UNKNOWN)


def standardise(
    cells: DataFrame,
    keys: list[str],
    anchor: str = "exposure",
    weights: list[tuple[str, float]] = codes.STANDARD_WEIGHTS,
    per: float = codes.PER_100K,
    age: str = AGE,
    whole_pop: str | None = None,
) -> DataFrame:
    """(keys, n, pop, crude_rate, age_adjusted_rate) over the cells of known age.

    Ages are tested inside the sums: as a filter the test would move below the
    cells and be evaluated for every record and person. `whole_pop` names one
    more column, the population of all ages (NaN if unknown), and keeps the
    groups that have nothing else.
    """
    check_weights(weights)
    if anchor == "events":
        used = _has_age(age) & F.col("n").isNotNull()
    elif anchor == "exposure":
        used = _has_age(age) & F.col("pop").isNotNull()
        cells = cells.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    else:
        raise ValueError(f"anchor must be 'events' or 'exposure', not {anchor!r}")
    weighted = _weighted_rate(weights, per, age)
    extra = [whole_pop] if whole_pop else []
    table = cells.groupBy(*keys).agg(
        F.sum(F.when(used, F.col("n"))).alias("n"),
        known(F.sum(F.when(used, or_unknown(F.col("pop"))))).alias("pop"),
        known(F.sum(F.when(used, or_unknown(weighted)))).alias("age_adjusted_rate"),
        *[F.sum("pop").alias(name) for name in extra],
    )
    if not extra:
        table = table.filter(F.col("n").isNotNull())
    return table.withColumn("crude_rate", ratio(F.col("n"), F.col("pop"), per)).select(
        *keys, "n", "pop", "crude_rate", "age_adjusted_rate", *extra
    )


def crude_and_adjusted(
    cells: DataFrame,
    keys: list[str],
    weights: list[tuple[str, float]] = codes.STANDARD_WEIGHTS,
    per: float = codes.PER_100K,
    age: str = AGE,
    groups_without_events: bool = False,
    whole_pop: str | None = None,
) -> DataFrame:
    """Crude rate over all ages next to the standardised rate over known ages.

    (keys, n, pop, crude_rate, age_adjusted_rate, n_known_age), events-anchored;
    one grouping serves both rates, each with the cells that its definition takes
    in. `n_known_age` is null where the standardised rate has no cell at all.
    `groups_without_events` keeps groups that have population only. `whole_pop`
    names one more column, the population with NaN where it is unknown, for sums
    over groups.
    """
    check_weights(weights)
    extra = [whole_pop] if whole_pop else []
    standard_cell = _has_age(age) & F.col("n").isNotNull()
    weighted = _weighted_rate(weights, per, age)
    rates = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        known(F.sum("pop")).alias("pop"),
        known(F.sum(F.when(standard_cell, or_unknown(weighted)))).alias("age_adjusted_rate"),
        F.sum(F.when(standard_cell, F.col("n"))).alias("n_known_age"),
        *[F.sum("pop").alias(name) for name in extra],
    )
    if not groups_without_events:
        rates = rates.filter(F.col("n").isNotNull())
    return (
        rates.withColumn("crude_rate", ratio(F.col("n"), F.col("pop"), per))
        .select(*keys, "n", "pop", "crude_rate", "age_adjusted_rate", "n_known_age", *extra)
    )


def suppress(
    table: DataFrame,
    columns: list[str],
    count: str = "n",
    min_count: int = codes.MIN_REPORTABLE,
    flag: str | None = None,
) -> DataFrame:
    """Blank `columns` in rows that rest on fewer than `min_count` events."""
    small = F.col(count) < min_count
    hidden = table.withColumns({name: F.when(~small, F.col(name)) for name in columns})
    return hidden.withColumn(flag, small) if flag else hidden
