"""Exact quantiles of any number of distinct values, by rank selection in rounds of histograms.

`percentile` holds all distinct values of a group in one buffer. Here each round counts the values of a group's
interval in BINS bins, with partial sums in the scan stage, and keeps the bin that holds the wanted rank. When few
values are left, they are sorted. A group's state is one row, and no buffer holds more than BINS or LEFT values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecube.session import kept

BINS = 1024
#: So many distinct values of a group are sorted at once.
LEFT = 4096


def exact_quantile(table: DataFrame, group: list[str], value: str, share: float = 0.5, weight: str | None = None) -> DataFrame:
    """(group, quantile, n): the interpolated quantile (as `percentile` has it) and the number of values, nulls left out.

    `weight` is a column of whole counts. The values are written once and read once or twice a round.
    """
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    rows = table.select(*group, F.col(value).cast("double").alias("v"), w.alias("w")).filter("v IS NOT NULL AND w > 0")
    rows = kept(rows.groupBy(*group, "v").agg(F.sum("w").alias("w")), "values")
    ends = rows.groupBy(*group).agg(F.sum("w").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("held"))
    place = F.lit(share) * (F.col("n") - 1)
    ends = ends.select(*group, "n", "low", "high", "held", F.floor(place).alias("k"), (place - F.floor(place)).alias("part"))
    # Two ranks a group, the one below and the one above the wanted place: each is a search of its own.
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("k").alias("rank")), F.struct(F.lit(1).alias("side"), F.least(F.col("k") + 1, F.col("n") - 1).alias("rank"))))
    state = kept(ends.select(*group, "n", "part", "low", "high", "held", ranks.alias("r")).select(*group, "n", "part", "low", "high", "held", "r.*"), "ranks")
    same = [F.col(f"t.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]

    def inside(open_: DataFrame) -> DataFrame:
        joined = rows.alias("t").join(open_.alias("s"), [*same, F.col("t.v").between(F.col("s.low"), F.col("s.high"))])
        return joined.select(*[F.col(f"s.{g}").alias(g) for g in group], "s.n", "s.part", "s.side", "s.rank", "s.low", "s.high", "t.v", "t.w")

    keys = [*group, "n", "part", "side", "rank"]
    while not (wide := state.filter((F.col("held") > LEFT) & (F.col("low") < F.col("high")))).isEmpty():
        # Halves keep the width finite; a value's bin grows with the value, rounding or not.
        at = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS)
        counts = inside(wide).groupBy(*keys, F.least(at, F.lit(BINS - 1)).alias("bin")).agg(F.sum("w").alias("w"), F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("held"))
        before = F.coalesce(F.sum("w").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("w")))
        found = found.select(*group, "n", "part", "low", "high", "held", "side", (F.col("rank") - F.col("before")).alias("rank"))
        state = kept(found.unionByName(state.filter((F.col("held") <= LEFT) | (F.col("low") >= F.col("high")))), "ranks")
    before = F.coalesce(F.sum("w").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = inside(state).withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("w")))
    low, high = (F.max(F.when(F.col("side") == side, F.col("v"))) for side in (0, 1))
    out = last.groupBy(*group, "n", "part").agg(low.alias("a"), high.alias("b"))
    return out.select(*group, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"), "n")
