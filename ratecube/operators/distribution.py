"""Mean, median and kernel density of a whole-number value such as age.

Everything here works off the histogram (value -> count). It has as many rows as
there are distinct values, 1,000 for a three-digit age, whatever the number of
records, and gives exact results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecube.operators.panel import evenly_spaced
from ratecube.operators.shares import with_group_total

# Fixed values of the default density estimate: grid size and bandwidth rule
# 0.9 * min(sd, IQR / 1.34) * n^(-1/5).
GRID_POINTS = 512
BANDWIDTH_FACTOR = 0.9
IQR_PER_SD = 1.34


def histogram(events: DataFrame, group: list[str], value: str) -> DataFrame:
    return events.groupBy(*group, value).agg(F.sum("n").alias("n"))


def mean_and_median(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, mean, median, n). Rows without a value count in n only."""
    present = F.when(F.col(value).isNotNull(), F.col("n"))
    return counts.groupBy(*group).agg(
        (F.sum(F.col(value) * F.col("n")) / F.sum(present)).alias("mean"),
        F.percentile(value, 0.5, F.col("n")).alias("median"),
        F.sum("n").alias("n"),
    )


def _shapes(present: DataFrame, group: list[str]) -> DataFrame:
    """(group, shape): number of values and bandwidth of each group."""
    mean = F.sum(F.col("at") * F.col("n")) / F.sum("n")
    square = F.sum(F.col("at") * F.col("at") * F.col("n"))
    shape = present.groupBy(*group).agg(
        F.sum("n").alias("total"),
        F.sqrt(
            F.try_divide(F.greatest(square - F.sum("n") * mean * mean, F.lit(0.0)), F.sum("n") - 1)
        ).alias("sd"),
        F.min("at").alias("least"),
        F.percentile("at", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("quartiles"),
    )
    robust = (F.col("quartiles")[1] - F.col("quartiles")[0]) / F.lit(IQR_PER_SD)
    spread = (
        F.when(robust > 0, F.least("sd", robust))
        .when(F.col("sd") > 0, F.col("sd"))
        .when(F.col("least") != 0, F.abs("least"))
        .otherwise(F.lit(1.0))
    )
    width = F.lit(BANDWIDTH_FACTOR) * spread * F.pow(F.col("total"), F.lit(-0.2))
    return shape.select(*group, F.struct("total", width.alias("bandwidth")).alias("shape"))


def _bars_and_limits(counts: DataFrame, group: list[str], value: str) -> tuple[DataFrame, Column]:
    """(group, at, n, shape: total and bandwidth) of each bar, and the smallest and largest value of all groups."""
    present = counts.filter(F.col(value).isNotNull()).select(
        *group, F.col(value).cast("double").alias("at"), "n"
    )
    limits = present.agg(F.struct(F.min("at").alias("low"), F.max("at").alias("high"))).scalar()
    return with_group_total(present, _shapes(present, group), group, "shape"), limits


def density(
    counts: DataFrame, group: list[str], value: str, points: int = GRID_POINTS
) -> DataFrame:
    """(group, x, density): Gaussian kernel estimate per group.

    The grid runs from the smallest to the largest value of all groups. Each bar of
    the histogram becomes a row for each grid point, and points sum their rows;
    sums begin where the bars are, so no group is gathered in one row.
    """
    bars, limits = _bars_and_limits(counts, group, value)
    bars = bars.withColumn("limits", limits)
    points_of = bars.select(
        *group, "at", "n", "shape.total", "shape.bandwidth",
        F.posexplode(evenly_spaced(F.col("limits.low"), F.col("limits.high"), points)).alias("point", "x"),
    )
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("at")) / F.col("bandwidth"), F.lit(2.0)))
    scale = F.col("total") * F.col("bandwidth") * F.lit(math.sqrt(2 * math.pi))
    summed = points_of.groupBy(*group, "point").agg(
        F.first("x").alias("x"), F.sum(F.col("n") * kernel / scale).alias("density")
    )
    return summed.select(*group, "x", "density")


def binned_density(
    counts: DataFrame, group: list[str], value: str, points: int = GRID_POINTS
) -> DataFrame:
    """(group, x, density) as `density` has it, to within the binning, for any number of bars.

    Each bar is shared out between the two grid points around it, so there are two rows for each bar instead of
    `points`; their partial sums leave at most `points` rows of a group, which one Fourier convolution with the
    kernel turns into the estimate.
    """
    bars, limits = _bars_and_limits(counts, group, value)
    low, step = F.col("limits.low"), (F.col("limits.high") - F.col("limits.low")) / F.lit(float(points - 1))
    place = F.when(step > 0, (F.col("at") - low) / step).otherwise(F.lit(0.0))
    left = F.least(F.floor(place), F.lit(points - 2)).cast("int")
    part = place - left
    shares = F.array(
        F.struct(left.alias("point"), (F.col("n") * (1 - part)).alias("share")),
        F.struct((left + 1).alias("point"), (F.col("n") * part).alias("share")),
    )
    cells = bars.withColumn("limits", limits).select(
        *group, "shape.total", "shape.bandwidth", low.alias("low"), step.alias("step"), F.inline(shares)
    )
    sums = cells.groupBy(*group, "total", "bandwidth", "low", "step", "point").agg(F.sum("share").alias("share"))
    kinds = ", ".join(f"`{g}` {dict(counts.dtypes)[g]}" for g in group)

    def convolved(table: pd.DataFrame) -> pd.DataFrame:
        first = table.iloc[0]
        weights = np.zeros(points)
        weights[table["point"].to_numpy()] = table["share"].to_numpy()
        apart = np.arange(points) * first["step"] / first["bandwidth"]
        kernel = np.exp(-0.5 * apart**2) / (first["total"] * first["bandwidth"] * math.sqrt(2 * math.pi))
        # The kernel of both directions on a circle that is wide enough for both ends.
        circle = np.concatenate((kernel, [0.0], kernel[:0:-1]))
        found = np.fft.irfft(np.fft.rfft(weights, len(circle)) * np.fft.rfft(circle), len(circle))[:points]
        out = pd.DataFrame({"x": first["low"] + first["step"] * np.arange(points), "density": np.maximum(found, 0.0)})
        for g in reversed(group):
            out.insert(0, g, [first[g]] * points)
        return out

    return sums.groupBy(*group).applyInPandas(convolved, f"{kinds}, x double, density double")
