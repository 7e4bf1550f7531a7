"""Labels from tables of any size: by code, and by range.

The code tables of the reports are literals. A table of labels that a user brings (occupations, places, fine
age bands) may have any number of rows; how it meets the records depends on its checked size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges whose bounds are sent to all workers, 16 bytes each; more are joined.
MOST_BOUNDS = 1 << 20


def label_by_code(table: DataFrame, key: str, labels: DataFrame, code: str, label: str) -> DataFrame:
    """`table` with column `label`, null for an unknown code. Spark broadcasts the labels if they are small enough.

    A code that stands twice among the labels would repeat rows, so it is an error when the query runs.
    """
    n = F.count(F.lit(1))
    message = F.concat(F.lit(f"{code} is not unique: "), F.col(code).cast("string"))
    once = labels.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("__code")).agg(F.when(n > 1, F.raise_error(F.max(message)).cast("string")).otherwise(F.min(label).cast("string")).alias("__label"))
    kind = dict(labels.dtypes)[label]
    return table.join(once, F.col(key) == F.col("__code"), "left").withColumn(label, F.col("__label").cast(kind)).drop("__code", "__label")


def label_by_range(table: DataFrame, value: str, ranges: DataFrame, low: str, high: str, label: str, most: int = MOST_BOUNDS) -> DataFrame:
    """`table` with column `label` of the range low <= value <= high, null where no range holds the value.

    Ranges must not overlap. Up to `most` of them, their sorted bounds go to the workers, and a value finds its
    range by binary search; the labels then meet by the range's number. More ranges are joined by bins of values
    instead (`joined_by_bins`), without a broadcast. Neither way compares each value with each range.
    """
    own = ranges.select(F.col(low).cast("double").alias("low"), F.col(high).cast("double").alias("high"), F.col(label).alias("label")).filter("low <= high")
    if own.count() > most:
        return joined_by_bins(table, value, own, label)
    rows = own.orderBy("low").collect()
    lows, highs = (np.array([r[k] for r in rows], np.float64) for k in ("low", "high"))
    if (lows[1:] <= highs[:-1]).any():
        raise ValueError(f"ranges of {low} and {high} overlap")
    bounds = table.sparkSession.sparkContext.broadcast((lows, highs))

    @F.arrow_udf("bigint")
    def number(values: pa.Array) -> pa.Array:
        lows, highs = bounds.value
        found = np.asarray(values.cast(pa.float64()).fill_null(float("nan")))
        if not len(lows):
            return pa.nulls(len(found), pa.int64())
        at = np.searchsorted(lows, found, "right") - 1
        inside = (at >= 0) & (found <= highs[np.maximum(at, 0)])
        return pa.array(np.where(inside, at, -1), mask=~inside)

    names = table.sparkSession.createDataFrame([(i, r["label"]) for i, r in enumerate(rows)], f"__range long, `{label}` {own.schema['label'].dataType.simpleString()}")
    return table.withColumn("__range", number(F.col(value).cast("double"))).join(names, "__range", "left").drop("__range")


def joined_by_bins(table: DataFrame, value: str, ranges: DataFrame, label: str) -> DataFrame:
    """Ranges (low, high, label) and values meet by bins about as wide as a range: each range has a row for each bin it reaches.

    A range far wider than the others would have a great many; so the width is the larger of the mean width and a
    millionth of the whole span, and bins of one range are bounded by a million.
    """
    span = ranges.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.avg(F.col("high") - F.col("low")).alias("mean")).first()
    width = max(span["mean"], (span["high"] - span["low"]) / 1e6) or 1.0
    bins = ranges.select(F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("__bin"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("label").alias(label))
    own = table.withColumn("__bin", F.floor(F.col(value).cast("double") / width))
    inside = F.col(value).cast("double").between(F.col("__low"), F.col("__high"))
    return own.alias("t").join(bins.alias("r"), (F.col("t.__bin") == F.col("r.__bin")) & inside, "left").select("t.*", F.col(f"r.{label}").alias(label)).drop("__bin")
