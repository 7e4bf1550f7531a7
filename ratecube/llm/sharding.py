"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts kept together.

Groups are equal texts. A group that holds more than 1/(PARTS * shards) of the bytes, tokens or rows
is packed on its own; the others are packed in LIGHT_UNITS lots by hash. So the packing sees a number
of units that doesn't grow with the input. Only a group of more than 1/(SPLIT * shards) of a total is
split, by the hash of its ids, into parts of about that size. Units are placed from the largest down,
each on the shard where the dot product with the residual capacity is highest.

Defined cases: a null text has no bytes and is a group of its own; rows that repeat one id and text
stay together; an empty table gives an empty plan; a single text larger than a shard's share makes
that shard larger.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecube.llm.common import stored

SHARDS = 8
PARTS = 1024
LIGHT_UNITS = 4096
SPLIT = 4
#: Rows of one shard are numbered in lots of about so many.
SLOT_ROWS = 50_000
#: How far over the mean a shard may go while others can still take a unit.
SLACK = 0.002
SIZES = ("bytes", "tokens", "rows")


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unit; `sizes` has a row for each unit and a column for each dimension."""
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1) * shards  # 1: what a shard should hold
    residual = np.ones((shards, sizes.shape[1]))
    chosen = np.zeros(len(sizes), np.int64)
    for unit in np.argsort(-share.max(axis=1), kind="stable"):
        need = share[unit]
        fits = (residual + SLACK >= need).all(axis=1)
        if fits.any():
            shard = int(np.where(fits, residual @ need, -np.inf).argmax())
        else:
            shard = int(residual[:, 0].argmax())  # bytes come first where nothing fits
        chosen[unit] = shard
        residual[shard] -= need
    return chosen


def plan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): where each row goes, and its place there from 0."""
    spark = documents.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        documents.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.size(F.split(body, r"[\x20\x09-\x0D]+")).cast("bigint").alias("tokens"),
            F.coalesce(F.md5(F.encode(F.col(text), "UTF-8")), F.lit("null")).alias("text_group"),
        ),
        "sizes",
    )
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    groups = rows.groupBy("text_group").agg(*sums)
    share = F.greatest(*[F.col(s) / F.lit(float(max(1, total[s]))) for s in SIZES]) * shards
    # At most 3 * PARTS * shards groups are over 1 / (PARTS * shards) of one of three totals.
    heavy = groups.filter(share > 1 / PARTS).select("text_group", F.when(share > 1 / SPLIT, F.ceil(share * SPLIT)).otherwise(F.lit(1)).cast("bigint").alias("parts"))
    marked = rows.join(F.broadcast(heavy), "text_group", "left")
    unit = F.when(
        F.col("parts").isNull(), F.concat(F.lit("lot "), F.pmod(F.xxhash64("text_group"), F.lit(LIGHT_UNITS)).cast("string"))
    ).otherwise(F.concat_ws(" ", "text_group", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("string")))
    marked = marked.select("doc_id", "size", "text_crc32", "tokens", unit.alias("unit"))
    units = marked.groupBy("unit").agg(*sums).orderBy("unit").collect()  # bounded, see above
    chosen = pack(np.array([[u[s] for s in SIZES] for u in units], float), shards)
    places = spark.createDataFrame([(u.unit, int(s)) for u, s in zip(units, chosen, strict=True)], "unit string, shard int")
    lots = max(16, total["rows"] // SLOT_ROWS)
    placed = marked.join(F.broadcast(places), "unit").withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(lots)))
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """Slots without a gap: rows are numbered in each lot of a shard, after all rows of the lots before it."""
    from pyspark.sql import Window

    counts = placed.groupBy("shard", "lot").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "lot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "lot").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(offsets, ["shard", "lot"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place") - 1).cast("bigint").alias("slot"))
    )
