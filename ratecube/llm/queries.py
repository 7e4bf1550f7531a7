"""Registered queries of the subpackage, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecube.llm import ball_search, byte_bpe, clustering, decontaminate, language_id, licenses, ngram_join, phrase_dedup, quality, set_sketch, sharding, sql, suffix_dedup, toxicity
from ratecube.llm.common import documents_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, measures, failures = quality.ledger(documents_of(spark, sf_dir).select("doc_id", "text"))
    m = F.col(measures)
    return table.select(
        "doc_id",
        *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~quality.passes(F.col(failures), "base")).alias("base_failed"),
        quality.passes(F.col(failures), "v1").alias("kept"),
        F.col(failures).alias("failures"),
    )


def _remainder(n: int):
    """crc32 of the id, written as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    table = toxicity.scores(documents_of(spark, sf_dir), labels, _remainder(3) != 1)
    return table.select(
        "doc_id",
        F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents_of(spark, sf_dir), ["doc_id"])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents_of(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents_of(spark, sf_dir), ["doc_id"])


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sharding.plan(documents_of(spark, sf_dir))
    return table.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_of(spark, sf_dir)
    model = language_id.labeller(docs.filter(_remainder(4) != 2))
    table = language_id.label(docs, model, ["doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")])
    return table.select("doc_id", "held_out", "lang_pred", "score", "runs")


def op9_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.report(documents_of(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents_of(spark, sf_dir))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_sketch.join(documents_of(spark, sf_dir))


def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_toxicity": op2_toxicity,
        "op3_license_scan": op3_license_scan,
        "op4_decontaminate": op4_decontaminate,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_sharding": op7_sharding,
        "op8_language_id": op8_language_id,
        "op9_phrase_dedup": op9_phrase_dedup,
        "op10_ngram_join": op10_ngram_join,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_setsketch_dedup": op12_setsketch_dedup,
        "op13_ball_tree_search": op13_ball_tree_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": sql.QUALITY,
        "op3_license_scan": sql.license_scan(),
        "op4_decontaminate": sql.DECONTAMINATE,
        "op5_suffix_dedup": sql.STRINGS,
        "op9_phrase_dedup": sql.PHRASES,
        "op10_ngram_join": sql.COMPONENTS,
        "op11_centroid_clustering": sql.clusters(),
        "op12_setsketch_dedup": sql.NEAR_COPIES,
        "op13_ball_tree_search": sql.RANKED,
    }
