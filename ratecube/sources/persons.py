"""Survey microdata: one row per sampled person, with a weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratecube.sources.codebook import read_codebook
from ratecube.sources.fixed_width import scan_fixed_width
from ratecube.sources.layouts import PERSON_FIELDS, Field


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.lower() for name in df.columns])


def person_columns(df: DataFrame) -> DataFrame:
    """The microdata columns in use, under lower-case names."""
    lowered = lower_names(df)
    return lowered.select(*[name for name in PERSON_FIELDS if name in lowered.columns])


def read_persons(spark: SparkSession, paths: list[str], codebook: list[Field]) -> DataFrame:
    """Fixed-width microdata described by codebook fields (see `codebook_layout`)."""
    return person_columns(scan_fixed_width(spark, paths, codebook))


def read_persons_by_codebook(spark: SparkSession, paths: list[str], codebook: str) -> DataFrame:
    """Fixed-width microdata with the codebook file that came with it: the columns in use, typed."""
    layout = read_codebook(spark, codebook)
    return read_persons(spark, paths, [field for field in layout if field.name in PERSON_FIELDS])
