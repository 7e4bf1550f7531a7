"""CSV and Parquet tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecube.operators.shares import sort_keys
from ratecube.session import kept

# State population by immigration status.
STATUS_SCHEMA = "state_abb string, immig_status string, population double, n long"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV under an explicit schema: inference would turn codes into numbers."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, nullValue="NA")


#: Column of the text of a line that does not fit its schema.
BAD_LINE = "bad_line"


def read_csv_checked(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of a CSV: lines that are short, long, or have a value of another type are kept aside.

    The bad lines are a table (path, bad_line). The parsed lines are written once, and both come off that: Spark lets no
    query read the bad lines alone off the file. Columns are not pruned, as a line would pass then for the columns
    that a query happens to read.
    """
    whole = f"{schema}, {BAD_LINE} string"
    options = {"header": True, "enforceSchema": False, "nullValue": "NA", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE, "columnPruning": False}
    rows = kept(spark.read.options(**options).schema(whole).csv(path).select("*", F.col("_metadata.file_path").alias("path")), "csv")
    good = rows.filter(F.col(BAD_LINE).isNull()).drop(BAD_LINE, "path")
    return good, rows.filter(F.col(BAD_LINE).isNotNull()).select("path", BAD_LINE)


def text_schema(names: list[str]) -> str:
    return ", ".join(f"{name} string" for name in names)


def write_result(table: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV of a result table sorted by `order` (see `sort_keys`), nulls written as NA.

    The sort is by range, so the part files are in order; adaptive execution
    merges small ranges, which leaves one file for a small table.
    """
    if order:
        table = table.orderBy(*sort_keys(order))
    table.write.csv(path, header=True, mode="overwrite", nullValue="NA")


def write_extract(records: DataFrame, path: str, format: str = "parquet", add: bool = False) -> None:
    """Record-level extract, one directory per year, so that later reads prune years.

    Rows are first gathered by year in pieces of even size: a large year is split
    over several tasks and a small one does not end up in one file per scan task.
    With `add`, only the years of `records` are written anew; files of other years stay.
    """
    _by_year(records.hint("rebalance", "data_year"), path, format, add)


def _by_year(table: DataFrame, path: str, format: str, add: bool) -> None:
    writer = table.write.partitionBy("data_year").format(format).option("header", True).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic" if add else "static").save(path)


def read_extract(spark: SparkSession, path: str, schema: str | None = None, format: str = "parquet") -> DataFrame:
    """An extract again; `data_year` is text, as in the records. CSV needs the schema of its other columns.

    Years of different layouts have different fields: those of all Parquet files are there, null where a file lacks one.
    """
    reader = spark.read.format(format).option("header", True).option("mergeSchema", True)
    table = (reader.schema(schema) if schema else reader).load(path)
    return table.withColumn("data_year", F.col("data_year").cast("string"))


def write_cells(cells: DataFrame, path: str, add: bool = False) -> None:
    """Keep an intermediate table: cells, or a subset of the microdata.

    With `add`, cells that have a data_year replace those of their years in a table that `write_year_cells` wrote.
    """
    if add:
        write_year_cells(cells, path, add=True)
    else:
        cells.write.parquet(path, mode="overwrite")


def write_year_cells(cells: DataFrame, path: str, add: bool = False) -> None:
    """Cells in one directory per data year, a file each: cubes are small, and a new year joins without a rewrite."""
    _by_year(cells.repartition("data_year"), path, "parquet", add)


def write_bucketed(cells: DataFrame, name: str, path: str, keys: list[str], buckets: int = 16) -> DataFrame:
    """Cells as the table `name` under `path`, laid out for reports that group by `keys` and more: such a report needs no shuffle.

    Rows that agree in `keys` are in one file, sorted by them. Spark keeps the layout in its catalog, so the table must
    be read by name. For cells, whose number is bounded by the code tables; records would be uneven under a hot key.
    """
    spread = cells.repartition(buckets, *keys)
    spread.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option("path", path).saveAsTable(name)
    return cells.sparkSession.table(name)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
