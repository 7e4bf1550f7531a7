"""What the operators share: scratch tables, bounded Arrow batches, free column names, UTF-8 buffers."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ratecube.session import ensure_checkpoint_dir

#: An Arrow batch of texts holds at most so many rows and about so many bytes (at least one row).
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what a Python worker gets at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    ship(spark)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application, so that they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back.

    Lost executors lose nothing of it, and it is computed once however often it is read.
    """
    spark = table.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go at its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def release_memory() -> None:
    """Give what a task no longer needs back to the system: a Python worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def releasing(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task's batches, after which memory is released."""

    @wraps(work)
    def done(batches: Iterator) -> Iterator:
        yield from work(batches)
        release_memory()

    return done


def free_name(table: DataFrame, wanted: str) -> str:
    """A column name that the table doesn't have yet, whatever the case of its letters."""
    taken = {name.lower() for name in table.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and the n + 1 places where texts begin and end; null is empty."""
    if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    else:
        texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    _, places, data = texts.buffers()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


LONG, INT, DOUBLE, STRING, BINARY, BOOLEAN = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.BooleanType()


def struct_of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def list_of(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)
