"""Session set-up for tests, benchmarks and small jobs, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: HotSpot never compiles a method of more bytes than this.
COMPILED_BYTES = 8000


def compiled_stages(spark: SparkSession) -> None:
    """For wide projections: a stage whose generated method HotSpot would never compile goes operator by operator,
    whose code Spark splits into small methods. Results are the same. This sets an option of the session."""
    option = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(option)) > COMPILED_BYTES:
        spark.conf.set(option, COMPILED_BYTES)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir. Where none is set, a local session
    takes a temporary one; a cluster must name a folder that all its nodes share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        shared = tempfile.mkdtemp(prefix="ratecube-checkpoint-")
    context.setCheckpointDir(shared)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for an intermediate file, in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def kept(table: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back: computed once, lost by no executor."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
