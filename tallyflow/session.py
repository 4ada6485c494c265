"""Session defaults and the one way this library writes intermediate tables."""

from __future__ import annotations

import functools
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tallyflow


def session(app: str = "tallyflow", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


# Functions of this package travel to workers inside the job, so nothing needs installing there.
cloudpickle.register_pickle_by_value(tallyflow)


def prepare(spark: SparkSession) -> SparkSession:
    """Day and hour keys are UTC whatever session the caller brings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Batches for Python workers of about ``size`` rather than up to 64 MB of text; no row is cut.

    A batch lies in the executor's memory outside the heap while it is filled, in buffers that
    double, and again in the worker, for each task at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or where that is not set the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


@functools.cache
def _expiring(spark: SparkSession, folder: str) -> str:
    """A folder that is removed when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    own = _expiring(spark, f"{shared_dir(spark)}/tallyflow/{spark.sparkContext.applicationId}")
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    Cuts the lineage in a way that survives a lost executor. The scan also
    carries its true file size, so Catalyst broadcasts it only when it is under
    ``spark.sql.autoBroadcastJoinThreshold``; nothing here forces a broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
