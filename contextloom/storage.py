"""Intermediate tables in the folder that all executors share.

A step whose result is read more than once, and that is expensive to repeat, is written as Parquet
below the cluster's checkpoint folder. Unlike executor-local caching this survives the loss of any
executor, and unlike a checkpointed RDD a later reader can prune its columns.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. Where none is configured, a local master gets a local one; a cluster raises, as executors would write to their own disks."""
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_SETTING} has to name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='contextloom-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard_materialized() -> None:
    """Delete the tables written by this process. Called at exit; call it earlier when results are stored."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            continue


atexit.register(discard_materialized)
