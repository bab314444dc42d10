"""Changes of a stream of file deliveries against a stored state.

Files arrive again and again; each micro-batch keeps the last delivery of a file, compares it with the
state, appends what changed and folds the batch into the state. A delivery that is older than what the
state holds changes nothing. The state has two generations that take turns, so a failed batch is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from contextloom.operators.changes import compared_states


def delivered(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 16) -> DataFrame:
    """A stream of Parquet files that land in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def latest(batch: DataFrame) -> DataFrame:
    """``repo, path, hash, ingested_at``: of several deliveries of a path the last one counts, ties by hash."""
    best = batch.where(F.col("path").isNotNull()).groupBy("repo", "path").agg(F.max(F.struct("ingested_at", F.md5("content").alias("hash"))).alias("m"))
    return best.select("repo", "path", F.col("m.hash").alias("hash"), F.col("m.ingested_at").alias("ingested_at"))


def counted_by_window(stream: DataFrame, size: str = "1 hour", late: str = "2 days") -> DataFrame:
    """``window, repo, n``: deliveries per time window of their event time; later ones than ``late`` are dropped by the watermark."""
    return stream.withColumn("at", F.col("ingested_at").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", size), "repo").agg(F.count(F.lit(1)).alias("n"))


def follow_changes(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Run ``stream`` (files rows) to its present end: changes go to ``folder/changes``, the state to ``folder/state/0`` and ``1`` in turns."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch)
        old = spark.read.parquet(f"{folder}/state/{(number - 1) % 2}") if number else spark.createDataFrame([], new.schema)
        held = old.select("repo", "path", F.col("ingested_at").alias("held_at"))
        new = new.join(held, ["repo", "path"], "left").where("held_at IS NULL OR ingested_at >= held_at").drop("held_at")
        seen = compared_states(old.join(new.select("repo", "path"), ["repo", "path"], "left_semi"), new, "repo")
        seen.where("change <> 'unchanged'").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        old.join(new.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{folder}/state/{number % 2}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
