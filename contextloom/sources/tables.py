"""The project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set in ``sf_dir``, as it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The largest source that is spread by a shuffle; anything larger has splits enough.
SPREAD_BYTES = 2 << 30
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _bytes(setting: str) -> int:
    number = setting.strip().rstrip("bBkKmMgG")
    return int(number) * _UNITS[setting.strip()[len(number) :].lower()]


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` by hash of ``key`` over all cores where its source is small and has fewer splits than there are cores, else as it is.

    Parsing texts is slow work, and a small table may be one file with one row group. A split holds at most
    ``spark.sql.files.maxPartitionBytes``, so the number of splits bounds what would be shuffled: only up to
    ``SPREAD_BYTES``, whatever the cluster's size. For larger tables lower that setting instead.
    """
    spark = df.sparkSession
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    small = splits * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= SPREAD_BYTES
    return df.repartition(cores, key) if splits < cores and small else df


def distinct_rows(df: DataFrame, key: str, *, latest: str | None = None) -> DataFrame:
    """One row per ``key`` for narrow tables whose rows may be delivered again.

    With ``latest`` the row with the greatest value of that column is kept (ties: the greatest row);
    without it, any of the identical deliveries. Rows whose key is null are dropped. The text of a
    file should not pass through here: dedupe on its narrow columns or on results instead.
    """
    others = [c for c in df.columns if c != key]
    packed = F.struct(*([F.col(f"`{latest}`").alias("__latest")] if latest else []), *[F.col(f"`{c}`") for c in others])
    best = df.where(F.col(f"`{key}`").isNotNull()).groupBy(key).agg(F.max(packed).alias("__row"))
    return best.select(key, *[F.col("__row").getField(c).alias(c) for c in others]).select(*df.columns)
