"""What changed between consecutive full snapshots of a table.

Both directions of ``EXCEPT ALL`` between a snapshot and its predecessor are taken at once: every
row counts +1 for its own snapshot and -1 for the next one of its series, and rows whose counts
cancel are identical. The residues are then matched by key, which labels them. Because a snapshot
and its predecessor meet under one hash key (series, path), the whole comparison costs one shuffle
of the narrow rows; no snapshot is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SERIES = ("repo", "profile_name", "git_branch")


def normal_path(path: Column) -> Column:
    """A leading ``./`` is no part of a path."""
    return F.regexp_replace(path, r"^\./", "")


def normal_hash(value: Column) -> Column:
    """A 64-bit number written as hex text, in one spelling: lower case, no spaces, ``0x`` or leading zeros."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(value), r"\s+", ""), "^0x", "")
    return F.when(digits == "", None).otherwise(
        F.regexp_replace(digits, r"^0+(?=.)", "")
    )


def series_positions(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, series, pos, last``: each snapshot's place in its series, counted from 1.

    Headers delivered again count once. Headers whose instant cannot be read, or that have no id,
    take no part. Equal instants are ordered by receipt, then by id.
    """
    at = F.try_to_timestamp(F.col("generated_at"))
    heads = (
        snapshots.where(F.col("snapshot_id").isNotNull())
        .select("snapshot_id", *SERIES, at.alias("at"), "received_at")
        .where(F.col("at").isNotNull())
        .groupBy("snapshot_id")
        .agg(F.max(F.struct("received_at", "at", *SERIES)).alias("h"))
        .select("snapshot_id", "h.*")
    )
    series = W.partitionBy(*SERIES)
    order = series.orderBy("at", "received_at", "snapshot_id")
    return heads.select(
        "snapshot_id",
        F.xxhash64(*[F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in SERIES]).alias("series"),
        F.row_number().over(order).alias("pos"),
        F.lead("snapshot_id").over(order).alias("next_id"),
    )


def snapshot_changes(snapshots: DataFrame, snapshot_files: DataFrame) -> DataFrame:
    """``snapshot_id, path, change_kind`` for each snapshot but the first of its series.

    ``added``: the path is only in this snapshot; ``deleted``: only in the previous one;
    ``modified``: in both, with two known hashes that differ as numbers. Of several rows for a path
    the one received last counts (ties: the greatest hash). Rows without path or without a known
    snapshot are left out; a snapshot without rows is an empty one, so everything counts as deleted.
    Other columns of the inputs are ignored. Empty tables give an empty result.
    """
    rows = (
        snapshot_files.where(F.col("path").isNotNull())
        .select("snapshot_id", normal_path(F.col("path")).alias("path"), normal_hash(F.col("content_hash")).alias("hash"), "received_at")
        .join(series_positions(snapshots), "snapshot_id")
        .repartition("series", "path")
    )
    current = (
        rows.groupBy("series", "path", "snapshot_id", "pos", "next_id")
        .agg(F.max(F.struct("received_at", "hash")).getField("hash").alias("hash"))
    )
    as_current = F.struct(F.col("snapshot_id").alias("id"), F.lit(1).alias("sign"))
    as_previous = F.struct(F.col("next_id").alias("id"), F.lit(-1).alias("sign"))
    signed = (
        current.select(
            "series", "path", "hash",
            F.explode(
                F.filter(
                    F.array(F.when(F.col("pos") > 1, as_current), F.when(F.col("next_id").isNotNull(), as_previous)),
                    lambda side: side.isNotNull(),
                )
            ).alias("side"),
        )
        .select("series", "path", "hash", F.col("side.id").alias("id"), F.col("side.sign").alias("sign"))
    )
    residue = signed.groupBy("series", "path", "id", "hash").agg(F.sum("sign").alias("n")).where(F.col("n") != 0)
    here, before = F.col("n") > 0, F.col("n") < 0
    labelled = residue.groupBy("series", "path", "id").agg(
        F.max(here).alias("is_here"),
        F.max(before).alias("was_here"),
        F.max(F.when(here, F.col("hash"))).alias("new_hash"),
        F.max(F.when(before, F.col("hash"))).alias("old_hash"),
    )
    kind = (
        F.when(~F.col("was_here"), "added")
        .when(~F.col("is_here"), "deleted")
        .when(F.col("new_hash").isNotNull() & F.col("old_hash").isNotNull(), "modified")
    )
    return labelled.select(F.col("id").alias("snapshot_id"), "path", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())
