"""Relevance tiers: classification by globs, order, explanation and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.globs import any_regex, glob_regex
from contextloom.functions.tables import TIER_KEYS, TIER_PATTERNS, UNMATCHED_TIER
from contextloom.functions.text import normal_path

Tiers = Mapping[int, Sequence[str]]


def tier_of(path: Column, tiers: Tiers = TIER_PATTERNS, unmatched: int = UNMATCHED_TIER) -> Column:
    """The lowest tier with a glob that matches the whole path; a null path is unmatched. One regex per tier, first match wins."""
    normal = normal_path(path)
    found = F.lit(None).cast("int")
    for tier in sorted(tiers, reverse=True):
        if tiers[tier]:
            found = F.when(normal.rlike(any_regex(glob_regex(p) for p in tiers[tier])), F.lit(tier)).otherwise(found)
    return F.coalesce(found, F.lit(unmatched))


def tier_key(tier: Column) -> Column:
    labels = F.array(*[F.lit(x) for x in TIER_KEYS])
    return F.coalesce(F.get(labels, tier), F.concat(F.lit("tier"), tier.cast("string")))


def classified(df: DataFrame, tiers: Tiers = TIER_PATTERNS) -> DataFrame:
    """``df`` with its column ``tier`` replaced by the one its path has."""
    return df.withColumn("tier", tier_of(F.col("path"), tiers))


def tier_summary(df: DataFrame, *by: str) -> DataFrame:
    """Per tier: files and tokens; null tokens count 0."""
    return df.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def explained(df: DataFrame, tiers: Tiers = TIER_PATTERNS) -> DataFrame:
    """``file_id, path, tier, pattern, ord, is_winner``: every (tier, pattern) that matches a path, and which one decides.

    The patterns are few and fixed, so each row tests them in place; no join.
    """
    flat = [(tier, n, p) for tier in sorted(tiers) for n, p in enumerate(tiers[tier])]
    normal = normal_path(F.col("path"))
    hits = F.filter(
        F.array(*[F.when(normal.rlike(glob_regex(p)), F.struct(F.lit(tier).alias("tier"), F.lit(n).alias("ord"), F.lit(p).alias("pattern"))) for tier, n, p in flat]),
        lambda x: x.isNotNull(),
    )
    first = F.try_element_at("hits", F.lit(1))
    return (
        df.withColumn("hits", hits)
        .select("file_id", "path", first.alias("best"), F.explode("hits").alias("hit"))
        .select("file_id", "path", "hit.tier", "hit.ord", "hit.pattern", (F.col("hit") == F.col("best")).alias("is_winner"))
    )


def grouped_by_tier(df: DataFrame, *by: str) -> DataFrame:
    """``tier, n_files, tokens, paths`` of each group, paths in order, tiers that hold nothing left out."""
    return df.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sort_array(F.collect_list("path")).alias("paths"))
