"""Figures about a set of files: tokens by tier and language, top lists, heat maps, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.functions.tables import DOCUMENT_OVERHEAD, FILE_OVERHEAD


def token_report(df: DataFrame, *by: str) -> DataFrame:
    """Per tier: files, tokens and their percentage of all, cut to a whole number; of nothing it is 0."""
    tiers = df.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    total = tiers.groupBy(*by).agg(F.sum("tokens").alias("total"))
    joined = tiers.join(total, list(by)) if by else tiers.crossJoin(total)  # the total is one row
    return joined.select(*by, "tier", "n_files", "tokens", F.when(F.col("total") > 0, F.expr("tokens * 100 div total")).otherwise(0).alias("percent"))


def top_files(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` files with most tokens, ties by path and id; all of them if ``n`` isn't positive."""
    ordered = df.where(F.col("tokens").isNotNull()).orderBy(F.desc("tokens"), "path", "file_id")
    return ordered.limit(n) if n > 0 else ordered


def heat_map(df: DataFrame) -> DataFrame:
    """``file_id, path, tokens, n_lines, density``: tokens per line; 0 without lines."""
    return df.where(F.col("tokens").isNotNull()).select(
        "file_id", "path", "tokens", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.when(F.coalesce("n_lines", F.lit(0)) > 0, F.round(F.col("tokens") / F.col("n_lines"), 6)).otherwise(0.0).alias("density")
    )


def estimated_overhead(df: DataFrame, *by: str) -> DataFrame:
    """The tokens of a document around its files."""
    return df.groupBy(*by).agg((F.lit(DOCUMENT_OVERHEAD) + F.count(F.lit(1)) * FILE_OVERHEAD).alias("overhead_tokens"))


def pipeline_stats(df: DataFrame, *by: str) -> DataFrame:
    """Files, tokens, binaries and errors; any error makes the exit code 2."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum(F.col("is_binary").cast("long")).alias("n_binary"),
        F.when(F.max(F.col("error").isNotNull()), 2).otherwise(0).alias("exit_code"),
    )


def selection_stats(df: DataFrame, secrets: DataFrame, *by: str) -> DataFrame:
    """Per group of a selection (``file_id, tokens, included``): files, selected ones, their tokens, and those of them that hold secrets (``file_id``)."""
    marked = df.join(secrets.select("file_id").distinct().withColumn("__secret", F.lit(True)), "file_id", "left")
    chosen = F.col("included")
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(chosen.cast("long")).alias("n_selected"), F.coalesce(F.sum(F.when(chosen, F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.sum((chosen & F.coalesce("__secret", F.lit(False))).cast("long")).alias("n_with_secrets"),
    )
