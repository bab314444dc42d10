"""The narrow view of the files table: one row per file, without its content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SQL of the same view, for oracles: a common table expression named ``f``.
DESCRIPTORS_SQL = """f AS (
  SELECT file_id, max(repo) AS repo, max(path) AS path, max(strlen(content)) AS n_bytes, max(strlen(content)) // 4 AS tokens,
         max(CASE WHEN is_binary THEN 1 ELSE 0 END) = 1 AS is_binary, max(CASE WHEN is_symlink THEN 1 ELSE 0 END) = 1 AS is_symlink,
         max(length(content) - length(replace(content, chr(10), ''))) + 1 AS n_lines, max(error) AS error
  FROM files WHERE file_id IS NOT NULL GROUP BY file_id)"""


def descriptors(files: DataFrame) -> DataFrame:
    """``file_id, repo, path, n_bytes, tokens, is_binary, is_symlink, n_lines, error`` of each file.

    Sizes are measured from the content, not taken from claims; they are null where there is no content.
    Deliveries of the same file are combined before the shuffle, which moves no content.
    """
    n_bytes = F.octet_length("content").cast("long")
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1
    flag = lambda c: F.coalesce(F.max(F.coalesce(F.col(c), F.lit(False))), F.lit(False)).alias(c)
    return (
        files.where(F.col("file_id").isNotNull())
        .select("file_id", "repo", "path", n_bytes.alias("n_bytes"), lines.cast("long").alias("n_lines"), "is_binary", "is_symlink", "error")
        .groupBy("file_id")
        .agg(F.max("repo").alias("repo"), F.max("path").alias("path"), F.max("n_bytes").alias("n_bytes"), flag("is_binary"), flag("is_symlink"), F.max("n_lines").alias("n_lines"), F.max("error").alias("error"))
        .select("file_id", "repo", "path", "n_bytes", F.expr("n_bytes div 4").alias("tokens"), "is_binary", "is_symlink", "n_lines", "error")
    )
