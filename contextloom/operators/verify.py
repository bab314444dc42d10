"""Checking rendered files against their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DIFF_LINES = 10


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\n+$", "")


def is_redaction_diff(source: Column, shown: Column) -> Column:
    """Whether two texts differ only by masked spans: line counts within one, and differing lines hold each other without masks."""
    a, b = F.split(source, "\n", -1), F.split(shown, "\n", -1)
    n = F.least(F.size(a), F.size(b))
    bare = lambda s: F.trim(F.regexp_replace(s, r"\[REDACTED:[^\]]*\]", ""))
    held = lambda x, y: F.when(x == y, True).otherwise((bare(y) == "") | F.contains(x, F.trim(F.regexp_extract(y, r"^(.*?)\[REDACTED:", 1))) & F.contains(x, F.trim(F.regexp_extract(y, r"\[REDACTED:[^\]]*\]([^\[]*)$", 1))) & F.contains(y, F.lit("[REDACTED:")))
    alike = F.forall(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), held), lambda ok: ok)
    return (F.abs(F.size(a) - F.size(b)) <= 1) & alike


def status(source: Column, shown: Column, is_compressed: Column, redactions: Column) -> Column:
    """``FILE_CHANGED`` (source gone), ``COMPRESSION_DIFF``, ``MATCH``, ``REDACTION_DIFF`` or ``UNEXPECTED_DIFF``; the first that holds."""
    return (
        F.when(source.isNull(), "FILE_CHANGED")
        .when(is_compressed, "COMPRESSION_DIFF")
        .when(trimmed(source) == trimmed(shown), "MATCH")
        .when((redactions > 0) & is_redaction_diff(source, shown), "REDACTION_DIFF")
        .otherwise("UNEXPECTED_DIFF")
    )


def verified(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, path, status`` of each rendered file, by a left join on (repo, path).

    Digests are joined first; only where they differ and masks might explain it, the sources' texts are fetched.
    """
    digest = lambda text: F.md5(trimmed(text))
    sources = files.where(F.col("path").isNotNull()).select("repo", "path", digest(F.col("content")).alias("source_md5")).groupBy("repo", "path").agg(F.max("source_md5").alias("source_md5"))
    compressed = F.coalesce(F.col("is_compressed"), F.lit(False)) if "is_compressed" in parsed.columns else F.lit(False)
    masked = F.coalesce(F.col("redactions"), F.lit(0)) > 0
    shown = parsed.select("repo", "path", compressed.alias("compressed"), digest(F.col("content")).alias("shown_md5"), masked.alias("masked"), F.when(masked & ~compressed, F.col("content")).alias("shown"))
    first = (
        F.when(F.col("source_md5").isNull(), "FILE_CHANGED").when(F.col("compressed"), "COMPRESSION_DIFF").when(F.col("source_md5") == F.col("shown_md5"), "MATCH").when(~F.col("masked"), "UNEXPECTED_DIFF")
    )
    joined = shown.join(sources, ["repo", "path"], "left").select("repo", "path", "shown", first.alias("status"))
    open_, decided = joined.where("status IS NULL"), joined.where("status IS NOT NULL").select("repo", "path", "status")
    texts = files.where(F.col("path").isNotNull() & F.col("content").isNotNull()).select("repo", "path", F.col("content").alias("source")).join(open_.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    texts = texts.groupBy("repo", "path").agg(F.max("source").alias("source"))
    rest = open_.join(texts, ["repo", "path"]).select("repo", "path", F.when(is_redaction_diff(F.col("source"), F.col("shown")), "REDACTION_DIFF").otherwise("UNEXPECTED_DIFF").alias("status"))
    return decided.unionByName(rest)


def tallies(statuses: DataFrame) -> DataFrame:
    """``repo, n_files, n_passed, n_failed, n_redacted, n_compressed``: matches, masked and compressed files pass."""
    n = lambda *kinds: F.sum(F.col("status").isin(*kinds).cast("long"))
    return statuses.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_files"), n("MATCH", "REDACTION_DIFF", "COMPRESSION_DIFF").alias("n_passed"), n("UNEXPECTED_DIFF", "FILE_CHANGED").alias("n_failed"),
        n("REDACTION_DIFF").alias("n_redacted"), n("COMPRESSION_DIFF").alias("n_compressed"),
    )


def line_differences(old: Column, new: Column) -> Column:
    """Up to ``MAX_DIFF_LINES`` ``(line, old, new)`` of lines that differ at the same position."""
    a, b = F.split(old, "\n", -1), F.split(new, "\n", -1)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("old"), y.alias("new")))
    numbered = F.transform(pairs, lambda p, i: F.struct((i + 1).alias("line"), p["old"].alias("old"), p["new"].alias("new")))
    return F.slice(F.filter(numbered, lambda p: ~p["old"].eqNullSafe(p["new"])), 1, MAX_DIFF_LINES)
