"""Which files are taken up: ignore rules, filters, and why the rest is skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.globs import any_regex, glob_regex, ignore_regex
from contextloom.functions.tables import DEFAULT_IGNORE, SENSITIVE_FILES, SENSITIVE_PATHS
from contextloom.functions.text import ending, file_name

MAX_FILE_BYTES = 1 << 20
BINARY_HEAD = 8192


def ignored_by_default(path: Column, patterns: Sequence[str] = DEFAULT_IGNORE) -> Column:
    return path.rlike(any_regex(ignore_regex(p) for p in patterns))


def is_sensitive_path(path: Column) -> Column:
    return path.rlike(any_regex(ignore_regex(p) for p in SENSITIVE_PATHS))


def is_sensitive_file(path: Column) -> Column:
    """Globs on the whole path, and on the bare name where a glob has no slash."""
    bare = any_regex(glob_regex(p) for p in SENSITIVE_FILES if "/" not in p)
    return path.rlike(any_regex(glob_regex(p) for p in SENSITIVE_FILES)) | file_name(path).rlike(bare)


def matches_patterns(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), extensions: Sequence[str] = ()) -> Column:
    """Excludes win; without includes and extensions everything passes; else an include glob or an ending must match."""
    out = ~path.rlike(any_regex(glob_regex(p) for p in exclude)) if exclude else F.lit(True)
    if include or extensions:
        chosen = path.rlike(any_regex(glob_regex(p) for p in include)) if include else F.lit(False)
        if extensions:
            chosen = chosen | F.lower(ending(path)).isin([e.lower().lstrip(".") for e in extensions])
        out = out & chosen
    return out


def is_binary_content(content: Column) -> Column:
    """A zero byte among the first ``BINARY_HEAD`` bytes; empty and null contents are text."""
    head = F.substring(content.cast("binary"), 1, BINARY_HEAD)
    return F.coalesce(F.contains(head, F.lit(b"\x00")), F.lit(False))


def ignore_rules(spark, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """``dir, ord, regex, negate`` of ignore files given as ``(directory, lines)``; blank lines and comments are skipped."""
    rows = []
    for where, lines in rules:
        for n, raw in enumerate(lines):
            line = raw.strip()
            if line and not line.startswith("#"):
                rows.append((where.strip("/"), n, ignore_regex(line.lstrip("!")), line.startswith("!")))
    return spark.createDataFrame(rows, "dir string, ord int, regex string, negate boolean")


def ignored_by_files(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``file_id`` of paths that some ignore file ignores.

    Within a file the last matching rule decides; a match of any file on the way ignores the path, and a
    deeper negation can't take it back. Each path meets the rules of its own ancestors by an equi-join.
    """
    segments = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(segments, 1, n), "/")))
    below = F.when(F.col("dir") == "", F.col("path")).otherwise(F.expr("substring(path, length(dir) + 2)"))
    hits = paths.select("file_id", "path", F.explode(ancestors).alias("dir")).join(rules, "dir").withColumn("below", below).where(F.expr("below rlike regex"))
    return hits.groupBy("file_id", "dir").agg(F.max_by("negate", "ord").alias("negated")).where(~F.col("negated")).select("file_id").distinct()


def ignored(paths: DataFrame, *rules: DataFrame) -> DataFrame:
    """``paths`` with ``is_ignored``: by the default patterns, or by any of several sets of ignore files (version control's, the tool's own)."""
    out = paths.withColumn("is_ignored", F.coalesce(ignored_by_default(F.col("path")), F.lit(False)))
    for each in rules:
        out = out.join(ignored_by_files(paths, each).withColumn("__hit", F.lit(True)), "file_id", "left")
        out = out.withColumn("is_ignored", F.col("is_ignored") | F.coalesce("__hit", F.lit(False))).drop("__hit")
    return out


def walk_counts(files: DataFrame, tracked: DataFrame, links: DataFrame, wanted: Column, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``repo, reason, n``: what the whole walk does with each file, ``kept`` or why it is skipped, counted once, by the first reason.

    ``files`` has ``file_id, repo, path, n_bytes, is_binary, is_symlink, error, is_ignored``; files below an ignored directory
    count as ``ignored_dir``; ``links`` has ``repo, path, verdict`` and ``tracked`` the ``file_id`` of an index.
    """
    directory = F.coalesce(F.regexp_extract("path", r"^(.*/)[^/]*$", 1), F.lit(""))
    joined = files.join(tracked.select("file_id").distinct().withColumn("__tracked", F.lit(True)), "file_id", "left").join(links.select("repo", "path", "verdict"), ["repo", "path"], "left")
    too_large = (F.col("n_bytes") > max_bytes) if max_bytes > 0 else F.lit(False)
    reason = (
        F.when(F.col("is_ignored") & ignored_by_default(F.concat(directory, F.lit("x"))), "ignored_dir").when(F.col("is_ignored"), "ignored").when(F.col("__tracked").isNull(), "not_tracked")
        .when(F.col("is_symlink") & (F.coalesce("verdict", F.lit("symlink_error")) != "followed"), F.coalesce("verdict", F.lit("symlink_error")))
        .when(F.col("error").isNotNull(), "stat_error").when(too_large, "large_file").when(F.col("is_binary"), "binary").when(~wanted, "pattern_filter").otherwise("kept")
    )
    return joined.select("repo", reason.alias("reason")).groupBy("repo", "reason").agg(F.count(F.lit(1)).alias("n"))


def skip_reason(path: Column, n_bytes: Column, is_binary: Column, is_symlink: Column, wanted: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The first reason to skip a file, in the order of the walk, or null: ignored, symlink, size, binary, pattern."""
    too_large = (n_bytes > max_bytes) if max_bytes > 0 else F.lit(False)
    return (
        F.when(ignored_by_default(path), "ignored")
        .when(is_symlink, "symlink_error")
        .when(too_large, "large_file")
        .when(is_binary, "binary")
        .when(~wanted, "pattern_filter")
    )


def skip_counts(discovery: DataFrame) -> DataFrame:
    """``repo, reason, n``: skip reasons over all scans, in one spelling; scans delivered twice count once."""
    scans = discovery.where(F.col("discovery_id").isNotNull()).groupBy("discovery_id").agg(F.max("repo").alias("repo"), F.max_by("skip_reasons", F.when(F.col("skip_reasons").isNotNull(), 1)).alias("reasons"))
    return scans.select("repo", F.explode("reasons").alias("reason", "n")).groupBy("repo", F.lower(F.trim("reason")).alias("reason")).agg(F.sum("n").alias("n"))


def tracked_only(files: DataFrame, tracked: DataFrame) -> DataFrame:
    """Files that a version-control index lists: a left semi join."""
    return files.join(tracked.select("file_id").distinct(), "file_id", "left_semi")


def unmatched_patterns(paths: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """``pattern, n_matches`` of every pattern; those with 0 fail an include assertion. One pass, one row out per pattern."""
    counts = paths.agg(*[F.coalesce(F.sum(F.col("path").rlike(glob_regex(p)).cast("long")), F.lit(0)).alias(f"p{n}") for n, p in enumerate(patterns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{n}").alias("n_matches")) for n, p in enumerate(patterns)])).alias("r")).select("r.*")


def assert_include(paths: DataFrame, patterns: Sequence[str]) -> None:
    """Raise if a pattern matches no path, naming all that don't."""
    missing = [r.pattern for r in unmatched_patterns(paths, patterns).where("n_matches = 0").collect()]
    if missing:
        raise ValueError("no file matches " + ", ".join(sorted(missing)))
