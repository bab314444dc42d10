"""The listings beside the walk: what is hashed, what workflows see, one level of a tree, the files of modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories that the listing for hashing and the listing for workflows leave out.
UNHASHED_DIRS = ("node_modules", "vendor", "__pycache__", "dist", "build", "target")
UNLISTED_DIRS = (".git", "node_modules", "vendor", "dist", "__pycache__")


def _above(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def is_hashed(path: Column, is_symlink: Column) -> Column:
    """Whether a file takes part in content hashes: no link, no name on its path that begins with a dot, no build directory above it."""
    dotted = F.exists(F.split(path, "/"), lambda s: s.startswith("."))
    return ~(F.coalesce(is_symlink, F.lit(False)) | dotted | F.exists(_above(path), lambda s: s.isin(*UNHASHED_DIRS)))


def is_listed(path: Column) -> Column:
    """Whether workflows see a file: directories with a dot and some others are pruned, dot files are kept."""
    return ~F.exists(_above(path), lambda s: s.startswith(".") | s.isin(*UNLISTED_DIRS))


def level(paths: DataFrame, directory: str = "") -> DataFrame:
    """``repo, path, name, is_dir``: the children of one directory of each repository; ignored paths and binaries are left out.

    ``paths`` has ``repo, path, is_ignored, is_binary``. A directory shows if any file below it does, as a listing of
    paths knows no empty ones; ``.git`` never does.
    """
    lead = directory.strip("/") + "/" if directory.strip("/") else ""
    below = paths.where(F.col("path").startswith(lead) & ~F.col("is_ignored") & ~F.coalesce("is_binary", F.lit(False)))
    rest = F.substring("path", len(lead) + 1, 1 << 30)
    name, is_dir = F.substring_index(rest, "/", 1), F.contains(rest, F.lit("/"))
    return below.select("repo", F.concat(F.lit(lead), name).alias("path"), name.alias("name"), is_dir.alias("is_dir")).where("name <> '.git'").distinct()


def in_modules(path: Column, modules: Sequence[str]) -> Column:
    """Whether a path is one of the modules or lies below one."""
    out = F.lit(False)
    for module in modules:
        out = out | (path == module) | path.startswith(module.rstrip("/") + "/")
    return out


def symlink_verdicts(links: DataFrame) -> DataFrame:
    """``links`` (``repo, path, real_path``) with ``verdict``: ``symlink_error`` without a target, ``symlink_loop`` for a target already visited, ``followed`` else.

    Of the links to one target the first by path is followed; the targets' first visits are a partial aggregate.
    """
    first = links.where(F.col("real_path").isNotNull()).groupBy("repo", "real_path").agg(F.min("path").alias("__first"))
    joined = links.join(first, ["repo", "real_path"], "left")
    verdict = F.when(F.col("real_path").isNull(), "symlink_error").when(F.col("path") == F.col("__first"), "followed").otherwise("symlink_loop")
    return joined.select(*links.columns, verdict.alias("verdict"))
