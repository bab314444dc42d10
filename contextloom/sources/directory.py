"""Directories, version control and stored states as sources of the files table."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.operators.discovery import is_binary_content

_REF = re.compile(r"[A-Za-z0-9_][\w./@{}^~-]*")


def directory_files(spark: SparkSession, root: str, repo: str = "", glob: str = "*") -> DataFrame:
    """``file_id, repo, path, n_bytes, content, is_binary, modified_at`` of all files below ``root``, read in parallel.

    Binary files have no content. The id is a hash of repository and path. ``.git`` is left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = Path(root).resolve().as_posix() if "://" not in root else root
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(base.rstrip("/")) + "/", "")
    binary = is_binary_content(F.col("content"))
    rows = raw.select(relative.alias("path"), F.col("length").alias("n_bytes"), F.when(~binary, F.decode("content", "UTF-8")).alias("content"), binary.alias("is_binary"), F.col("modificationTime").alias("modified_at"))
    return rows.where(~F.col("path").rlike(r"(^|/)\.git/")).select(F.xxhash64(F.lit(repo), "path").alias("file_id"), F.lit(repo).alias("repo"), "path", "n_bytes", "content", "is_binary", "modified_at")


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=120)
    return [line for line in done.stdout.split("\n") if line]


def tracked_paths(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of the files in the index of a working copy; a listing of names, gathered by the tool itself."""
    return spark.createDataFrame([(p,) for p in _git(root, "ls-files")], "path string")


def changed_lines(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """``line`` of the name-status listing between two revisions; names that could be options raise."""
    for ref in (base, head):
        if not _REF.fullmatch(ref):
            raise ValueError(f"not a revision: {ref!r}")
    return spark.createDataFrame([(line,) for line in _git(root, "diff", "--name-status", f"{base}..{head}")], "line string")


def stored_state(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, hash, modified_time`` of a state file: JSON with a map from paths to file states, version 1."""
    schema = "version string, files map<string, struct<size: bigint, content_hash: string, modified_time: string>>"
    state = spark.read.schema(schema).option("multiLine", "true").json(path)
    files = F.when(F.col("version") == "1", F.col("files")).otherwise(F.raise_error(F.concat(F.lit("unknown state version "), F.coalesce("version", F.lit("none")))))
    return state.select(F.explode(files).alias("path", "s")).select("path", "s.size", F.col("s.content_hash").alias("hash"), "s.modified_time")


def save_state(state: DataFrame, folder: str) -> None:
    """Write ``profile, path, size, hash, modified_time``, replacing the profiles it holds and no others."""
    state.withColumn("profile", F.regexp_replace("profile", "[^a-zA-Z0-9_-]", "_")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile").parquet(folder)


def clear_state(spark: SparkSession, folder: str, profile: str = "") -> bool:
    """Delete the state of one profile, or of all; whether there was any."""
    name = re.sub("[^a-zA-Z0-9_-]", "_", profile)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/profile={name}" if profile else folder)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def working_copy(root: str) -> dict:
    """``branch, head, n_changed`` of a working copy; None for a folder that is none."""
    if not (Path(root) / ".git").exists():
        return {"branch": None, "head": None, "n_changed": None}
    return {"branch": _git(root, "rev-parse", "--abbrev-ref", "HEAD")[0], "head": _git(root, "rev-parse", "--short", "HEAD")[0], "n_changed": len(_git(root, "status", "--porcelain"))}
