"""Writing finished documents, each as one file, completely or not at all."""

from __future__ import annotations

import hashlib
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENDINGS = {"markdown": ".md", "xml": ".xml", "plain": ".txt"}


def output_path(flag: str = "", profile: str = "", kind: str = "markdown", default: str = "context") -> Path:
    """Flag before profile before default; the kind's ending is added where there is none."""
    path = Path(flag or profile or default)
    return path if path.suffix else path.with_name(path.name + ENDINGS[kind])


def part_path(path: Path, number: int, total: int) -> Path:
    """Parts are numbered only if there is more than one."""
    return path if total <= 1 else path.with_name(f"{path.stem}.part-{number:03d}{path.suffix}")


def write_text(path: Path, text: str) -> str:
    """Write through a temporary file beside ``path`` and return the SHA-256 of the bytes. The folder must exist."""
    data = text.encode("utf-8")
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    return hashlib.sha256(data).hexdigest()


def write_documents(docs: DataFrame, folder: str | Path, kind: str = "markdown") -> dict[str, str]:
    """One file per row of ``repo, part_no, document``; returns hashes by file name. One document at a time is on the driver.

    Names carry the part's number where a repository has more than one. Without ``part_no`` a row is a whole document.
    """
    parts = docs.withColumn("part_no", F.lit(1)) if "part_no" not in docs.columns else docs
    totals = {r.repo: r.n for r in parts.groupBy("repo").agg(F.max("part_no").alias("n")).where("n > 1").toLocalIterator()}
    written = {}
    for row in parts.select("repo", "part_no", "document").toLocalIterator():
        path = part_path(Path(folder) / (row.repo.replace("/", "__") + ENDINGS[kind]), row.part_no, totals.get(row.repo, 1))
        written[path.name] = write_text(path, row.document)
    return written
