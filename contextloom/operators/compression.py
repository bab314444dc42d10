"""Compression of files to their signatures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.signatures import compressed, signatures
from contextloom.functions.tables import COMPRESSED_MARK, COMPRESSOR_LANGUAGES, SIGNATURE_PATTERNS
from contextloom.functions.text import ending, lookup
from contextloom.sources.tables import spread

_SOURCES = ("go", "python", "rust", "java", "c", "cpp", "typescript", "javascript")


def compressor_language(path: Column) -> Column:
    """The language by ending, compared exactly; null where there is no extractor."""
    return lookup(ending(path), COMPRESSOR_LANGUAGES, None)


def compressed_files(files: DataFrame, engine: str = "auto") -> DataFrame:
    """``file_id, path, language, status, n_signatures, original_bytes, compressed_bytes, content`` of each file with content.

    A compressed content begins with a mark. ``status`` is ``ast``, ``regex``, ``failed`` or ``skipped``; the
    latter two keep the file whole. One file's failure is its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, path, language, content in zip(pdf["file_id"], pdf["path"], pdf["language"], pdf["content"]):
                try:
                    out, status, n = compressed(content, language, engine)
                except Exception:  # noqa: BLE001 - a file that an extractor can't handle stays as it is
                    out, status, n = content, "failed", 0
                if status in ("ast", "regex"):
                    out = f"{COMPRESSED_MARK}\n{out}"
                rows.append((file_id, path, language, status, n, len(content.encode("utf-8", "replace")), len(out.encode("utf-8", "replace")), out))
            yield pd.DataFrame(rows, columns=["file_id", "path", "language", "status", "n_signatures", "original_bytes", "compressed_bytes", "content"])

    source = files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull()).select("file_id", "path", compressor_language(F.col("path")).alias("language"), "content")
    return spread(source, "file_id").mapInPandas(run, "file_id long, path string, language string, status string, n_signatures long, original_bytes long, compressed_bytes long, content string")


def signature_rows(files: DataFrame, engine: str = "auto") -> DataFrame:
    """``file_id, kind, name, source, start_line, end_line`` of each signature of source files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "kind", "name", "source", "start_line", "end_line"]
        for pdf in batches:
            rows = [(i, *s) for i, lang, c in zip(pdf["file_id"], pdf["language"], pdf["content"]) for s in signatures(c, lang, engine)[1]]
            yield pd.DataFrame(rows, columns=columns)

    language = compressor_language(F.col("path"))
    source = files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull() & language.isin(*_SOURCES)).select("file_id", language.alias("language"), "content")
    return spread(source, "file_id").mapInPandas(run, "file_id long, kind string, name string, source string, start_line int, end_line int").distinct()


def declaration_lines(files: DataFrame) -> DataFrame:
    """``file_id, line_no, kind``: lines that open a declaration, by the pattern engine, as built-in expressions.

    First pattern of the language wins; indented lines count in Python only.
    """
    language = compressor_language(F.col("path"))
    source = files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull() & language.isin(*_SOURCES)).select("file_id", language.alias("language"), "content")
    lines = (
        spread(source, "file_id")
        .select("file_id", "language", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
        .where((F.col("language") == "python") | ~F.col("line").rlike(r"^\s"))
    )
    bare = F.when(F.col("language") == "python", F.trim("line")).otherwise(F.col("line"))
    kind = F.lit(None).cast("string")
    for lang in _SOURCES:
        of_language = F.lit(None).cast("string")
        for _, name, pattern in reversed([p for p in SIGNATURE_PATTERNS if p[0] == lang]):
            of_language = F.when(bare.rlike(pattern), F.lit(name)).otherwise(of_language)
        kind = F.when(F.col("language") == lang, of_language).otherwise(kind)
    return lines.select("file_id", (F.col("pos") + 1).alias("line_no"), kind.alias("kind")).where(F.col("kind").isNotNull()).distinct()


def compression_stats(done: DataFrame) -> DataFrame:
    """``language, n_files, n_compressed, original_bytes, compressed_bytes, ratio``; the ratio of nothing is 1."""
    grouped = done.select("file_id", F.coalesce("language", F.lit("unknown")).alias("language"), "status", "original_bytes", "compressed_bytes").distinct().groupBy("language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.col("status").isin("ast", "regex").cast("long")).alias("n_compressed"), F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes")
    )
    return grouped.withColumn("ratio", F.when(F.col("original_bytes") == 0, F.lit(1.0)).otherwise(F.round(F.col("compressed_bytes") / F.col("original_bytes"), 6)))


def compression_savings(stats: DataFrame) -> DataFrame:
    """One row over ``compression_stats``: files, compressed ones, tokens saved and the ratio of all; the ratio of nothing is 1."""
    before, after = F.coalesce(F.sum("original_bytes"), F.lit(0)), F.coalesce(F.sum("compressed_bytes"), F.lit(0))
    return stats.agg(
        F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("n_compressed"), F.lit(0)).alias("n_compressed"), (F.floor(before / 4) - F.floor(after / 4)).cast("long").alias("tokens_saved"),
        F.when(before == 0, F.lit(1.0)).otherwise(F.round(after / before, 6)).alias("ratio"),
    )
