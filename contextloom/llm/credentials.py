"""Credentials embedded in files of any kind: found with file and line, and masked.

Token formats, key armor, connection strings and the words that announce a credential are one
deterministic automaton. The texts of an Arrow batch are scanned by it in chunks whose walks reach on
into the next, finds are kept by absolute span, and placeholders are spliced in. The work is per file:
no shuffle moves any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.credential_grammar import find_in_texts, line_of, line_starts, redact
from contextloom.llm.origin_marks import extension
from contextloom.sources.tables import spread

# Endings of files in which a bare word after ``=`` is a variable.
PROGRAM_ENDINGS = frozenset("go py java ts tsx js jsx mjs cjs c h cc cpp cxx hpp rs kt scala swift cs php rb".split())


def _spans(pdf: pd.DataFrame) -> list:
    return find_in_texts(list(pdf["content"]), [extension(p or "") in PROGRAM_ENDINGS for p in pdf["path"]])


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "line_no", "secret_type", "start", "end"]
    for pdf in batches:
        rows = []
        for file_id, content, spans in zip(pdf["file_id"], pdf["content"], _spans(pdf)):
            starts = line_starts(content) if spans else []
            rows += [(file_id, line_of(starts, s.start), s.kind, s.start, s.end) for s in spans]
        yield pd.DataFrame(rows, columns=columns)


def credential_spans(files: DataFrame) -> DataFrame:
    """``file_id, line_no, secret_type, start, end``: each literal credential once per file.

    Lines count from 1; ``start`` and ``end`` are offsets in characters. Files delivered again give their
    spans once. Rows without content or file_id give nothing; an empty table gives an empty result;
    further columns are ignored.
    """
    source = files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull()).select("file_id", "path", "content")
    return spread(source, "file_id").mapInPandas(_find, "file_id long, line_no int, secret_type string, `start` long, `end` long").distinct()


def redacted_files(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` masked and the true number of masked spans as ``found_redactions``.

    Everything around a span stays as it is, line ends inside it too, so that line numbers hold. A null
    content stays null with 0 finds.
    """

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = _spans(pdf)
            pdf["content"], pdf["found_redactions"] = [redact(c, s) for c, s in zip(pdf["content"], found)], [len(s) for s in found]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != "found_redactions")
    return files.drop("found_redactions").mapInPandas(mask, f"{schema}, found_redactions long")
