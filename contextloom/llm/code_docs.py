"""Functions paired with their documentation.

Comment spans and function spans are extracted independently, in order of lines, and meet in an as-of
join: each function takes the nearest comment that ends above it, unless anything stands between.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.functions.code_spans import LANGUAGES, Comment, Function, spans_of
from contextloom.llm.origin_marks import extension
from contextloom.sources.tables import spread

#: A documentation needs so many words that aren't in the function's name.
LEAST_WORDS = 4
_SIGNS = re.compile(r"^[ \t]*(?:/\*+!?|//+[!<]*|\*+/?|#+)?[ \t]*|[ \t]*\*+/[ \t]*$")
_TAG = re.compile(r"^(?:@\w+|\\\w+|:\w+[^:]*:|\{@\w+[^}]*\}\s*$|-{3,}|={3,}|(?:go|nolint|eslint|ts|noinspection|prettier|clang|NOLINT|cspell|pylint|type)[:-]\S*)")
_SECTION = re.compile(r"^(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Throws|Examples?|Notes?|Attributes)\s*:?\s*$|^#+ (?:Arguments|Errors|Panics|Safety|Returns|Examples)\s*$")
_ARGUMENT = re.compile(r"^\s+\w+\s*(?:\([^)]*\))?\s*:|^\s+\*\s+`?\w+`?\s*[-:]|^\s*[-*]\s+`?\w+`?\s*[-:]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
# Notes that only promise a documentation, and texts that tools put in its place.
_TODO = re.compile(r"^\W*(?:todo|fixme|xxx|tbd|hack)\b", re.I)
_STUB = re.compile(
    r"auto-?generated (?:method|constructor|function|catch block)?\s*stub|description of the (?:function|method) goes here|(?:missing|add|insert) (?:a )?description|"
    r"description goes here|document(?:ation)? (?:me|goes here|missing|needed)|write documentation|non-javadoc|\[(?:summary|description)\]|__summary__|_description_|_summary_",
    re.I,
)
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:return|if|for|while|else|def|func|fn|let|const|var|int|auto|import|print)\b.*[(=;:{]|^\s*[\w.\[\]]+\s*(?::?=|\+=|-=)\s*\S|^\s*[\w.:>-]+\([^)]*\)\s*[;:{]?\s*$"
)


def prose_of(doc: str) -> str:
    """The documentation without comment signs, tag lines and sections on arguments."""
    kept, in_section = [], False
    for raw in doc.replace("\r", "").split("\n"):
        line = _SIGNS.sub("", raw)
        stripped = line.strip()
        if not stripped:
            in_section = False
            kept.append("")
            continue
        if _SECTION.match(stripped):
            in_section = True
            continue
        if _TAG.match(stripped) or in_section and (_ARGUMENT.match(" " + line) or raw[:1] in " \t*/"):
            continue
        kept.append(stripped)
    return "\n".join(kept).strip()


def is_trivial(doc: str, name: str) -> bool:
    """Whether a documentation says too little beyond the name, promises only, is a stub's, or is code put aside."""
    prose = prose_of(doc)
    lines = [line for line in prose.split("\n") if line]
    if not lines or _TODO.match(lines[0]) or _STUB.search(prose):
        return True
    if sum(bool(_CODE_LINE.search(line)) for line in lines) * 2 > len(lines):
        return True
    own = {p.lower() for p in _NAME_PART.findall(name)} | {name.lower()}
    return sum(w.lower() not in own for w in _WORD.findall(re.sub(r"\{@\w+\s*([^}]*)\}", r"\1", prose))) < LEAST_WORDS


def documented(comments: list[Comment], functions: list[Function]) -> list[tuple[Function, str]]:
    """Each function with its documentation, by an as-of join of two lists that are ordered by line.

    A function's candidate is the last comment that ends above its anchor; it is rejected if anything,
    also a blank line, stands between. A docstring that the function brings along goes before comments.
    """
    ends = [c.last for c in comments]
    out = []
    for f in functions:
        if f.doc is not None:
            out.append((f, f.doc))
            continue
        nearest = bisect_right(ends, f.anchor - 1) - 1
        if nearest >= 0 and ends[nearest] == f.anchor - 1:
            out.append((f, comments[nearest].text))
    return out


def _pairs(text: str, language: str) -> Iterator[tuple]:
    comments, functions = spans_of(text, language)
    for f, doc in documented(comments, functions):
        if not is_trivial(doc, f.name):
            yield f, doc


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, path, content in zip(pdf["file_id"], pdf["path"], pdf["content"]):
            lines = content.split("\n")
            for f, doc in _pairs(content, LANGUAGES[extension(path)]):
                rows.append((file_id, f.line, f.name, "\n".join(lines[f.start - 1 : f.end]), prose_of(doc)))
        yield pd.DataFrame(rows, columns=["file_id", "fn_line", "fn_name", "code", "description"])


def function_docs(files: DataFrame) -> DataFrame:
    """``file_id, fn_line, fn_name, code, description`` of each documented function, once per delivery of its file.

    Source files of the eight languages are told by their path's ending. The work is per file, so no text is
    shuffled. Functions whose documentation is empty or trivial are dropped. Rows without content, path or
    file_id give none; an empty table gives an empty result.
    """
    endings = "|".join(sorted(LANGUAGES))
    source = files.where(
        F.col("content").isNotNull() & F.col("file_id").isNotNull() & F.lower("path").rlike(rf"\.({endings})$")
    ).select("file_id", "path", "content")
    return spread(source, "file_id").mapInPandas(_extract, "file_id long, fn_line int, fn_name string, code string, description string")


def once(pairs: DataFrame) -> DataFrame:
    """``pairs``, or narrow columns of them, with each function once however often its file was delivered."""
    return pairs.dropDuplicates(["file_id", "fn_line", "fn_name"])
