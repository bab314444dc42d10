"""Scalar functions on paths, texts and numbers as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Backslashes become slashes; one leading ``./`` is dropped."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """The directory of a path without the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(?:(.*)/)?[^/]*$", 1)


def top_dir(path: Column) -> Column:
    """The first segment of a path, or the whole of a path without slash."""
    return F.regexp_extract(path, r"^([^/]*)", 1)


def ending(path: Column) -> Column:
    """What follows the last dot of the name, or an empty string."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def lookup(key: Column, table: Mapping[str, str], default: str | None = "") -> Column:
    """A small fixed table as an expression; no join."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(default))


def tokens_floor(n_bytes: Column) -> Column:
    """The estimate without a tokenizer: bytes div 4."""
    return F.floor(n_bytes / 4).cast("long")


def tokens_ceil(n_bytes: Column) -> Column:
    """The estimate of composed documents: (bytes + 3) div 4."""
    return F.floor((n_bytes + 3) / 4).cast("long")


def thousands(n: Column) -> Column:
    """Groups of three digits with commas."""
    return F.format_number(n.cast("long"), 0)


def human_bytes(n: Column) -> Column:
    """Binary units with one decimal from 1 KB on."""
    shown = lambda unit, name: F.format_string(f"%.1f {name}", n / F.lit(float(unit)))
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1 << 20, shown(1 << 10, "KB"))
        .when(n < 1 << 30, shown(1 << 20, "MB"))
        .otherwise(shown(1 << 30, "GB"))
    )


def numbered_lines(content: Column) -> Column:
    """``" 1 | line"``: numbers right-aligned to the width of the last one."""
    lines = F.split(content, "\n", -1)
    width = F.length(F.size(lines).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit(" | "), x)), "\n")


def fenced(content: Column) -> Column:
    """Three backquotes in a text are taken apart, so that they end no fence."""
    return F.replace(content, F.lit("```"), F.lit("`` `"))


def unfenced(content: Column) -> Column:
    return F.replace(content, F.lit("`` `"), F.lit("```"))


def cdata(content: Column) -> Column:
    """A CDATA section; its end mark within the text is split over two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(content, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def xml_attribute(value: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value
