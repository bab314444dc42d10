"""Shannon entropy and character sets of short strings, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contextloom.functions.tables import ENTROPY_THRESHOLDS, SUSPICIOUS_WORDS

LEAST_CHARS, MOST_CHARS = 16, 256


def shannon_entropy(value: Column) -> Column:
    """Bits per character of the first ``MOST_CHARS`` characters; 0 for strings shorter than ``LEAST_CHARS``; null for null."""
    head = F.substring(value, 1, MOST_CHARS)
    length = F.length(head)
    # what a character's removal takes away is its count
    counts = F.transform(F.array_distinct(F.split(head, "")), lambda c: (length - F.length(F.replace(head, c, F.lit("")))).cast("double"))
    bits = F.log2(length) - F.aggregate(counts, F.lit(0.0), lambda s, n: s + n * F.log2(n)) / length
    return F.when(F.length(value) < LEAST_CHARS, F.lit(0.0)).otherwise(bits)


def charset(value: Column) -> Column:
    """``hex``, ``alphanumeric``, ``base64`` or ``mixed``: the narrowest set that holds the string; ``unknown`` if empty."""
    return (
        F.when(value == "", "unknown")
        .when(value.rlike("^[0-9a-fA-F]+$"), "hex")
        .when(value.rlike("^[0-9A-Za-z]+$"), "alphanumeric")
        .when(value.rlike("^[0-9A-Za-z+/=_-]+$"), "base64")
        .otherwise("mixed")
    )


def is_suspicious(context: Column) -> Column:
    """Whether a name or line mentions secrets."""
    return F.lower(context).rlike("|".join(SUSPICIOUS_WORDS))


def entropy_threshold(kind: Column, suspicious: Column) -> Column:
    """The entropy from which a string of a charset counts as high; half a bit less in a suspicious context."""
    base = F.lit(ENTROPY_THRESHOLDS["mixed"])
    for name, value in ENTROPY_THRESHOLDS.items():
        base = F.when(kind == name, F.lit(value)).otherwise(base)
    return base - F.when(suspicious, 0.5).otherwise(0.0)
