"""Structural checks of matches."""

from __future__ import annotations

from pyspark.sql import Column


def is_token_of_three(match: Column) -> Column:
    """Three parts between dots, none of them empty."""
    return match.rlike(r"^[^.]+\.[^.]+\.[^.]+$")


def is_access_key_id(match: Column) -> Column:
    """Twenty bytes that begin with a known prefix."""
    return match.rlike(r"^(?:(?:AKIA|ASIA|ABIA|ACCA)(?s:.){16}|A3T(?s:.){17})$")
