"""Names of the core queries, each with its plan and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contextloom.plans import changes, contents, files, listings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for _module in (files, contents, changes, listings):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
