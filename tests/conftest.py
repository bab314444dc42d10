from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)


FILES = (
    "file_id long, repo string, path string, abs_path string, size long, tier int, token_count long, content_hash string, content string, is_compressed boolean, "
    "redactions int, language string, is_symlink boolean, is_binary boolean, error string, discovered_at timestamp_ntz, ingested_at timestamp_ntz"
)


@pytest.fixture(scope="session")
def make_files(spark):
    """A files table from ``(file_id, repo, path, content)``; the other columns are null."""

    def make(*rows):
        return spark.createDataFrame([(i, r, p, *[None] * 5, c, *[None] * 8) for i, r, p, c in rows], FILES)

    return make
