from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from contextloom.functions.tokenizers import counter, token_count

FOLDER = "/opt/tokenizers"


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path = f"{FOLDER}/{name}"
    if not os.path.exists(path):
        pytest.skip("no vocabularies here")
    rows = spark.createDataFrame([("hello world",), ("",), (None,), ("naïve <|endoftext|> text",)], "t string").select(token_count(F.col("t"), path).alias("n")).collect()
    assert rows[0].n in (2, 3) and rows[1].n == 0 and rows[2].n is None and rows[3].n > 4


def test_two_libraries_agree():
    if not os.path.exists(FOLDER):
        pytest.skip("no vocabularies here")
    texts = ["def f(x):\n    return x + 1\n", "plain words, and 1234 numbers", "a  b\n\n c"]
    assert counter(f"{FOLDER}/byte_bpe_50k.json")(texts) == counter(f"{FOLDER}/byte_bpe_50k.tiktoken")(texts)


def test_estimate_and_unknown(spark):
    assert spark.range(1).select(token_count(F.lit("12345678"))).first()[0] == 2
    with pytest.raises(ValueError):
        counter("/x/y.bin")
