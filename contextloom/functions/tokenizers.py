"""Token counts by a public tokenizer's vocabulary file, behind one column function.

The file's path is a parameter and has to be readable on every executor; nothing is downloaded. Without a
path the estimate of four bytes a token is used.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts; the library is told by the file's ending. Loaded once per worker."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        # the vocabulary's own split pattern is part of its definition; this is the common byte-level one
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    raise ValueError(f"unknown kind of vocabulary file: {path}")


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text; 0 for an empty one, null for null."""
    if not path:
        return F.floor(F.octet_length(text) / 4).cast("long")

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        counted = iter(counter(path)([t for t in texts if t is not None]))
        return pd.Series([None if t is None else next(counted) for t in texts], dtype="Int64")

    return count(text)
