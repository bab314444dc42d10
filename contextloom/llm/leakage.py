"""Evaluation texts that leaked into a training corpus.

1. Both sides are reduced to words, and words to templates: numbers, units and names become typed
   placeholders, told by their own shape, so that nothing depends on how many items there are. A
   placeholder that stands for the same word as one before it in its window points back to it.
2. Every window of ``WINDOW`` words is hashed twice: over its template, and over a flat one that keeps
   names, as texts quoted in another case have lost their shape. The windows of items and documents are
   joined by these hashes. Equal template hashes mean that the slots correspond one to one.
3. The slots are compared: equal ones are a verbatim leak, others the same passage with other parameters.

A bitmap of the items' hashes goes to the executors first, so that of a document only windows that some
item may share are shuffled. Its size is at most ``BITMAP_BITS`` whatever the test's size; where it
fills up, more windows pass and the join still decides.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.sources.tables import spread
from contextloom.storage import materialize

#: Words in a row that make a leak.
WINDOW = 12
#: A window with other parameters must have so many words that are no slots.
FIXED = 8
#: A flat template needs so many words besides numbers and units, else these stay.
FLAT_FIXED = 4
#: The largest bitmap: 16 MB; and its bits per window of an item below that.
BITMAP_BITS, BITS_PER_WINDOW, LEAST_BITS = 1 << 27, 1 << 10, 1 << 15

_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([0-9A-F]{2})(?=[%A-Za-z0-9])|\\[nrtbfv\"'/\\]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"[a-z][A-Z]|[A-Z][A-Z][a-z]")
# Units of measure that follow numbers.
UNITS = frozenset("ms s sec secs second seconds min mins minute minutes h hour hours day days kb mb gb tb kib mib gib bytes byte px percent pct hz khz mhz ghz m km cm mm kg g".split())
# Words that begin sentences; capitals don't make them names.
STARTERS = frozenset(
    "a an and are as at because before but by can could do does every for from given had has have he her his how i if in is it its many much my no not nothing of on once one or our she should since "
    "so some that the their then there these they this those to under until was we were what when where which while who whose why will with without would you your".split()
)
_FIXED, _NUM, _UNIT, _NAME = 0, 1, 2, 3
_KIND = np.uint64(3)
_FLAT_SEED, _SHAPE_SEED, _WORD_SEED = np.uint64(11), np.uint64(23), np.uint64(47)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_KNOWN_WORDS = 1 << 18
#: Characters of texts that are taken apart in one go; it bounds memory, a longer text goes alone.
BATCH_CHARS = 1 << 21


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2) or m.group(3)
    return chr(int(code, 16)) if code else " "


def cased_words(text: str) -> list[str]:
    """The text's words as written, without markup, entities, escapes, quote and comment signs, and breaks."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text or "%" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text)


def words_of(text: str) -> list[str]:
    """``cased_words`` in lower case."""
    return [w.lower() for w in cased_words(text)]


def word_kind(word: str) -> int:
    """What a word would be in a template by its own shape; a unit is one only behind a number."""
    if word[0].isdigit():
        return _NUM
    if word.lower() in UNITS:
        return _UNIT
    if any(map(str.isdigit, word)) or _HUMP.search(word):
        return _NAME
    return _NAME if len(word) > 1 and word[0].isupper() and word[1:].islower() and word.lower() not in STARTERS else _FIXED


class _Codes(dict):
    """By word as written: the hash of its lower case, and in the last two bits its kind."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word.lower()) & ~3 | word_kind(word)
        return code


_codes = _Codes()


def _hash(columns: Iterator[np.ndarray], n: int, seed: np.uint64) -> np.ndarray:
    h = np.full(n, seed, dtype=np.uint64)
    for column in columns:
        h = (h ^ column) * _MULT
        h ^= h >> np.uint64(31)
    return h


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, flat, shape, words)`` of every window of the texts: the text's number and three hashes.

    ``flat`` is over the template that keeps names, ``words`` over the words themselves. ``shape`` is over
    the template with all placeholders; it is 0 for windows with fewer than ``FIXED`` other words or without
    placeholders. Texts shorter than a window have none.
    """
    words = [cased_words(t) for t in texts]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    total = int(lengths.sum())
    code = np.fromiter((_codes[w] for of in words for w in of), dtype=np.uint64, count=total)
    owner = np.repeat(np.arange(len(texts)), lengths)
    n = total - WINDOW + 1
    if n <= 0:
        none = np.empty(0, dtype=np.uint64)
        return none.astype(np.int64), none, none, none
    low, kind = code & ~_KIND, (code & _KIND).astype(np.int8)
    numbers = np.flatnonzero(kind == _UNIT)
    lone = numbers[(numbers == 0) | (kind[numbers - 1] != _NUM) | (owner[numbers] != owner[numbers - 1])]
    kind[lone] = _FIXED
    # how far back the same word last filled a slot
    slots = np.flatnonzero(kind != _FIXED)
    back = np.zeros(total, dtype=np.int64)
    if len(slots) > 1:
        order = slots[np.lexsort((slots, low[slots]))]
        same = low[order[1:]] == low[order[:-1]]
        back[order[1:][same]] = (order[1:] - order[:-1])[same]
    sign = kind.astype(np.uint64)
    numeric, slot = (kind == _NUM) | (kind == _UNIT), kind != _FIXED

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[WINDOW:] - sums[:-WINDOW]

    few_slots = count(numeric) <= WINDOW - FLAT_FIXED
    n_slots = count(slot)

    def symbols(mask: np.ndarray, allowed: np.ndarray | None) -> Iterator[np.ndarray]:
        for k in range(WINDOW):
            here, far = mask[k : k + n], back[k : k + n]
            if allowed is not None:
                here = here & allowed
            yield np.where(here, sign[k : k + n] + np.uint64(4) * np.where(far <= k, far, 0).astype(np.uint64), low[k : k + n])

    shape = _hash(symbols(slot, None), n, _SHAPE_SEED)
    shape[(n_slots > WINDOW - FIXED) | (n_slots == 0)] = 0
    flat = _hash(symbols(numeric, few_slots), n, _FLAT_SEED)
    plain = _hash((low[k : k + n] for k in range(WINDOW)), n, _WORD_SEED)
    whole = owner[:n] == owner[WINDOW - 1 :]
    return owner[:n][whole], flat[whole], shape[whole], plain[whole]


def _slices(texts: pd.Series) -> Iterator[slice]:
    """Consecutive texts of about ``BATCH_CHARS`` together."""
    begin = held = 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= BATCH_CHARS:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _rows(ids: pd.Series, texts: pd.Series, passes=None) -> Iterator[pd.DataFrame]:
    """``id, key, words`` of the windows of texts, for both templates; each once per text."""
    for part in _slices(texts):
        owner, flat, shape, plain = windows(list(texts.iloc[part]))
        owner, key, plain = np.concatenate((owner, owner)), np.concatenate((flat, shape)), np.concatenate((plain, plain))
        keep = key != 0
        if passes is not None:
            keep &= passes(key)
        rows = pd.DataFrame({"id": ids.iloc[part].to_numpy()[owner[keep]], "key": key[keep].view(np.int64), "words": plain[keep].view(np.int64)})
        yield rows.drop_duplicates()


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, key, words`` of all windows of all questions and answers."""
    texts = items.where("item_id IS NOT NULL").select("item_id", F.explode(F.array("question", "expected_answer")).alias("text")).where("text IS NOT NULL")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _rows(pdf["item_id"], pdf["text"]):
                yield rows.rename(columns={"id": "item_id"})

    return texts.mapInPandas(read, "item_id long, key long, words long").distinct()


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of all keys, as bytes; built by partial aggregates, at most ``BITMAP_BITS`` long."""
    n = keys.count()
    bits = min(BITMAP_BITS, max(LEAST_BITS, 1 << max(0, n * BITS_PER_WINDOW - 1).bit_length()))
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    parts = keys.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        chunk = np.frombuffer(bytes(row.bits), dtype=np.uint8)
        start = (row.part - 1) * len(chunk)
        out[start : start + len(chunk)] = chunk
    return out


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, how``: documents that hold ``WINDOW`` words in a row of an item's question or answer.

    ``how`` is ``verbatim``, or ``renamed`` if the words are the item's but for numbers, units and names, which
    correspond one to one, ``FIXED`` words at least being no such slots. All items that hold the passage are
    named. Passages of items shorter than the window can't leak by this measure. Null and empty texts on
    either side match nothing; repeated rows give one row; further columns are ignored.
    """
    spark = documents.sparkSession
    known = materialize(item_windows(items), "item-windows")
    bitmap = spark.sparkContext.broadcast(key_bitmap(known.select("key").distinct()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap.value
        mask = np.uint64(len(bits) * 8 - 1)

        def passes(key: np.ndarray) -> np.ndarray:
            place = key & mask
            return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for pdf in batches:
            for rows in _rows(pdf["doc_id"], pdf["text"], passes):
                yield rows.rename(columns={"id": "doc_id"})

    source = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    met = spread(source, "doc_id").mapInPandas(scan, "doc_id long, key long, words long")
    same = (F.col("words") == F.col("item_words")).cast("int")
    pairs = met.join(known.withColumnRenamed("words", "item_words"), "key").groupBy("doc_id", "item_id").agg(F.max(same).alias("same"))
    return pairs.select("doc_id", "item_id", F.when(F.col("same") == 1, "verbatim").otherwise("renamed").alias("how"))
