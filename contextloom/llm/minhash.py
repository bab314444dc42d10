"""MinHash signatures over shingles of five words, and banded buckets of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = 5
ROWS = 4
BANDS = 16
SLOTS = ROWS * BANDS
_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.iinfo(np.uint64).max
#: Probe order for slots that no shingle fell into; the same for every text, so equal texts stay equal.
_PROBES = np.random.default_rng(61).integers(0, SLOTS, (4 * SLOTS, SLOTS))
#: Characters of text that are hashed in one go, and words that are remembered; both bound memory.
_BATCH_CHARS = 1 << 21
_KNOWN_WORDS = 1 << 18


class _Known(dict):
    """32-bit hash by word, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh32_intdigest(word)
        return h


_known = _Known()


def _signatures(texts: list[str]) -> np.ndarray:
    """One row of slots per text; the rows of texts without words hold ``_EMPTY`` only."""
    tokens = [_WORD.findall(t) for t in texts]
    pad = WORDS - 1
    lengths = np.array([len(t) for t in tokens], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + pad)))
    h = np.zeros(int(starts[-1]) + pad, dtype=np.uint64)
    for t, start in zip(tokens, starts):
        if t:
            h[start : start + len(t)] = np.fromiter(map(_known.__getitem__, t), dtype=np.uint64, count=len(t))
    best = np.full((len(texts), SLOTS), _EMPTY, dtype=np.uint64)
    n = len(h) - pad
    if n <= 0:
        return best
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(WORDS):
        mixed = (mixed ^ (h[k : k + n] * _MIX[k])) * _SPREAD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _SPREAD
    owner = np.repeat(np.arange(len(texts)), lengths + pad)
    place = np.arange(n) - starts[:-1][owner]
    whole = place < np.maximum(np.minimum(lengths, 1), lengths - pad)[owner]
    mixed, owner = mixed[whole], owner[whole]
    slot = owner * SLOTS + (mixed >> np.uint64(58)).astype(np.int64)
    np.minimum.at(best.reshape(-1), slot, mixed & np.uint64(0xFFFFFFFF))
    filled = best != _EMPTY
    if not filled.all():
        source, rows = best.copy(), np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
        for probe in _PROBES:
            todo = best[rows] == _EMPTY
            if not todo.any():
                break
            offered = source[rows][:, probe]
            best[rows] = np.where(todo, offered, best[rows])
        for r in np.flatnonzero((best == _EMPTY).any(axis=1) & filled.any(axis=1)):
            best[r][best[r] == _EMPTY] = source[r].min()
    return best


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, as ``signatures`` sees them."""
    tokens = _WORD.findall(text or "")
    if not tokens:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(len(tokens) + WORDS - 1, dtype=np.uint64)
    h[: len(tokens)] = np.fromiter(map(_known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    mixed = np.zeros(len(tokens), dtype=np.uint64)
    for k in range(WORDS):
        mixed = (mixed ^ (h[k : k + len(tokens)] * _MIX[k])) * _SPREAD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _SPREAD
    return np.unique(mixed[: max(1, len(tokens) - WORDS + 1)]).view(np.int64)


def signatures(texts: list[str | None]) -> list[np.ndarray | None]:
    """One-permutation MinHash of each text with ``SLOTS`` slots; None for texts that are null or have no word.

    A shingle of five words (a shorter text is one shingle) falls into the slot its upper bits name and
    competes there with its lower bits. Empty slots borrow from the first filled slot of a fixed probe
    order, so two texts agree in a slot with about the probability of their shingles' Jaccard similarity.
    """
    out: list[np.ndarray | None] = []
    batch: list[str] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if batch:
            out.extend(None if row[0] == _EMPTY else row for row in _signatures(batch))
            batch.clear()
            held = 0

    for text in texts:
        batch.append(text or "")
        held += len(batch[-1])
        if held >= _BATCH_CHARS:
            flush()
    flush()
    return out
