"""Splitting oversized files at natural boundaries, with overlap.

1. Which files of which runs are too long follows from lengths alone. Their distinct (file, limit, overlap)
   meet the contents in one join, so that every result depends on its own run only; where the optimizer
   finds the settings small it broadcasts them, else a long text is shuffled once.
2. A file's boundaries (starts of functions, paragraphs, lines) are read once, however many limits it
   has; within lines that are longer than a limit allows, places after spaces or, failing those, between
   characters are added for that limit. Every boundary is joined to its farthest legal successor: the end
   of the longest piece that may begin there, overlap included, of the strongest kind that fills at least
   ``FILL`` of the room.
3. Squaring the successor table doubles the reach of every boundary, and with it the known part of the
   path from the file's start, so that all cuts are found in a logarithmic number of vectorised steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a token, by the estimate that needs no tokenizer.
TOKEN_BYTES = 4
#: A stronger kind of boundary is preferred if the piece is filled this far.
FILL = 0.5
LINE_PART, LINE, PARAGRAPH, BLOCK = 0, 1, 2, 3
#: A longer line is no declaration that begins a block.
HEAD_BYTES = 400
_TOP_LEVEL = re.compile(
    rb"(?:[ \t]*(?:pub(?:\([^)]*\))?|export|default|async|static|public|private|protected|final|abstract|unsafe|inline|extern|const)[ \t]+)*[ \t]*(?:func|fn|def|class|interface|struct|enum|impl|trait|type|function|module|namespace|template|#{1,6})[ \t]|[A-Za-z_][\w:<>,*& \t]*\([^;]*\{[ \t]*\r?$|\S.*\{[ \t]*\r?$"
)
_LEAD = re.compile(rb"[ \t]*(?://|/\*|\*|#|@|\"\"\")")


def line_boundaries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the lines of a UTF-8 text, 0 first, and the kind of boundary that each is."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    at = np.concatenate(([0], ends)).astype(np.int64)
    if at[-1] == len(raw) and len(at) > 1:
        at = at[:-1]
    kinds = np.full(len(at), LINE, dtype=np.int8)
    stops = np.append(at[1:], len(raw))
    blank_before, doc_start = True, -1
    for k in range(len(at)):
        line = raw[at[k] : stops[k]]
        if not line.strip():
            blank_before, doc_start = True, -1
            continue
        if blank_before:
            kinds[k] = PARAGRAPH
        if _LEAD.match(line):
            if doc_start < 0:
                doc_start = k
        else:
            if len(line) <= HEAD_BYTES and _TOP_LEVEL.match(line):
                kinds[doc_start if doc_start >= 0 else k] = BLOCK
            doc_start = -1
        blank_before = False
    return at, kinds


def with_line_parts(raw: bytes, at: np.ndarray, kinds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries of lines, the text's end, and places within lines so that no two are more than ``step`` (at least 4) bytes apart."""
    stops = np.append(at[1:], len(raw))
    extra: list[int] = []
    for k in np.flatnonzero(stops - at > step):
        here, stop = int(at[k]), int(stops[k])
        while stop - here > step:
            cut = here + step
            space = max(raw.rfind(b" ", here + step // 2, cut), raw.rfind(b";", here + step // 2, cut), raw.rfind(b",", here + step // 2, cut))
            cut = space + 1 if space > here else cut
            while cut > here + 1 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            extra.append(cut)
            here = cut
    offsets = np.concatenate((at, np.array(extra, dtype=np.int64)))
    kinds = np.concatenate((kinds, np.full(len(extra), LINE_PART, dtype=np.int8)))
    order = np.argsort(offsets, kind="stable")
    offsets, kinds = offsets[order], kinds[order]
    if offsets[-1] != len(raw):
        return np.append(offsets, len(raw)), np.append(kinds, np.int8(BLOCK))
    kinds[-1] = BLOCK
    return offsets, kinds


def room_of(max_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    """``(limit, repeated)`` in bytes of one piece and of what it repeats; a repeat may begin up to three bytes early, at a character."""
    return TOKEN_BYTES * max_tokens + TOKEN_BYTES - 1, TOKEN_BYTES * overlap_tokens + TOKEN_BYTES - 1 if overlap_tokens else 0


def cuts(raw: bytes, lines: tuple[np.ndarray, np.ndarray], max_tokens: int, overlap_tokens: int) -> np.ndarray:
    """The byte offsets at which a text is cut, 0 and its end included, for one limit and overlap below it."""
    limit, repeated = room_of(max_tokens, overlap_tokens)
    # of the room that the overlap leaves, a quarter is always in reach
    offsets, kinds = with_line_parts(raw, *lines, max(TOKEN_BYTES, (limit - repeated) // 4))
    return offsets[greedy_cuts(successors(offsets, kinds, limit, repeated))]


def successors(offsets: np.ndarray, kinds: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For each boundary the index of the boundary at which a piece ends that goes on from there.

    A piece has at most ``limit`` bytes; one that doesn't begin at 0 holds ``overlap`` bytes from before its
    boundary. The last boundary is its own successor. Where not even the next boundary is in reach, it is
    taken nevertheless, so that nothing is lost.
    """
    n = len(offsets)
    room = np.full(n, limit - overlap, dtype=np.int64)
    room[0] = limit
    reach = np.searchsorted(offsets, offsets + room, side="right") - 1
    reach = np.maximum(reach, np.minimum(np.arange(n) + 1, n - 1))
    best, undecided = reach.copy(), reach < n - 1
    least = offsets + (room * FILL).astype(np.int64)
    for kind in (BLOCK, PARAGRAPH, LINE):
        of_kind = np.flatnonzero(kinds >= kind)
        candidate = of_kind[np.maximum(np.searchsorted(of_kind, reach, side="right") - 1, 0)]
        take = undecided & (candidate > np.arange(n)) & (candidate <= reach) & (offsets[candidate] >= least)
        best[take] = candidate[take]
        undecided &= ~take
    return best


def greedy_cuts(successor: np.ndarray) -> np.ndarray:
    """Indices of the boundaries on the path from the first to the last, by pointer doubling."""
    path, last = np.array([0], dtype=np.int64), len(successor) - 1
    table = successor
    while path[-1] != last:
        path = np.concatenate((path, table[path]))
        table = table[table]
    return np.unique(path)


def oversized(files: DataFrame, runs: DataFrame, run_files: DataFrame) -> DataFrame:
    """``run_id, file_id, n_bytes, max_tokens, overlap_tokens`` of the files of runs that exceed their run's limit.

    Runs without a positive limit split nothing. Any overlap below the limit holds; one that leaves no room is
    cut to the limit less one token, a null or negative one is 0. Rows delivered again count once; the content
    decides, not any claim. Of deliveries that differ the longest counts.
    """
    lengths = files.where(F.col("content").isNotNull()).select("file_id", F.octet_length("content").cast("long").alias("n_bytes")).groupBy("file_id").agg(F.max("n_bytes").alias("n_bytes"))
    overlap = F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0))
    limits = (
        runs.where(F.col("max_tokens") > 0)
        .groupBy("run_id")
        .agg(F.max(F.struct(F.col("max_tokens").cast("long").alias("max_tokens"), overlap.cast("long").alias("overlap_tokens"))).alias("s"))
        .select("run_id", "s.max_tokens", F.least(F.col("s.overlap_tokens"), F.col("s.max_tokens") - 1).alias("overlap_tokens"))
    )
    members = run_files.where("run_id IS NOT NULL AND file_id IS NOT NULL").select("run_id", "file_id").distinct()
    return members.join(limits, "run_id").join(lengths, "file_id").where(F.expr(f"n_bytes div {TOKEN_BYTES} > max_tokens")).select("run_id", "file_id", "n_bytes", "max_tokens", "overlap_tokens")


def file_pieces(files: DataFrame, big: DataFrame, *, texts: bool = False) -> DataFrame:
    """``file_id, max_tokens, overlap_tokens, piece_no, n_pieces, cut_start, cut_end`` (with ``texts`` also ``text, n_repeated``): the pieces of ``big`` files.

    Each file is cut once per distinct limit and overlap, however many runs share them. A piece repeats the
    ``overlap_tokens`` before its ``cut_start`` (none for the first piece) and ends at ``cut_end``; both are
    byte offsets, so the cut parts of a file add up to its content. ``n_repeated`` is the repeat's size in bytes.
    """
    settings = big.select("file_id", "n_bytes", "max_tokens", "overlap_tokens").distinct()
    # only a filter before the join: no file up to the smallest limit can be among the settings
    least = settings.agg(F.min("max_tokens").alias("t")).first()["t"]
    columns = ["file_id", "max_tokens", "overlap_tokens", "piece_no", "n_pieces", "cut_start", "cut_end"] + ["text", "n_repeated"] * texts

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, raw, lines = None, b"", None
        for pdf in batches:
            rows = []
            for file_id, most, overlap, content in zip(pdf["file_id"], pdf["max_tokens"], pdf["overlap_tokens"], pdf["content"]):
                if content is not last:
                    fresh = content.encode("utf-8", "surrogatepass")
                    if fresh != raw or lines is None:
                        raw, lines = fresh, line_boundaries(fresh)
                    last = content
                path = cuts(raw, lines, most, overlap).tolist()
                for n, (start, end) in enumerate(zip(path, path[1:]), 1):
                    row = (file_id, most, overlap, n, len(path) - 1, start, end)
                    if texts:
                        begin = max(0, start - TOKEN_BYTES * overlap) if n > 1 else 0
                        while begin > 0 and raw[begin] & 0xC0 == 0x80:
                            begin -= 1
                        row += (raw[begin:end].decode("utf-8", "replace"), start - begin)
                    rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    source = files.where(F.col("content").isNotNull() & (F.octet_length("content") > TOKEN_BYTES * (least or 1)))
    joined = source.select("file_id", "content", F.octet_length("content").cast("long").alias("n_bytes")).join(settings, ["file_id", "n_bytes"])
    schema = "file_id long, max_tokens long, overlap_tokens long, piece_no long, n_pieces long, cut_start long, cut_end long" + ", text string, n_repeated long" * texts
    pieces = joined.select("file_id", "max_tokens", "overlap_tokens", "content").mapInPandas(cut, schema)
    return pieces.dropDuplicates(["file_id", "max_tokens", "overlap_tokens", "piece_no"])


def run_pieces(files: DataFrame, runs: DataFrame, run_files: DataFrame) -> DataFrame:
    """``run_id, file_id, piece_no, n_pieces, cut_start, cut_end, overlap_tokens`` of every oversized file of every run.

    Empty tables, files without content and runs without limit give no rows; further columns are ignored.
    """
    big = oversized(files, runs, run_files)
    pieces = file_pieces(files, big)
    keys = ["file_id", "max_tokens", "overlap_tokens"]
    return big.select("run_id", *keys).join(pieces, keys).select("run_id", "file_id", "piece_no", "n_pieces", "cut_start", "cut_end", "overlap_tokens")
