"""Fitting files to a token budget, in order of tier and path."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.tables import SPLIT_FILE_OVERHEAD, SPLIT_HEADER, TRUNCATED_MARK
from contextloom.operators.ordered import ordered_fold, running_sum

ORDER = ("tier", "path", "file_id")
#: Tokens kept free for the mark of a truncated file.
MARK_TOKENS = 20


def budget_truncate(df: DataFrame, max_tokens: int, group: str = "repo", overhead: int | Column = 0) -> DataFrame:
    """``df`` with ``status``: ``included`` while files fit, ``truncated`` for the first that overflows if room is left, then ``excluded``.

    Each ``group`` has its own budget, less ``overhead`` tokens (a number or a column that is constant in a group)
    for the document around the files. Without a positive limit everything is included. Null tokens count 0.
    ``room`` is what a truncated file may take. As tokens are never negative, the status follows from a running
    sum, which is distributed.
    """
    if max_tokens <= 0:
        return df.withColumn("status", F.lit("included")).withColumn("room", F.lit(None).cast("long"))
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    limit = F.lit(max_tokens) - (F.lit(overhead) if isinstance(overhead, int) else overhead)
    fits, room = F.col("running") <= limit, limit - (F.col("running") - tokens)
    status = F.when(fits, "included").when((room > 0), "truncated").otherwise("excluded")
    return running_sum(df, [group], ORDER, "tokens").withColumn("status", status).withColumn("room", F.when(F.col("status") == "truncated", room).cast("long")).drop("running")


def budget_skip(df: DataFrame, max_tokens: int, group: str = "repo", overhead: int | str = 0) -> DataFrame:
    """``file_id, repo, tier, path, tokens, status``: in order, a file is taken if it still fits; smaller later ones may follow.

    ``overhead`` as for ``budget_truncate``, or the name of a column of ``df``. A fold over narrow rows; see
    ``ordered_fold`` for its memory.
    """
    columns = ["file_id", group, "tier", "path", "tokens", "__left"]
    schema = f"file_id long, {group} string, tier int, path string, tokens long, __left long, status string"
    if max_tokens <= 0:
        return df.select(*columns[:-1]).withColumn("status", F.lit("included"))

    def fold(left: int | None, rows: pd.DataFrame) -> tuple:
        left = int(rows["__left"].iloc[0]) if left is None else left
        need = rows["tokens"].fillna(0).to_numpy(dtype=np.int64)
        taken = np.zeros(len(need), dtype=bool)
        open_ = np.flatnonzero(need <= left)
        while len(open_):  # what is too large now stays so; of the others as many fit as their sum allows
            sums = np.cumsum(need[open_])
            n = int(np.searchsorted(sums, left, side="right"))
            taken[open_[:n]] = True
            left -= int(sums[n - 1]) if n else 0
            open_ = open_[n:][need[open_[n:]] <= left]
        return left, np.where(taken, "included", "excluded")

    limited = df.withColumn("__left", (F.lit(max_tokens) - (F.lit(overhead) if isinstance(overhead, int) else F.col(overhead))).cast("long"))
    return ordered_fold(limited, group, ORDER, lambda: None, fold, schema, columns, "status").drop("__left")


def with_used_tokens(budgeted: DataFrame, cut: DataFrame) -> DataFrame:
    """A budgeted set with ``used``: the tokens that each file takes; of truncated files those of their shortened text.

    ``cut`` has ``file_id, tokens`` of the truncated files, one a group at most.
    """
    recounted = cut.select("file_id", F.col("tokens").alias("__cut"))
    used = F.when(F.col("status") == "excluded", 0).when(F.col("status") == "truncated", F.coalesce("__cut", F.lit(0))).otherwise(F.coalesce("tokens", F.lit(0)))
    return budgeted.join(recounted, "file_id", "left").withColumn("used", used.cast("long")).drop("__cut")


def tier_stats(df: DataFrame, *by: str) -> DataFrame:
    """Per tier of a set with ``used`` tokens: included (truncated ones too) and excluded files, and the tokens they take."""
    taken = F.col("status").isin("included", "truncated")
    return df.groupBy(*by, "tier").agg(F.sum(taken.cast("long")).alias("n_included"), F.sum((~taken).cast("long")).alias("n_excluded"), F.sum("used").alias("tokens_included"))


def truncated_content(df: DataFrame, content: str = "content", room: str = "room", tokens: str = "tokens") -> DataFrame:
    """``df`` with ``content`` cut to its longest run of first lines whose estimate leaves ``MARK_TOKENS`` of ``room``, and marked.

    The mark names the tokens shown and the file's ``tokens``. Prefix sums over the lines' bytes; null content
    or room leaves the content as it is. Where not even the first line fits, the mark stands alone; with little
    room it may exceed it.
    """
    lines = F.split(F.col(content), "\n", -1)
    sizes = F.transform(lines, lambda s: F.octet_length(s).cast("long"))
    most = F.greatest(F.col(room) - MARK_TOKENS, F.lit(0)) * 4 + 3
    start = F.struct(F.lit(-1).cast("long").alias("bytes"), F.lit(0).alias("kept"), F.lit(0).cast("long").alias("kept_bytes"))

    def step(s: Column, n: Column) -> Column:
        total = s["bytes"] + 1 + n
        fits = total <= most
        return F.struct(total.alias("bytes"), (s["kept"] + fits.cast("int")).alias("kept"), F.when(fits, total).otherwise(s["kept_bytes"]).alias("kept_bytes"))

    state = F.aggregate(sizes, start, step)
    counted = df.withColumn("__state", state)
    kept = F.array_join(F.slice(lines, 1, F.col("__state.kept")), "\n")
    mark = F.format_string(TRUNCATED_MARK, F.floor(F.col("__state.kept_bytes") / 4).cast("long"), F.coalesce(F.col(tokens), F.lit(0)).cast("long"))
    shortened = F.when(F.col("__state.kept_bytes") > 0, F.concat(kept, F.lit("\n"), mark)).otherwise(mark)
    return counted.withColumn(content, F.when(F.col(room).isNull() | F.col(content).isNull(), F.col(content)).otherwise(shortened)).drop("__state")


def split_parts(df: DataFrame, tokens_per_part: int, group: str = "repo") -> DataFrame:
    """``file_id, repo, tier, path, tokens, part_no``: ordered files cut into output parts of about ``tokens_per_part``.

    Each file costs an overhead, each part a header (twice for the first). A file larger than a part gets one
    of its own; a file that overflows stays with its predecessor of the same tier and top-level directory up to
    115 % of the room. If everything fits, there is one part.
    """
    if tokens_per_part <= 0:
        raise ValueError("tokens_per_part must be positive")
    first_room, room = tokens_per_part - 2 * SPLIT_HEADER, tokens_per_part - SPLIT_HEADER
    total = df.groupBy(group).agg((F.coalesce(F.sum("tokens"), F.lit(0)) + F.count(F.lit(1)) * SPLIT_FILE_OVERHEAD + 2 * SPLIT_HEADER).alias("whole"))
    joined = df.select("file_id", group, "tier", "path", F.coalesce("tokens", F.lit(0)).alias("tokens")).join(total, group)
    columns = ["file_id", group, "tier", "path", "tokens", "whole"]

    def fold(state: tuple, rows: pd.DataFrame) -> tuple:
        part, filled, used, last = state
        if int(rows["whole"].iloc[0]) <= tokens_per_part:
            return state, np.ones(len(rows), dtype=np.int32)
        cost = rows["tokens"].to_numpy(dtype=np.int64) + SPLIT_FILE_OVERHEAD
        tiers, tops = rows["tier"].to_numpy(), [(p or "").split("/", 1)[0] for p in rows["path"]]
        sums = np.concatenate(([0], np.cumsum(cost)))
        large = np.append(np.flatnonzero(cost > first_room), len(cost))  # may exceed a part's room
        out = np.empty(len(cost), dtype=np.int32)
        k = 0
        while k < len(cost):
            space = first_room if part == 1 else room
            # all files up to the first that overflows, or that may be too large alone, stay in the open part
            end = min(int(np.searchsorted(sums, sums[k] + space - used, side="right")) - 1, int(large[np.searchsorted(large, k)]))
            if end > k:
                out[k:end] = part
                used, filled, last = used + int(sums[end] - sums[k]), filled + end - k, (tiers[end - 1], tops[end - 1])
                k = end
                continue
            here, need = (tiers[k], tops[k]), int(cost[k])
            if need > space:
                part += filled > 0
                out[k] = part
                part, filled, used = part + 1, 0, 0
            else:
                if filled and used + need > space and not (here == last and used + need <= space + space * 15 // 100):
                    part, filled, used = part + 1, 0, 0
                out[k] = part
                filled, used = filled + 1, used + need
            last = here
            k += 1
        return (part, filled, used, last), out

    schema = f"file_id long, {group} string, tier int, path string, tokens long, whole long, part_no int"
    return ordered_fold(joined, group, ORDER, lambda: (1, 0, 0, None), fold, schema, columns, "part_no").drop("whole")
