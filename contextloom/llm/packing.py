"""Filling fixed-capacity containers with items, by non-negative least squares over the length histogram.

1. Lengths are counted; the histogram has at most ``LENGTHS`` entries, whatever the number of items.
2. Shallow combinations (one to three distinct lengths, some repeated) that fill a window below the
   capacity are enumerated, and non-negative least squares gives how often to use each so that their sum
   meets the histogram. Counts are rounded, what is left is enumerated and solved again, and the residual
   lengths are packed greedily, largest first, again as repeated combinations. Several windows are solved
   and the plan with the fewest containers is kept.
3. Every item is ranked among the items of its length and takes the place its rank points to. A length is
   split by as many salts as it has items for, so a length that a third of all items have is no hot task.
   Parts that fill a container alone aren't planned: their texts are ranked by a running sum.

A separator is lost between two items: with ``c`` capacity and ``s`` separator, items of ``length + s`` go
into containers of ``c + s``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contextloom.storage import materialize

#: Items of one length that are ranked in one group.
GROUP_ITEMS = 50_000
#: What is tried: the share of the capacity that a combination may leave unused, and how often the rest is solved again.
ATTEMPTS = ((0.0, 2), (0.005, 3))
#: A plan with at most this share of containers above the lower bound is not tried to be bettered.
CLOSE = 0.0005
#: Combinations per length, times lengths.
PATTERNS = 30_000
NNLS_STEPS = 150
#: Distinct lengths that are planned; lengths of larger containers are rounded up to as many steps, which always fits.
LENGTHS = 1 << 16

Pattern = tuple[tuple[int, int], ...]


def combinations(sizes: np.ndarray, capacity: int, window: float = 0.0) -> list[Pattern]:
    """Combinations ``((size, repeats), ...)`` of up to three distinct sizes that leave at most ``window`` of the capacity unused."""
    least = capacity - int(capacity * window)
    present = [int(s) for s in sizes if s > 0]
    spread = min(48, max(4, PATTERNS // max(1, len(present))))
    found: dict[Pattern, None] = {}

    def largest_within(room: int) -> int:
        k = bisect_right(present, room)
        return present[k - 1] if k else 0

    def add(*parts: tuple[int, int]) -> None:
        merged: dict[int, int] = {}
        for size, times in parts:
            if size and times:
                merged[size] = merged.get(size, 0) + times
        if least <= sum(s * t for s, t in merged.items()) <= capacity:
            found[tuple(sorted(merged.items(), reverse=True))] = None

    for size in present:
        most = capacity // size
        for times in sorted({1, 2, 3, most // 2, most - 1, most} - {0, -1}):
            if times > most:
                continue
            room = capacity - times * size
            add((size, times))
            smaller = bisect_right(present, room)
            if not smaller:
                continue
            seconds = {largest_within(room // more) for more in (1, 2, 3)} - {0}
            if times <= 2:  # few large items leave room for many mixes
                seconds |= {present[k * (smaller - 1) // max(1, spread - 1)] for k in range(spread)}
            for second in seconds:
                for more in {1, min(3, room // second)}:
                    add((size, times), (second, more))
                    add((size, times), (second, more), (largest_within(room - more * second), 1))
    return list(found)


def non_negative_least_squares(patterns: list[Pattern], counts: dict[int, int]) -> np.ndarray:
    """How often to use each pattern so that the squared misses of the histogram are least; accelerated projected gradient."""
    if not patterns:
        return np.empty(0)
    place = {size: k for k, size in enumerate(sorted(counts))}
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([place[s] for p in patterns for s, _ in p])
    value = np.array([t for p in patterns for _, t in p], dtype=float)
    target = np.array([counts[s] for s in sorted(counts)], dtype=float)
    n, m = len(patterns), len(target)
    # rows and columns are balanced, so that one step size suits rare and common sizes alike
    load = np.bincount(row, value * value, m)
    scale = 1.0 / np.sqrt(np.bincount(column, value * value / np.maximum(load[row], 1e-9), n))
    weight = 1.0 / np.sqrt(np.maximum(load, 1e-9))
    entry = value * scale[column] * weight[row]
    goal = target * weight
    v = np.full(n, 1.0 / np.sqrt(n))
    for _ in range(12):
        v = np.bincount(column, entry * np.bincount(row, entry * v[column], m)[row], n)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    step = 1.0 / max(norm * 1.05, 1e-9)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(NNLS_STEPS):
        miss = np.bincount(row, entry * y[column], m) - goal
        new = np.maximum(0.0, y - step * np.bincount(column, entry * miss[row], n))
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / faster * (new - x)
        x, t = new, faster
    return x * scale


def _greedy(counts: dict[int, int], capacity: int) -> Iterator[tuple[Pattern, int]]:
    """Largest first: each round's combination is repeated as often as its sizes last."""
    sizes = sorted(s for s, n in counts.items() if n > 0)
    while sizes:
        used: dict[int, int] = {}
        room, k = capacity, len(sizes)
        while k:
            k = bisect_right(sizes, room, 0, k)
            if not k:
                break
            size = sizes[k - 1]
            times = min(room // size if size else counts[size], counts[size] - used.get(size, 0))
            if times > 0:
                used[size] = used.get(size, 0) + times
                room -= size * times
            k -= 1
        repeats = min(counts[s] // t for s, t in used.items())
        yield tuple(sorted(used.items(), reverse=True)), repeats
        for s, t in used.items():
            counts[s] -= t * repeats
            if not counts[s]:
                sizes.remove(s)


def _solved(left: dict[int, int], capacity: int, window: float, rounds: int) -> list[tuple[Pattern, int]]:
    """One plan: least squares over the window's combinations, again over what rounding leaves, then greedily."""
    left, plan = dict(left), []
    for turn in range(rounds):
        patterns = combinations(np.array(sorted(s for s, n in left.items() if n)), capacity, window)
        wanted = non_negative_least_squares(patterns, {s: n for s, n in left.items() if n})
        before = len(plan)
        for k in np.argsort(-wanted, kind="stable"):
            times = int(wanted[k] + (0.5 if turn == rounds - 1 else 0))
            if times < 1:
                break
            times = min(times, *(left[s] // t for s, t in patterns[k]))
            if times:
                plan.append((patterns[k], times))
                for s, t in patterns[k]:
                    left[s] -= t * times
        if len(plan) == before:
            break
    plan.extend(_greedy({s: n for s, n in left.items() if n}, capacity))
    return plan


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Combinations of sizes, each with its number of containers, that take up the histogram exactly.

    The best of ``ATTEMPTS``, up to one that comes ``CLOSE`` to the lower bound, and of the greedy packing alone, so
    never more containers than largest first.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if not left:
        return []
    containers = lambda plan: sum(n for _, n in plan)
    least = -(-sum(s * n for s, n in left.items()) // capacity)
    plans = [list(_greedy(dict(left), capacity))]
    for window, rounds in ATTEMPTS:
        plans.append(_solved(left, capacity, window, rounds))
        if containers(plans[-1]) <= least * (1 + CLOSE) + 1:
            break
    return min(reversed(plans), key=containers)


class Places:
    """From a size and a rank among the items of that size to a container's number."""

    def __init__(self, plan: list[tuple[Pattern, int]]):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        base = 0
        for pattern, containers in plan:
            for size, times in pattern:
                start = taken.get(size, 0)
                runs.setdefault(size, []).append((start, base, times))
                taken[size] = start + times * containers
            base += containers
        self.containers = base
        self.runs = {size: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for size, rows in runs.items()}

    def locate(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        out = np.empty(len(sizes), dtype=np.int64)
        for size in np.unique(sizes):
            here = sizes == size
            starts, bases, times = self.runs[int(size)]
            k = np.searchsorted(starts, ranks[here], side="right") - 1
            out[here] = bases[k] + (ranks[here] - starts[k]) // times[k]
        return out


def item_sizes(documents: DataFrame) -> DataFrame:
    """``doc_id, tokens`` of every document with a text, counted once per id; a token is four bytes of UTF-8."""
    tokens = F.expr("octet_length(text) div 4")
    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", tokens.alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def _salt(n) -> Column:
    """The group of a row among the ``n`` of its kind: one group per ``GROUP_ITEMS``."""
    return F.pmod(F.xxhash64("doc_id"), F.ceil(n / GROUP_ITEMS)).cast("int").alias("salt")


def _ranked(rows: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` (with ``salt``) with ``before``: the sum of ``weight`` over the rows before it among those of its ``keys``, by salt, then doc_id."""
    groups = rows.groupBy(*keys, "salt").agg(F.sum(weight).alias("w"))
    offsets = groups.select(*keys, "salt", (F.sum("w").over(W.partitionBy(*keys).orderBy("salt")) - F.col("w")).alias("offset"))  # one row a group
    within = F.sum(weight).over(W.partitionBy(*keys, "salt").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)) - F.col(weight)
    return rows.withColumn("within", within).join(offsets, [*keys, "salt"]).select(*rows.columns, (F.col("offset") + F.col("within")).alias("before"))


def _fill(sizes: DataFrame, name: str, capacity: int, separator: int) -> DataFrame:
    whole = F.floor(F.col("tokens") / F.lit(capacity)).cast("long")
    parts = sizes.select("doc_id", whole.alias("n_full"), (F.col("tokens") - whole * capacity).alias("rest"), "tokens")
    # full parts: one container each, numbered by a running sum over their texts
    full = parts.where("n_full > 0").select("doc_id", "n_full")
    totals = full.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_full"), F.lit(0)).alias("parts")).first()
    n_full = int(totals["parts"])
    columns = [F.lit(name).alias("container"), "bin", "doc_id", F.col("part_no").cast("int").alias("part_no"), F.col("tokens").cast("long").alias("tokens")]
    alone = _ranked(full.withColumn("salt", _salt(F.lit(max(1, int(totals["n"]))))), [], "n_full").select("doc_id", "before", F.explode(F.sequence(F.lit(1), F.col("n_full").cast("int"))).alias("part_no"))
    alone = alone.select("doc_id", "part_no", (F.col("before") + F.col("part_no") - 1).alias("bin"), F.lit(capacity).alias("tokens")).select(*columns)
    # the rest of each text, and texts that fit
    step = -(-(capacity + separator) // LENGTHS)
    length = F.ceil((F.col("rest") + separator) / F.lit(step)).cast("long")
    rests = parts.where("rest > 0 OR tokens = 0").select("doc_id", length.alias("length"), (F.col("n_full") + 1).alias("part_no"), F.col("rest").alias("tokens"), F.lit(1).alias("one"))
    counts = rests.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r.length): int(r.n) for r in counts.collect()}  # at most LENGTHS + 1 rows
    places = Places(plan_containers(histogram, (capacity + separator) // step))
    salted = rests.join(F.broadcast(counts), "length").select(*rests.columns, _salt(F.col("n")))  # at most LENGTHS + 1 rows
    ranked = _ranked(salted, ["length"], "one")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = n_full + places.locate(pdf["length"].to_numpy(), pdf["before"].to_numpy())
            yield pd.DataFrame({"container": name, "bin": bins, "doc_id": pdf["doc_id"], "part_no": pdf["part_no"], "tokens": pdf["tokens"]})

    placed = ranked.select("doc_id", "part_no", "tokens", "length", "before").mapInPandas(place, "container string, bin long, doc_id long, part_no int, tokens long")
    return placed.unionByName(alone)


def packed(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, bin, doc_id, part_no, tokens``: for each row of ``containers`` an assignment of all texts.

    A text goes whole into one container (``part_no`` 1), unless it alone exceeds the capacity: then it is
    cut into parts of the capacity and a rest. Documents without text are left out, empty texts (0 tokens)
    take a place like others; rows without a positive capacity are skipped. ``containers`` is a list of kinds,
    read on the driver; repeated rows count once, further columns are ignored.
    """
    kinds = containers.where("container IS NOT NULL AND capacity_tokens > 0").select("container", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens")).distinct().orderBy("container").collect()
    sizes = materialize(item_sizes(documents), "item-sizes")
    out = None
    for kind in kinds:
        filled = _fill(sizes, kind.container, int(kind.capacity_tokens), int(kind.separator_tokens))
        out = filled if out is None else out.unionByName(filled)
    return out if out is not None else documents.sparkSession.createDataFrame([], "container string, bin long, doc_id long, part_no int, tokens long")


def fill_report(assignment: DataFrame, containers: DataFrame) -> DataFrame:
    """``container, bins, items, tokens, fewest_bins, fill``: containers used against the fewest that the sizes allow."""
    per_bin = assignment.groupBy("container", "bin").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    kinds = containers.select("container", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens")).distinct()
    total = per_bin.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens")).join(kinds, "container")
    need = (F.col("tokens") + F.col("items") * F.col("separator_tokens")) / (F.col("capacity_tokens") + F.col("separator_tokens"))
    return total.select("container", "bins", "items", "tokens", F.ceil(need).alias("fewest_bins"), F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))
