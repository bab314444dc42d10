from __future__ import annotations

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from contextloom.llm import packing
from contextloom.llm.packing import Places, _greedy, combinations, fill_report, non_negative_least_squares, packed, plan_containers


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 300), max_size=12), st.integers(40, 90))
def test_plan_takes_all_and_fits(histogram, capacity):
    plan = plan_containers(dict(histogram), capacity)
    used: Counter = Counter()
    for pattern, times in plan:
        assert sum(s * t for s, t in pattern) <= capacity and times > 0
        for s, t in pattern:
            used[s] += t * times
    assert used == Counter(histogram)
    places = Places(plan)
    loads: Counter = Counter()
    for size, n in histogram.items():
        for bin_ in places.locate(np.full(n, size), np.arange(n)):
            loads[int(bin_)] += size
    assert not loads or max(loads.values()) <= capacity and max(loads) < places.containers
    assert places.containers <= sum(n for _, n in _greedy({s: n for s, n in histogram.items() if n}, capacity))
    # first-fit decreasing's guarantee, which the greedy rest keeps up with
    total, largest = sum(s * n for s, n in histogram.items()), max(histogram, default=0)
    if largest * 2 <= capacity:
        assert places.containers <= 2 * max(1, -(-total // capacity)) + 1


def test_least_squares_solves_exact_mix():
    counts = {60: 100, 40: 100, 50: 60}
    patterns = combinations(np.array([40, 50, 60]), 100)
    x = non_negative_least_squares(patterns, counts)
    assert (x >= 0).all()
    made = Counter()
    for pattern, times in zip(patterns, x):
        for s, t in pattern:
            made[s] += t * times
    assert all(abs(made[s] - n) < 0.05 * n for s, n in counts.items())
    assert sum(t for _, t in plan_containers(counts, 100)) == 130


def test_documents(spark):
    texts = [(1, "x" * 400, "q"), (2, "x" * 2100, "q"), (3, None, "q"), (4, "", "q"), (5, "é" * 40, "q"), (5, "é" * 40, "q"), (None, "abc", "q")] + [(10 + n, "y" * 200, "q") for n in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, tokens string")
    kinds = spark.createDataFrame([("c", 200, 1, "k"), ("c", 200, 1, "k"), ("d", 1000, None, "k"), ("bad", 0, 1, "k"), ("none", None, 1, "k")], "container string, capacity_tokens long, separator_tokens long, bin string")
    rows = packed(docs, kinds).collect()
    assert {r.container for r in rows} == {"c", "d"}
    want = Counter({1: 100, 2: 525, 4: 0, 5: 20} | {10 + n: 50 for n in range(50)})
    for name, capacity, separator in (("c", 200, 1), ("d", 1000, 0)):
        got, load, items = Counter(), Counter(), Counter()
        for r in rows:
            if r.container == name:
                got[r.doc_id] += r.tokens
                load[r.bin] += r.tokens
                items[r.bin] += 1
        assert {k: got[k] for k in want} == dict(want) and set(got) == set(want)
        assert all(load[b] + separator * (items[b] - 1) <= capacity for b in load)
        parts = [r for r in rows if r.container == name and r.doc_id == 2]
        assert len(parts) == (3 if name == "c" else 1) and sum(r.tokens == capacity for r in parts) == (2 if name == "c" else 0)
    report = {r.container: r for r in fill_report(packed(docs, kinds), kinds).collect()}
    assert report["d"].bins >= report["d"].fewest_bins and report["d"].bins <= report["d"].fewest_bins + 1
    assert packed(docs.limit(0), kinds).count() == 0 and packed(docs, kinds.limit(0)).count() == 0


def test_hot_length(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('a', 40) ELSE repeat('b', CAST(id % 97 AS INT)) END AS text")
    kinds = spark.createDataFrame([("c", 64, 2)], "container string, capacity_tokens long, separator_tokens long")
    out = packed(docs, kinds)
    assert out.count() == 3000 and out.select("doc_id").distinct().count() == 3000
    assert out.groupBy("bin").agg({"tokens": "sum", "*": "count"}).where("`sum(tokens)` + 2 * (`count(1)` - 1) > 64").count() == 0


def test_salts_and_full_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 7)
    docs = spark.range(300).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('a', 40) WHEN id % 3 = 1 THEN repeat('b', 1000) ELSE repeat('c', 512) END AS text")
    kinds = spark.createDataFrame([("c", 64, 1)], "container string, capacity_tokens long, separator_tokens long")
    rows = packed(docs, kinds).collect()
    assert len({(r.doc_id, r.part_no) for r in rows}) == len(rows) == 100 + 100 * 4 + 100 * 2
    loads = Counter()
    for r in rows:
        loads[r.bin] += r.tokens + 1
    assert max(loads.values()) <= 65 and sorted(loads) == list(range(len(loads)))


def test_large_containers_are_planned_in_steps(spark, monkeypatch):
    monkeypatch.setattr(packing, "LENGTHS", 16)
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('a', CAST(id * 7 % 1200 AS INT)) AS text")
    kinds = spark.createDataFrame([("c", 500, 3)], "container string, capacity_tokens long, separator_tokens long")
    (report,) = fill_report(packed(docs, kinds), kinds).collect()
    assert report["items"] == 400 and report.bins <= 1.2 * report.fewest_bins
    assert packed(docs, kinds).groupBy("bin").agg({"tokens": "sum", "*": "count"}).where("`sum(tokens)` + 3 * (`count(1)` - 1) > 500").count() == 0
