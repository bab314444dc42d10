from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from contextloom.operators.changes import compared_states
from contextloom.operators.snapshots import snapshot_changes

HEAD = "snapshot_id long, version string, repo string, profile_name string, generated_at string, git_branch string, git_head_sha string, root_dir string, received_at timestamp_ntz"
ROWS = "snapshot_id long, repo string, path string, size long, content_hash string, modified_time string, received_at timestamp_ntz, hash string, series string"
T0 = datetime(2025, 1, 1)


def heads(spark, *rows):
    return spark.createDataFrame([(i, "1", repo, "p", at, branch, None, "/", T0) for i, repo, branch, at in rows], HEAD)


def files(spark, *rows):
    return spark.createDataFrame([(s, "r", path, 1, h, None, T0 + timedelta(seconds=n), "clash", "clash") for s, path, h, n in rows], ROWS)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_kinds_order_and_spellings(spark):
    h = heads(spark, (9, "r", "main", "2025-01-01T10:00:00+09:00"), (2, "r", "main", "2025-01-01T02:00:00Z"), (2, "r", "main", "2025-01-01T02:00:00Z"), (5, "r", "main", "2025-01-02T00:00:00Z"), (7, "r", None, "2025-01-02T00:00:00Z"))
    f = files(
        spark,
        (9, "a", "0x00FF", 0), (9, "b", "1", 0), (9, "c", None, 0), (9, "gone", "5", 0),
        (2, "./a", " ff", 0), (2, "b", "2", 0), (2, "c", "3", 0), (2, None, "9", 0), (2, "new", "7", 0), (2, "new", "7", 0),
        (2, "b", "1", -5), (77, "x", "1", 0), (7, "only", "1", 0),
    )
    assert result(snapshot_changes(h, f)) == [(2, "b", "modified"), (2, "gone", "deleted"), (2, "new", "added"), (5, "a", "deleted"), (5, "b", "deleted"), (5, "c", "deleted"), (5, "new", "deleted")]


def test_empty(spark):
    assert result(snapshot_changes(heads(spark), files(spark))) == []
    assert result(snapshot_changes(heads(spark, (1, "r", "", "2025-01-01T00:00:00Z")), files(spark))) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("abcd"), st.sampled_from(["1", "2", None]), max_size=4), min_size=1, max_size=4))
def test_against_brute_force(spark, states):
    h = heads(spark, *[(n, "r", "m", f"2025-01-0{n + 1}T00:00:00Z") for n in range(len(states))])
    f = files(spark, *[(n, p, v, 0) for n, s in enumerate(states) for p, v in s.items()])
    want = []
    for n in range(1, len(states)):
        old, new = states[n - 1], states[n]
        for p in {*old, *new}:
            kind = "added" if p not in old else "deleted" if p not in new else "modified" if None not in (old[p], new[p]) and old[p] != new[p] else None
            if kind:
                want.append((n, p, kind))
    assert result(snapshot_changes(h, f)) == sorted(want)


def test_states_mirror(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3"), (None, "4")], "path string, hash string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("w", "1")], "path string, hash string")
    there, back = dict(result(compared_states(a, b))), dict(result(compared_states(b, a)))
    assert there == {"x": "modified", "y": "unchanged", "z": "deleted", "w": "added"}
    swap = {"added": "deleted", "deleted": "added"}
    assert back == {p: swap.get(c, c) for p, c in there.items()}
