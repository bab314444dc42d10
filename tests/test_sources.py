from __future__ import annotations

import subprocess

from contextloom.sources.directory import changed_lines, clear_state, directory_files, save_state, stored_state, tracked_paths, working_copy
from contextloom.sources.tables import distinct_rows
from contextloom.streaming.changes import counted_by_window, delivered, follow_changes


def test_directory_and_git(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_text("héllo\n")
    (root / "sub" / "b.bin").write_bytes(b"\x00\x01")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (root / "a.txt").unlink()
    git("commit", "-qam", "two")
    (root / "a.txt").write_text("héllo\n")
    rows = {r.path: r for r in directory_files(spark, str(root), "r").collect()}
    assert set(rows) == {"a.txt", "sub/b.bin"} and rows["a.txt"].content == "héllo\n" and rows["sub/b.bin"].content is None and rows["sub/b.bin"].is_binary
    assert [r.path for r in tracked_paths(spark, str(root)).collect()] == ["sub/b.bin"]
    assert [r.line for r in changed_lines(spark, str(root), "HEAD~1").collect()] == ["D\ta.txt"]
    state = working_copy(str(root))
    assert state["n_changed"] == 1 and len(state["head"]) >= 7 and state["branch"] and working_copy(str(tmp_path)) == {"branch": None, "head": None, "n_changed": None}


def test_state_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"version": "1", "files": {"a": {"size": 3, "content_hash": "ff", "modified_time": "t"}}}')
    assert [tuple(r) for r in stored_state(spark, str(tmp_path / "s.json")).collect()] == [("a", 3, "ff", "t")]
    for profile, path in (("p 1", "a"), ("q", "b"), ("p 1", "c")):
        save_state(spark.createDataFrame([(profile, path)], "profile string, path string"), str(tmp_path / "state"))
    assert sorted((r.profile, r.path) for r in spark.read.parquet(str(tmp_path / "state")).collect()) == [("p_1", "c"), ("q", "b")]
    assert clear_state(spark, str(tmp_path / "state"), "p 1") and not clear_state(spark, str(tmp_path / "state"), "none")
    assert [r.path for r in spark.read.parquet(str(tmp_path / "state")).collect()] == ["b"] and clear_state(spark, str(tmp_path / "state")) and not (tmp_path / "state").exists()


def test_distinct_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (2, None, None)], "k long, v string, at int")
    assert sorted((r.k, r.v) for r in distinct_rows(df, "k", latest="at").collect()) == [(1, "b"), (2, None)]


def test_stream(spark, make_files, tmp_path):
    source = tmp_path / "in"
    make_files((1, "r", "a", "x"), (2, "r", "b", "y")).coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    run = lambda: follow_changes(delivered(spark, str(source), schema, 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    make_files((1, "r", "a", "changed"), (3, "r", "c", None)).coalesce(1).write.mode("append").parquet(str(source))
    run()
    seen = sorted((r.path, r.change, r.batch) for r in spark.read.parquet(str(tmp_path / "out" / "changes")).select("path", "change", "batch").collect())
    assert seen == [("a", "added", 0), ("a", "modified", 1), ("b", "added", 0), ("c", "added", 1)]
    assert counted_by_window(delivered(spark, str(source), schema)).isStreaming
