from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from contextloom.llm.splitting import cuts, file_pieces, greedy_cuts, line_boundaries, oversized, room_of, run_pieces, successors, with_line_parts

RUNS = "run_id long, max_tokens long, overlap_tokens long, repo string"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab {}();\né漢\n", max_size=900), st.integers(1, 60), st.integers(0, 60))
def test_cuts_hold_all_and_fit(text, tokens, overlap):
    overlap = min(overlap, tokens - 1)
    limit, over = room_of(tokens, overlap)
    raw = text.encode()
    offsets, kinds = with_line_parts(raw, *line_boundaries(raw), max(4, (limit - over) // 4))
    assert offsets[0] == 0 and offsets[-1] == len(raw) and (np.diff(offsets) > 0).all()
    for at in offsets:
        assert at == len(raw) or raw[at] & 0xC0 != 0x80
    after = successors(offsets, kinds, limit, over)
    path = greedy_cuts(after)
    walk = [0]
    while walk[-1] != len(offsets) - 1:
        walk.append(int(after[walk[-1]]))
    assert list(path) == walk
    sizes = np.diff(offsets[path])
    assert sizes.sum() == len(raw)
    assert all(size + (over if n else 0) <= limit for n, size in enumerate(sizes))


def test_natural_places():
    text = "".join(f"def f{n}():\n    a = {n}\n    return a\n\n\n" for n in range(30))
    offsets, kinds = with_line_parts(text.encode(), *line_boundaries(text.encode()), 100)
    path = greedy_cuts(successors(offsets, kinds, 200, 0))
    assert all(text[offsets[k] :].startswith("def ") for k in path[:-1])


def tables(spark, make_files):
    long = "".join(f"line {n} of this file, ünd more\n" for n in range(300))
    files = make_files((1, "r", "a.md", long), (1, "r", "a.md", long), (2, "r", "b.md", "short"), (3, "r", "c.bin", None), (4, "r", "d.js", "x" * 5000), (5, "r", "e", ""))
    runs = spark.createDataFrame([(1, 500, 50, "x"), (1, 500, 50, "x"), (2, 0, 10, "x"), (3, None, None, "x"), (4, 100, 90, "x"), (5, 100, None, "x")], RUNS)
    members = spark.createDataFrame([(r, f, "x") for r in (1, 2, 3, 4, 5, 9) for f in (1, 2, 3, 4, 5, 77)] * 2, "run_id long, file_id long, path string")
    return files, runs, members


def test_runs(spark, make_files):
    files, runs, members = tables(spark, make_files)
    assert sorted({(r.run_id, r.file_id) for r in run_pieces(files, runs, members).collect()}) == [(1, 1), (1, 4), (4, 1), (4, 4), (5, 1), (5, 4)]
    assert run_pieces(files.limit(0), runs, members).count() == 0
    assert run_pieces(files, runs.limit(0), members).count() == 0


def test_texts_round_trip(spark, make_files):
    files, runs, members = tables(spark, make_files)
    contents = {r.file_id: r.content for r in files.collect()}
    texts = file_pieces(files, oversized(files, runs, members), texts=True).collect()
    groups: dict = {}
    for r in texts:
        groups.setdefault((r.file_id, r.max_tokens, r.overlap_tokens), {})[r.piece_no] = r.text
    repeats = {(r.file_id, r.max_tokens, r.overlap_tokens, r.piece_no): r.n_repeated for r in texts}
    assert len(groups) == 6 and {g[1:] for g in groups} == {(500, 50), (100, 90), (100, 0)}
    for (file_id, most, overlap), pieces in groups.items():
        whole, last = b"", b""
        for n in sorted(pieces):
            piece = pieces[n].encode()
            assert len(piece) // 4 <= most
            if n > 1:
                assert 4 * overlap <= repeats[file_id, most, overlap, n] <= 4 * overlap + 3 and last.endswith(piece[: repeats[file_id, most, overlap, n]])
            whole, last = whole + piece[repeats[file_id, most, overlap, n] :], piece
        assert whole.decode() == contents[file_id]


def test_a_run_depends_on_itself_only(spark, make_files):
    files, runs, members = tables(spark, make_files)
    alone = {tuple(r) for r in run_pieces(files, runs.where("run_id = 1"), members).collect()}
    more = spark.createDataFrame([(9, 10, 9, "x")], RUNS)
    both = {tuple(r) for r in run_pieces(files, runs.where("run_id = 1").union(more), members).collect()}
    assert alone and {r for r in both if r[0] == 1} == alone and any(r[0] == 9 for r in both)


def test_overlap_up_to_the_limit():
    raw = ("wörd " * 400).encode()
    for overlap in (0, 60, 120, 199):
        path = cuts(raw, line_boundaries(raw), 200, overlap)
        limit, over = room_of(200, overlap)
        assert path[0] == 0 and path[-1] == len(raw) and all(b - a + (over if a else 0) <= limit for a, b in zip(path, path[1:]))
