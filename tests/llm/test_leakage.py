from __future__ import annotations

import random

import pytest

from contextloom.llm import leakage
from contextloom.llm.leakage import leaked_items, windows, word_kind, words_of

ITEM = "item_id long, id string, question string, expected_answer string, category string, critical_files array<string>"
NAMES = "alpha bravo carol delta echo fox golf hotel india jul kilo lima mike nov oscar papa".split()


def item_rows():
    out = []
    for n in range(12):
        a, b, c = (f"load{NAMES[(n + k) % 16].title()}{n}" for k in (0, 1, 2))
        out.append((n, f"q{n}", f"Why does {a} keep a stale copy while {b} is rebuilding the part that {c} had dropped during start?", f"Because {a} counts every entry before {b} does, the queue in {c} never grows and stays bounded by 40 mb.", None, []))
    return out


def brute(texts, items):
    found = set()
    for doc, text in texts:
        words = words_of(text or "")
        grams = {tuple(words[i : i + 12]) for i in range(len(words) - 11)}
        for item in items:
            for passage in item[2:4]:
                w = words_of(passage or "")
                if any(tuple(w[i : i + 12]) in grams for i in range(len(w) - 11)):
                    found.add((doc, item[0]))
    return found


def test_disguises_and_traps(spark):
    items = item_rows()
    q = items[3][2]
    words = q.split()
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    docs = [
        (1, q), (2, q.upper().replace(" ", "  \r\n> ")), (3, "// " + q.replace(" ", "\n// ", 5)), (4, q.replace(" ", "&nbsp;").replace("loadDelta3", "<em>loadDelta3</em>")), (5, q.replace(" a ", " **a** ").replace("does", "d​oes")),
        (6, " ".join(words[:11])), (7, " ".join(words[3:15])), (8, " ".join(shuffled)), (9, q.replace("stale", "fresh").replace("part", "piece")), (10, None), (11, ""), (12, q.replace(" ", "\\n")), (1, q), (13, "filler words " * 3000 + q),
        (14, '{"prompt": "' + q.replace('"', '\\"') + '"}'), (None, q),
    ]
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)).collect() if r.how == "verbatim"}
    assert got == {(n, 3) for n in (1, 2, 3, 4, 5, 7, 12, 13, 14)} == {p for p in brute(docs, items) if p[0] is not None}


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id, r.how) for r in leaked_items(docs, spark.createDataFrame(items, ITEM)).collect()}


def other_parameters(text):
    return text.replace("loadDelta3", "fooBar").replace("loadEcho3", "barFoo").replace("loadFox3", "bazQux").replace("40", "77")


@pytest.mark.parametrize("n_items", [1, 4, 12])
def test_other_parameters_whatever_the_number_of_items(spark, n_items):
    items = item_rows()[3:4] if n_items == 1 else item_rows()[:n_items]
    answer = items[-1][3] if n_items < 12 else items[3][3]
    item = items[-1][0] if n_items < 12 else 3
    changed = other_parameters(answer).replace(f"load{NAMES[item].title()}{item}", "oneTwo")
    rows = found(spark, ["See: " + changed, answer], items)
    assert (0, item, "renamed") in rows and (1, item, "verbatim") in rows


def test_crossed_slots_are_another_text(spark):
    items = [(1, "q", "when loadDelta3 holds the lock then loadEcho3 waits until loadDelta3 gives it back to everyone", "", None, [])]
    texts = ["when fooBar holds the lock then barFoo waits until fooBar gives it back to everyone", "when fooBar holds the lock then barFoo waits until barFoo gives it back to everyone", "when fooBar holds the lock then fooBar waits until fooBar gives it back to everyone"]
    assert found(spark, texts, items) == {(0, 1, "renamed")}


def test_renamed_in_part(spark):
    items = item_rows()
    items.append((99, "q", "", items[3][3], None, []))
    other = other_parameters(items[3][3])
    words = other.split()
    cuts = [other, " ".join(words[1:]), " ".join(words[:-2]), " ".join(words[3:17]), "so " + " ".join(words[:4] + ["single"] + words[4:])]
    rows = found(spark, ["before that " + text + " something else" for text in cuts] + [" ".join(words[:11])], items)
    for n in range(len(cuts)):
        assert {(n, 3, "renamed"), (n, 99, "renamed")} <= rows, cuts[n]
    assert not any(d == len(cuts) for d, _, _ in rows)


def test_kinds_and_units():
    assert [word_kind(w) for w in ("40", "mb", "loadFox3", "Paris", "Because", "paris", "HTTP", "x2")] == [1, 2, 3, 3, 0, 0, 0, 3]
    a, b, c = "the box keeps 40 mb of its rows and then stops for good", "the box keeps 55 gb of its rows and then stops for good", "the box keeps few mb of its rows and then stops for good"
    shapes = {n: set(windows([t])[2].tolist()) for n, t in enumerate((a, b, c))}
    assert shapes[0] == shapes[1] and not shapes[0] & shapes[2] - {0}


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    items = item_rows()
    texts = [i[2] for i in items] + ["nothing of that kind stands in this text, which has more than twelve words"]
    whole = found(spark, texts, items)
    monkeypatch.setattr(leakage, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(leakage, "BITMAP_BITS", 1 << 15)
    monkeypatch.setattr(leakage, "BATCH_CHARS", 100)
    assert found(spark, texts, items) == whole and len(whole) >= 12


def test_empty(spark):
    docs = spark.createDataFrame([(1, "some text of no interest at all, twelve words or more are here")], "doc_id long, text string")
    assert leaked_items(docs, spark.createDataFrame([], ITEM)).count() == 0
    assert leaked_items(docs.limit(0), spark.createDataFrame(item_rows(), ITEM)).count() == 0
    assert leaked_items(docs, spark.createDataFrame([(1, "x", None, "", None, None)], ITEM)).count() == 0


def test_found_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{n}" for n in range(6)] + ["ab", "cd", "3", "ms"]
    items = [(n, None, " ".join(rng.choice(vocabulary) for _ in range(20)), None, None, None) for n in range(20)]
    docs = []
    for n in range(200):
        base = rng.choice(items)[2].split()
        start = rng.randrange(10)
        docs.append((n, " ".join([rng.choice(vocabulary), *base[start : start + rng.randrange(8, 16)], rng.choice(vocabulary)])))
    assert {(d, i) for d, i, how in found(spark, [t for _, t in docs], items) if how == "verbatim"} == brute(docs, items)
