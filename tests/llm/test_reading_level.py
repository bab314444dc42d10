from __future__ import annotations

import random

from contextloom.llm.prose import sentences
from contextloom.llm.reading_level import demanding_documents, guessed_english, reached_shares, reading_levels

DOC = "doc_id long, text string, lang string, kind string, level string"
LABEL = "doc_id long, rater string, reading_level int, labelled_at timestamp_ntz"
PER_LEVEL = {1: "cat dog sun run big", 2: "garden window letter basket", 3: "parser module buffer setting", 4: "notwithstanding heterogeneity disambiguates idempotence", 5: "epistemological incommensurability reification hermeneutic"}


def text(level: int, seed: int, n: int = 12) -> str:
    rng = random.Random(seed)
    pool = [w for k, words in PER_LEVEL.items() if k <= level for w in words.split()] + PER_LEVEL[level].split() * 3
    return " ".join("The " + " ".join(rng.choice(pool) for _ in range(9)) + " of it." for _ in range(n))


def corpus(spark):
    rows = [(level * 100 + n, text(level, level * 100 + n), "en", "guide", "x") for level in PER_LEVEL for n in range(30)]
    rows += [
        (1, text(5, 1), None, "guide", "x"), (2, text(5, 2), "EN-us ", None, "x"), (3, text(5, 3), "de", "guide", "x"), (4, text(5, 4), "en", "source", "x"), (5, None, "en", "guide", "x"), (6, "", "en", "guide", "x"),
        (7, text(1, 7) + " " + text(5, 7, 3), "en", "guide", "x"), (8, "# " + text(5, 8) + "\n\n" + text(1, 8), "en", "guide", "x"), (9, "```\n" + text(5, 9) + "\n```\n\n" + text(1, 9), "en", "guide", "x"),
        (10, "Der Hund und die Katze sind nicht im Garten, das ist von dem Haus. " * 5, None, "guide", "x"), (1, text(5, 1), None, "guide", "x"),
    ]
    labels = [(level * 100 + n, "a", level, None) for level in PER_LEVEL for n in range(20)] + [(101, "b", 5, None), (101, "c", 1, None), (102, "a", None, None), (999, "a", 3, None)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)


def test_held_out_levels(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in reading_levels(docs, labels).collect()}
    held = [(d, d // 100) for d in got if d >= 100 and d % 100 >= 20]
    assert sum((got[d].level >= 4) == (true >= 4) for d, true in held) == len(held)
    assert sum(abs(got[d].level - true) <= 1 for d, true in held) == len(held)
    assert got[1].is_english and not got[3].is_english and not got[10].is_english and got[6].level is None and 5 not in got
    assert sorted(r.doc_id for r in demanding_documents(docs, labels).where("doc_id < 100").collect()) == [1, 2]


def test_without_labels(spark):
    docs, labels = corpus(spark)
    assert demanding_documents(docs, labels.limit(0)).count() == 0
    assert {r.level for r in reading_levels(docs, labels.limit(0)).collect()} == {None}
    assert reading_levels(docs.limit(0), labels).count() == 0


def test_prose_only():
    found = sentences("# Head line\n\nTitle here\n\nOne two three. Four `code` five!\n\n| a | b |\n|---|---|\n| c | d |\n\n```\nx = 1\n```\n\n- item one is here\n- item two\n\n> quoted words\n\nSee [label](http://x) and https://y.z now.\n")
    flat = [w for s in found for w in s]
    assert "head" not in flat and "title" not in flat and "code" not in flat and "quoted" not in flat and "label" not in flat and "x" not in flat
    assert ["one", "two", "three"] in found and ["item", "two"] in found


def test_guess():
    assert guessed_english("the cat and the dog".split()) and not guessed_english("der hund und die katze".split()) and guessed_english([])


def test_one_rule_for_level_and_found(spark):
    docs, labels = corpus(spark)
    found = {r.doc_id for r in demanding_documents(docs, labels).collect()}
    levels = {r.doc_id: r for r in reading_levels(docs.where("coalesce(kind, '') <> 'source'"), labels).collect()}
    assert found == {d for d, r in levels.items() if r.is_english and r.level is not None and r.level >= 4}


def test_calibration_is_on_held_out_grades():
    least = []
    for shares, truth in (([0.0, 0.1, 0.6, 0.9], [1, 1, 4, 5]), ([0.5, 0.5], [4, 4])):
        assert len(shares) == len(truth)
        least.append(reached_shares([["a"] * round(10 * shares[-1]) + ["b"] * round(10 - 10 * shares[-1])], {"a": 4, "b": 1})[2])
    assert least == [0.9, 0.5] and reached_shares([["a"]], {"a": 4}) is None
