"""Reading level of documents by the grades at which words are acquired.

1. Raters' labels give each labelled document a level (their median). A word's use, per level and
   normalised by how much text the level has, is its graded distribution; its acquisition grade is the
   first level by which ``ACQUIRED`` of that use has occurred.
2. A document reaches level L if a quantile of the grades of its known words does. The quantile for each
   L is calibrated on labelled documents that did not take part in the grades: the sample is dealt into
   ``FOLDS`` by a hash of the id, and each fold is judged by the grades of the others. So a passing sentence
   of another level doesn't decide, nor do words that only one document has.
3. Every document is scored in one pass with the grades, whose number is bounded by the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.llm.prose import sentences
from contextloom.sources.tables import spread
from contextloom.storage import materialize

LEVELS = 5
#: At most so many labelled documents are learned from; which ones is decided by a hash of the id.
MAX_LABELLED = 20_000
ACQUIRED = 0.15
#: A word needs so many labelled documents before it has a grade.
MIN_DOCUMENTS = 3
#: Documents with fewer graded words get no level.
MIN_WORDS = 3
FOLDS = 5
DEMANDING = 4

# Frequent short words of the collection's languages, for texts that name no language.
FUNCTION_WORDS = {
    "en": "the and of in that is it each this when for with from we to are has but if as",
    "de": "der die das und ist nicht den im ein eine wird des von mit vor dem zu auf für",
    "fr": "le la les des et est une dans du un que avant chaque il pour pas au aux cette",
    "es": "el la los las del y es una en que antes cada un de se por para con lo",
    "pt": "o a os as do da e uma em que antes cada um não de se por para com na no",
}
_WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_ENGLISH = ("en", "eng", "english")


def guessed_english(words: list[str]) -> bool:
    """Whether no other language's function words outnumber the English ones."""
    counts = {lang: 0 for lang in _WORDS}
    for w in words:
        for lang, known in _WORDS.items():
            if w in known:
                counts[lang] += 1
    english = counts.pop("en")
    others = max(counts.values())
    return others <= english or others < 0.08 * len(words)


def named_language(lang: Column) -> Column:
    """``en``, ``other``, or null where the text itself has to tell."""
    head = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]+)", 1)
    return F.when(lang.isNull() | (head == "") | head.isin("unknown", "und", "none", "null"), None).when(head.isin(*_ENGLISH), "en").otherwise("other")


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, level, text`` of up to ``MAX_LABELLED`` English documents with labels; raters' median, halves up."""
    levels = (
        labels.where(F.col("reading_level").between(1, LEVELS) & F.col("doc_id").isNotNull())
        .select("doc_id", "rater", "reading_level", "labelled_at")
        .distinct()
        .groupBy("doc_id")
        .agg(F.floor(F.median("reading_level") + 0.5).cast("int").alias("level"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    prose = documents.where(F.col("text").isNotNull() & ~F.coalesce(F.col("kind") == "source", F.lit(False)) & F.coalesce(named_language(F.col("lang")) == "en", F.lit(True)))
    return prose.select("doc_id", "text").join(F.broadcast(levels), "doc_id").dropDuplicates(["doc_id"])


def word_grades(labelled: DataFrame) -> list[dict[str, int]]:
    """Each word's acquisition grade: by the whole sample, then by all folds but the first, the second and so on.

    The counting is distributed; what is collected, one row a word, is bounded by the sample.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for level, fold, text in zip(pdf["level"], pdf["fold"], pdf["text"]):
                tally: dict[str, int] = {}
                for sentence in sentences(text):
                    for w in sentence:
                        tally[w] = tally.get(w, 0) + 1
                rows += [(w, (level - 1) * FOLDS + fold, n) for w, n in tally.items()]
            yield pd.DataFrame(rows, columns=["word", "cell", "n"])

    counted = labelled.select("level", "fold", "text").mapInPandas(count, "word string, cell int, n long")
    cells = [F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)) for c in range(LEVELS * FOLDS)]
    held = [F.count(F.when(F.col("cell") % FOLDS == k, 1)) for k in range(FOLDS)]
    words = counted.groupBy("word").agg(F.array(*cells).alias("uses"), F.array(*held).alias("held"), F.count(F.lit(1)).alias("documents")).where(F.col("documents") >= MIN_DOCUMENTS).collect()
    if not words:
        return [{} for _ in range(FOLDS + 1)]
    totals = np.zeros(LEVELS * FOLDS)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        totals[r.cell] = r.n
    names, documents = [r.word for r in words], np.array([r.documents for r in words])
    uses, held_out = np.array([r.uses for r in words], dtype=float).reshape(-1, LEVELS, FOLDS), np.array([r.held for r in words])
    totals = totals.reshape(LEVELS, FOLDS)
    grades = []
    for fold in (None, *range(FOLDS)):
        kept = [k for k in range(FOLDS) if k != fold]
        amount = totals[:, kept].sum(axis=1)
        share = np.where(amount > 0, uses[:, :, kept].sum(axis=2) / np.maximum(amount, 1), 0.0)
        grade = 1 + np.argmax(np.cumsum(share, axis=1) >= ACQUIRED * share.sum(axis=1, keepdims=True), axis=1)
        enough = documents - (0 if fold is None else held_out[:, fold]) >= MIN_DOCUMENTS
        grades.append({w: int(g) for w, g, e in zip(names, grade, enough) if e})
    return grades


def reached_shares(text_sentences: list[list[str]], grades: dict[str, int]) -> list[float] | None:
    """Per level from 2 the share of the known words whose grade is at least that; null for too few known words."""
    known = [grades[w] for words in text_sentences for w in words if w in grades]
    return [sum(g >= level for g in known) / len(known) for level in range(2, LEVELS + 1)] if len(known) >= MIN_WORDS else None


def calibrated_shares(labelled: DataFrame, grades: list[dict[str, int]]) -> list[float]:
    """For each level from 2 the least share of words at or above it, which is one less the quantile that is asked for.

    It is the middle of the range that best tells the labelled documents at or above the level, each scored by
    the grades of the other folds.
    """

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(level, reached_shares(sentences(text), grades[fold + 1])) for level, fold, text in zip(pdf["level"], pdf["fold"], pdf["text"])]
            yield pd.DataFrame([r for r in rows if r[1] is not None], columns=["level", "shares"])

    rows = labelled.select("level", "fold", "text").mapInPandas(score, "level int, shares array<double>").collect()  # at most MAX_LABELLED
    truth, shares = np.array([r.level for r in rows]), np.array([r.shares for r in rows]).reshape(len(rows), LEVELS - 1)
    least = []
    for k, level in enumerate(range(2, LEVELS + 1)):
        order = np.argsort(shares[:, k], kind="stable")
        values, above = shares[order, k], truth[order] >= level
        # right with the first n below the share: those of them that are below the level, and the others that are not
        right = np.concatenate(([0], np.cumsum(~above))) + np.concatenate((np.cumsum(above[::-1])[::-1], [0]))
        cut = np.concatenate(([True], values[1:] > values[:-1], [True])) if len(values) else np.array([True])
        best = np.flatnonzero(cut & (right == right[cut].max()))
        edges = np.concatenate(([0.0], values, [1.0]))
        least.append(float((edges[best[0]] + edges[best[-1] + 1]) / 2) or 1e-9)
    return least


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, level, demanding_share, is_english``: each document's reading level, 1 to 5.

    ``level`` is the highest that the calibrated quantile of the known words' grades reaches, and all below it;
    it is null for documents without graded prose. ``demanding_share`` is the share of known words of grade
    4 or more. Code, tables, links, headings and quotes have no say. ``is_english`` follows the named
    language, or the text where none is named. Null texts are left out; repeated rows give one row; without
    labels every level is null. Further columns are ignored.
    """
    sample = materialize(labelled_documents(documents, labels).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    grades = word_grades(sample)
    least = calibrated_shares(sample, grades) if grades[0] else []
    known = grades[0]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, language in zip(pdf["doc_id"], pdf["text"], pdf["language"]):
                found = sentences(text) if language != "other" else []
                english = language == "en" or language is None and guessed_english([w for s in found for w in s])
                shares = reached_shares(found, known) if english else None
                level, demanding = None, None
                if shares:
                    level = 1
                    while level < LEVELS and shares[level - 1] >= least[level - 1]:
                        level += 1
                    demanding = shares[DEMANDING - 2]
                rows.append((doc_id, level, demanding, english))
            out = pd.DataFrame(rows, columns=["doc_id", "level", "demanding_share", "is_english"])
            yield out.astype({"level": "Int32", "demanding_share": "float64", "is_english": bool})

    source = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", named_language(F.col("lang")).alias("language"))
    return spread(source, "doc_id").mapInPandas(score, "doc_id long, level int, demanding_share double, is_english boolean").dropDuplicates(["doc_id"])


def demanding_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of English documents, other than source code, whose reading level is 4 or 5."""
    prose = documents.where(~F.coalesce(F.col("kind") == "source", F.lit(False)))
    return reading_levels(prose, labels).where(F.col("is_english") & (F.col("level") >= DEMANDING)).select("doc_id")
