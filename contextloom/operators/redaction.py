"""Rule-based redaction of files: matches, masked contents and summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.globs import any_regex, glob_regex
from contextloom.functions.rules import BUILT_IN, Rule, scan_text
from contextloom.functions.tables import SECRET_LABELS
from contextloom.functions.text import lookup
from contextloom.operators.discovery import is_sensitive_file
from contextloom.sources.tables import spread


def _prepared(files: DataFrame, exclude: Sequence[str]) -> DataFrame:
    path = F.coalesce("path", F.lit(""))
    skipped = path.rlike(any_regex(glob_regex(p) for p in exclude)) if exclude else F.lit(False)
    return files.where(F.col("file_id").isNotNull()).select("file_id", "path", "content", is_sensitive_file(path).alias("sensitive"), skipped.alias("skipped"))


def redaction_matches(files: DataFrame, threshold: str = "medium", custom: Sequence[Rule] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """``file_id, line_no, start_col, end_col, rule_id, secret_type, confidence`` of each match, once per file.

    Custom rules come after the built-in ones. Paths under an ``exclude`` glob are left alone. Null contents
    give nothing. One pass in Arrow batches; no text is shuffled.
    """
    rules = (*BUILT_IN, *custom)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file_id", "line_no", "start_col", "end_col", "rule_id", "secret_type", "confidence"]
        for pdf in batches:
            rows = [
                (file_id, *match)
                for file_id, content, sensitive in zip(pdf["file_id"], pdf["content"], pdf["sensitive"])
                for match in scan_text(content, rules, threshold, sensitive)[1]
            ]
            yield pd.DataFrame(rows, columns=columns)

    schema = "file_id long, line_no int, start_col int, end_col int, rule_id string, secret_type string, confidence string"
    source = _prepared(files, exclude).where(~F.col("skipped") & F.col("content").isNotNull())
    return spread(source.select("file_id", "content", "sensitive"), "file_id").mapInPandas(scan, schema).distinct()


def redacted_contents(files: DataFrame, threshold: str = "medium", custom: Sequence[Rule] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """``file_id, path, content, n_redactions`` with the matches masked; line counts don't change."""
    rules = (*BUILT_IN, *custom)

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [(c, []) if s else scan_text(c, rules, threshold, x) for c, x, s in zip(pdf["content"], pdf["sensitive"], pdf["skipped"])]
            yield pd.DataFrame({"file_id": pdf["file_id"], "path": pdf["path"], "content": [t for t, _ in done], "n_redactions": [len(m) for _, m in done]})

    return spread(_prepared(files, exclude), "file_id").mapInPandas(mask, "file_id long, path string, content string, n_redactions long")


def redaction_summary(matches: DataFrame) -> DataFrame:
    """``secret_type, n, n_files, confidence``: per type the count and the highest confidence, most frequent first by count and name."""
    level = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    grouped = matches.groupBy("secret_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("n_files"), F.max(level).alias("level"))
    name = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("level") + 1)
    return grouped.select("secret_type", "n", "n_files", name.alias("confidence"))


def secret_label(secret_type: Column, n: Column) -> Column:
    """A kind of secret in words, in the plural unless it is one."""
    spaced = F.replace(secret_type, F.lit("_"), F.lit(" "))
    known = lookup(secret_type, SECRET_LABELS)
    label = F.when(known != "", known).otherwise(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30)))
    return F.concat(label, F.when(n == 1, "").otherwise("s"))


def redaction_reports(matches: DataFrame, paths: DataFrame, profile: str = "default", threshold: str = "medium") -> DataFrame:
    """``repo, report, text, inline``: the report of each repository's matches as JSON and as text, and its one-line summary.

    ``paths`` has ``file_id, repo, path``; repositories without matches say so. Details are ordered by path, line and
    column; kinds by number, then name. A repository's matches make one value.
    """
    located = matches.join(paths.where("file_id IS NOT NULL").select("file_id", "repo", "path").distinct(), "file_id")
    level = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    kinds = located.groupBy("repo", "secret_type").agg(F.count(F.lit(1)).alias("n"), F.max(level).alias("level"))
    by_type = kinds.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "secret_type", "n", "level"))).alias("kinds"))
    levels = located.groupBy("repo", "confidence").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("confidence", "n"))).alias("levels"))
    entry = F.struct("path", "line_no", "start_col", "rule_id", "secret_type", "confidence")
    details = located.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("file_id").alias("n_files"), F.sort_array(F.collect_list(entry)).alias("entries"))
    joined = paths.select("repo").distinct().join(details, "repo", "left").join(by_type, "repo", "left").join(levels, "repo", "left")
    total = F.coalesce("total", F.lit(0))
    name = lambda of: F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), of + 1)
    pairs = lambda rows, key: F.coalesce(F.map_from_entries(F.transform(rows, lambda r: F.struct(r[key], r["n"]))), F.create_map().cast("map<string, bigint>"))
    shown = F.transform("entries", lambda e: F.struct(
        e["path"].alias("file"), e["line_no"].alias("line"), e["rule_id"].alias("rule_id"), e["secret_type"].alias("secret_type"), e["confidence"].alias("confidence"), F.concat(F.lit("[REDACTED:"), e["secret_type"], F.lit("]")).alias("replacement")
    ))
    none = F.array().cast("array<struct<file: string, line: int, rule_id: string, secret_type: string, confidence: string, replacement: string>>")
    summary = F.struct(total.alias("total_redactions"), F.coalesce("n_files", F.lit(0)).alias("files_affected"), pairs(F.col("kinds"), "secret_type").alias("by_type"), pairs(F.col("levels"), "confidence").alias("by_confidence"))
    report = F.to_json(F.struct(F.lit(profile).alias("profile"), F.lit(threshold).alias("confidence_threshold"), summary.alias("summary"), F.coalesce(shown, none).alias("redactions")))
    word = F.when(total == 1, "redaction").otherwise("redactions")
    listed = F.array_join(F.transform("kinds", lambda k: F.concat(k["n"].cast("string"), F.lit(" "), secret_label(k["secret_type"], k["n"]))), ", ")
    inline = F.when(total == 0, "No secrets detected").otherwise(F.concat(total.cast("string"), F.lit(" "), word, F.lit(" ("), listed, F.lit(")")))
    per_kind = F.array_join(F.transform("kinds", lambda k: F.concat(F.lit("  "), k["n"].cast("string"), F.lit(" "), secret_label(k["secret_type"], k["n"]), F.lit(" ("), name(k["level"]), F.lit(" confidence)\n"))), "")
    per_entry = F.array_join(F.transform("entries", lambda e: F.format_string("  %-40s [%-25s]  %s\n", F.concat(e["path"], F.lit(":"), e["line_no"].cast("string")), e["secret_type"], e["confidence"])), "")
    text = F.concat(
        F.lit(f"Profile: {profile}\nThreshold: {threshold}\n\nSummary: "), total.cast("string"), F.lit(" "), word, F.lit(" in "), F.coalesce("n_files", F.lit(0)).cast("string"), F.lit(" files\n"), F.coalesce(per_kind, F.lit("")), F.lit("\nDetails:\n"),
        F.coalesce(per_entry, F.lit("")),
    )
    return joined.select("repo", report.alias("report"), text.alias("text"), inline.alias("inline"))


def rule_hits(files: DataFrame, rules: Sequence[Rule] = BUILT_IN) -> DataFrame:
    """``rule_id, n_files, n_hits``: raw hits of each rule's pattern, before entropy, overlaps and lines, as built-in expressions.

    Keywords guard the patterns, so that most texts are only searched for words. Deliveries count once.
    """
    lowered = F.lower("content")
    counts = []
    for rule in rules:
        hits = F.size(F.regexp_extract_all("content", F.lit(rule.pattern), F.lit(0))).cast("long")
        guard = F.lit(False)
        for k in rule.lowered:
            guard = guard | F.contains(lowered, F.lit(k))
        counts.append(F.when(guard, hits).otherwise(F.lit(0).cast("long")))
    texts = spread(files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull()).select("file_id", "content"), "file_id")
    per_file = texts.select("file_id", F.array(*counts).alias("h")).groupBy("file_id").agg(F.max("h").alias("h"))
    named = F.arrays_zip(F.array(*[F.lit(r.rule_id) for r in rules]).alias("rule_id"), F.col("h").alias("n"))
    rows = per_file.select(F.explode(named).alias("r")).select(F.col("r.rule_id").alias("rule_id"), F.col("r.n").alias("n"))
    return rows.groupBy("rule_id").agg(F.sum((F.col("n") > 0).cast("long")).alias("n_files"), F.sum("n").alias("n_hits"))
