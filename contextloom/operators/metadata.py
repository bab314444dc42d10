"""Side outputs: metadata and preview records as JSON, samples, traces of decisions, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.globs import any_regex, glob_regex
from contextloom.functions.tables import TIER_KEYS, TIER_PATTERNS
from contextloom.operators.compression import compressor_language
from contextloom.operators.discovery import ignored_by_default
from contextloom.operators.relevance import tier_of

METADATA_VERSION = "1.0.0"


_ENTRY = "path: string, tier: int, tokens: bigint, bytes: bigint, redactions: bigint, compressed: boolean, language: string"
_STATISTICS = "total_files: bigint, total_tokens: bigint, total_bytes: bigint, budget_used_percent: double, max_tokens: bigint, files_by_tier: map<string, bigint>, redactions_total: bigint, redactions_by_type: map<string, bigint>, compressed_files: bigint"
METADATA_SCHEMA = f"struct<version: string, profile: string, tokenizer: string, content_hash: string, statistics: struct<{_STATISTICS}>, files: array<struct<{_ENTRY}>>>"


def metadata(files: DataFrame, max_tokens: int = 0, redactions: DataFrame | None = None, hashes: DataFrame | None = None, *, profile: str = "default", tokenizer: str = "none") -> DataFrame:
    """``repo, metadata``: version, run, statistics and files in order of path, as one JSON text per repository.

    ``files`` has ``repo, path, tier, tokens, n_bytes`` and may have ``redactions, is_compressed, language``; ``redactions`` has ``repo,
    secret_type, n``, ``hashes`` ``repo, content_hash``. The share of the budget is left out without a limit.
    """
    has = lambda name, default: F.coalesce(F.col(name), default) if name in files.columns else default
    masked, compressed = has("redactions", F.lit(0)).cast("long"), has("is_compressed", F.lit(False))
    used = F.round(F.sum("tokens") * 100.0 / F.lit(float(max_tokens)), 4) if max_tokens > 0 else F.lit(None).cast("double")
    entry = F.struct("path", "tier", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_bytes", F.lit(0)).alias("bytes"), masked.alias("redactions"), compressed.alias("compressed"), has("language", F.lit("")).alias("language"))
    grouped = files.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("total_bytes"), used.alias("budget_used_percent"),
        F.sum(masked).alias("redactions_total"), F.sum(compressed.cast("long")).alias("compressed_files"), F.sort_array(F.collect_list(entry)).alias("files"),
    )
    tiers = files.groupBy("repo", "tier").agg(F.count(F.lit(1)).alias("n")).groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("tier", "n"))).alias("t"))
    grouped = grouped.join(tiers.select("repo", F.map_from_entries(F.transform("t", lambda e: F.struct(e["tier"].cast("string"), e["n"]))).alias("files_by_tier")), "repo")
    empty = F.create_map().cast("map<string, bigint>")
    if redactions is not None:
        kinds = redactions.groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("secret_type", "n")))).alias("redactions_by_type"))
        grouped = grouped.join(kinds, "repo", "left").withColumn("redactions_by_type", F.coalesce("redactions_by_type", empty))
    else:
        grouped = grouped.withColumn("redactions_by_type", empty)
    grouped = grouped.join(hashes.select("repo", "content_hash"), "repo", "left") if hashes is not None else grouped.withColumn("content_hash", F.lit(None).cast("string"))
    statistics = F.struct(
        "total_files", "total_tokens", "total_bytes", "budget_used_percent", F.lit(max(max_tokens, 0)).cast("long").alias("max_tokens"), "files_by_tier", "redactions_total", "redactions_by_type", "compressed_files"
    )
    run = [F.lit(METADATA_VERSION).alias("version"), F.lit(profile).alias("profile"), F.lit(tokenizer).alias("tokenizer"), "content_hash"]
    return grouped.select("repo", F.to_json(F.struct(*run, statistics.alias("statistics"), "files")).alias("metadata"))


def metadata_rows(records: DataFrame, column: str = "metadata") -> DataFrame:
    """The other columns of ``records`` and ``path, tier, tokens, bytes, redactions, compressed, language`` of each file of a metadata text; bad or missing texts give none."""
    rest = [c for c in records.columns if c != column]
    return records.select(*rest, F.explode(F.from_json(column, METADATA_SCHEMA)["files"]).alias("f")).select(*rest, "f.*")


def budget_info(records: DataFrame, column: str = "metadata") -> DataFrame:
    """The other columns of ``records`` and ``total_tokens, max_tokens, budget_used_percent`` of a metadata text; null where it is bad or missing."""
    rest = [c for c in records.columns if c != column]
    parsed = F.from_json(column, METADATA_SCHEMA)["statistics"]
    return records.select(*rest, parsed["total_tokens"].alias("total_tokens"), parsed["max_tokens"].alias("max_tokens"), parsed["budget_used_percent"].alias("budget_used_percent"))


def preview(files: DataFrame, omitted: DataFrame | None = None, max_tokens: int = 0) -> DataFrame:
    """``repo, preview``: files, tokens and a map from tier to files, as one small JSON text per repository.

    With ``omitted`` (``repo, n``) and a budget also the files left out and the share of the budget used.
    """
    tiers = files.groupBy("repo", "tier").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    entries = F.sort_array(F.collect_list(F.struct("tier", "n")))
    rolled = tiers.groupBy("repo").agg(F.sum("n").alias("total_files"), F.sum("tokens").alias("total_tokens"), F.map_from_entries(F.transform(entries, lambda e: F.struct(e["tier"].cast("string"), e["n"]))).alias("tiers"))
    shown = ["total_files", "total_tokens", "tiers"]
    if omitted is not None:
        rolled = rolled.join(omitted.select("repo", F.col("n").alias("files_omitted")), "repo", "left").withColumn("files_omitted", F.coalesce("files_omitted", F.lit(0)))
        shown.append("files_omitted")
    if max_tokens > 0:
        rolled = rolled.withColumns({"budget": F.lit(max_tokens), "budget_utilization_percent": F.round(F.col("total_tokens") * 100.0 / F.lit(float(max_tokens)), 4)})
        shown += ["budget", "budget_utilization_percent"]
    return rolled.select("repo", F.to_json(F.struct(*shown)).alias("preview"))


def sample(files: DataFrame, n: int, seed: str = "") -> DataFrame:
    """``n`` files of each repository in an order that path and seed decide, so that runs agree; all if ``n`` isn't positive.

    A bounded top list per repository is kept while aggregating; no repository is sorted in one task.
    """
    if n <= 0:
        return files
    ranked = files.withColumn("__rank", F.md5(F.concat(F.coalesce("path", F.lit("")), F.lit("|" + seed))))
    few = ranked.groupBy("repo", F.substring("__rank", 1, 2).alias("__part")).agg(F.slice(F.sort_array(F.collect_set("__rank")), 1, n).alias("r"))
    chosen = few.groupBy("repo").agg(F.slice(F.sort_array(F.flatten(F.collect_list("r"))), 1, n).alias("r")).select("repo", F.explode("r").alias("__rank"))
    return ranked.join(chosen, ["repo", "__rank"], "left_semi").drop("__rank")


def decision_trace(df: DataFrame, ignore: tuple[str, ...] = (), include: tuple[str, ...] = (), priority: tuple[str, ...] = (), exclude_redaction: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, path, decision, tier, is_priority, is_redacted, language``: what becomes of a path, and the step that decides."""
    under = lambda globs: F.col("path").rlike(any_regex(glob_regex(g) for g in globs)) if globs else F.lit(False)
    decision = F.when(ignored_by_default(F.col("path")), "default ignore").when(under(ignore), "profile ignore").when(~under(include) if include else F.lit(False), "not included").otherwise("kept")
    kept = F.col("decision") == "kept"
    return df.withColumn("decision", decision).select(
        "file_id", "path", "decision", F.when(kept, tier_of(F.col("path"))).otherwise(-1).alias("tier"), (kept & under(priority)).alias("is_priority"), (kept & ~under(exclude_redaction)).alias("is_redacted"),
        F.coalesce(compressor_language(F.col("path")), F.lit("")).alias("language"),
    )


def fuzzy_matches(text: Column, query: str) -> Column:
    """Whether the query's characters stand in the text in order, case aside; an empty query matches everything."""
    special = set(".^$*+?{}[]\\|()")
    return F.lower(text).rlike(".*".join("\\" + c if c in special else c for c in query.lower())) if query else F.lit(True)


def inclusion_summary(df: DataFrame) -> DataFrame:
    """``repo, tier_key, n_included, n_excluded, percent``: tiers of a budgeted set with ``used`` tokens; percent of all tokens used, cut to a whole."""
    taken = F.col("status").isin("included", "truncated")
    tiers = df.groupBy("repo", "tier").agg(F.sum(taken.cast("long")).alias("n_included"), F.sum((~taken).cast("long")).alias("n_excluded"), F.sum("used").alias("tokens"))
    total = tiers.groupBy("repo").agg(F.sum("tokens").alias("all"))
    key = F.element_at(F.array(*[F.lit(k) for k in TIER_KEYS]), F.col("tier") + 1)
    return tiers.join(total, "repo").select("repo", key.alias("tier_key"), "n_included", "n_excluded", F.when(F.col("all") > 0, F.expr("tokens * 100 div all")).otherwise(0).alias("percent"))


def inclusion_total(df: DataFrame, max_tokens: int) -> DataFrame:
    """``repo, n_included, n_excluded, tokens, percent`` of a budgeted set with ``used`` tokens; percent of the whole budget, cut to a whole, 0 without one."""
    taken = F.col("status").isin("included", "truncated")
    percent = F.expr(f"tokens * 100 div {max_tokens}") if max_tokens > 0 else F.lit(0).cast("long")
    return df.groupBy("repo").agg(F.sum(taken.cast("long")).alias("n_included"), F.sum((~taken).cast("long")).alias("n_excluded"), F.sum("used").alias("tokens")).withColumn("percent", percent)


def ordered_trace(df: DataFrame, ignore: tuple[str, ...] = (), include: tuple[str, ...] = (), priority: tuple[str, ...] = ()) -> DataFrame:
    """``file_id, path, included, trace``: the steps that a path goes through, in order, up to the one that decides.

    A step is ``(step, rule, matched, outcome)``. Exclusion ends the trace, so does the first tier that matches; a path
    named in ``priority`` has tier 0 and skips the tiers.
    """
    path = F.col("path")
    under = lambda globs: path.rlike(any_regex(glob_regex(g) for g in globs)) if globs else F.lit(False)
    step = lambda n, rule, matched, outcome: F.struct(F.lit(n).alias("step"), F.lit(rule).alias("rule"), matched.alias("matched"), outcome.alias("outcome"))
    go_on, out = F.lit("no match -> continue"), F.lit("EXCLUDED")
    by_default, by_profile, outside, first = ignored_by_default(path), under(ignore), ~under(include) if include else F.lit(False), path.isin(*priority) if priority else F.lit(False)
    steps = [
        step(1, "Default ignore patterns", by_default, F.when(by_default, out).otherwise(go_on)), step(2, "Profile ignore patterns", by_profile, F.when(by_profile, out).otherwise(go_on)),
        step(3, "Ignore files", F.lit(False), F.lit("not simulated -> continue")),
        step(4, "Include filter", outside, F.when(outside, out).otherwise("include match -> continue" if include else "not active -> continue")),
        step(5, "Priority files", first, F.when(first, "priority file -> tier 0").otherwise(go_on)),
    ]
    for tier in sorted(TIER_PATTERNS):
        hit = F.lit(None).cast("string")
        for pattern in reversed(TIER_PATTERNS[tier]):
            hit = F.when(path.rlike(glob_regex(pattern)), pattern).otherwise(hit)
        outcome = F.when(first, "skipped (priority file)").when(hit.isNotNull(), F.concat(F.lit('MATCH "'), hit, F.lit(f'" -> assigned tier {tier}'))).otherwise("no match")
        steps.append(step(6 + tier, f"Relevance tier_{tier}", hit.isNotNull() & ~first, outcome))
    ends = F.when(by_default, 1).when(by_profile, 2).when(outside, 4).otherwise(F.lit(99))
    tier_end = F.coalesce(F.array_min(F.transform(F.filter(F.array(*steps[5:]), lambda s: s["matched"]), lambda s: s["step"])), F.lit(99))
    last = F.least(ends, tier_end)
    return df.where(path.isNotNull()).select("file_id", "path", (ends == 99).alias("included"), F.filter(F.array(*steps), lambda s: s["step"] <= last).alias("trace"))
