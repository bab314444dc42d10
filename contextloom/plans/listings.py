"""Queries over the listings beside the walk, whole walks, traces, selections and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from contextloom.functions import validators
from contextloom.functions.globs import any_regex, glob_regex, ignore_regex
from contextloom.functions.tables import DEFAULT_IGNORE, TIER_PATTERNS
from contextloom.operators import budget, discovery, imports, listings, metadata, relevance, reports, workflows
from contextloom.operators.descriptors import descriptors
from contextloom.plans.contents import GRAPH_SQL, near_sql
from contextloom.plans.contents import ORACLES as CONTENT_ORACLES
from contextloom.plans.files import _CUT, BUDGET, EXCLUDE, EXTENSIONS, F_SQL, IGNORE_FILES, IGNORED, INCLUDE, T_SQL, WANTED, _budgeted, _tiered, matches, q
from contextloom.sources.tables import table

#: A second set of ignore rules, as a tool of its own would keep them.
TOOL_IGNORE = (("", ("*.tf", "ops/")), ("src", ("*.json",)))
MODULES = ("src", "docs/guides")
PRIORITY = ("README.md",)
MAX_BYTES = 100_000


def _narrow(spark, sf_dir):
    return descriptors(table(spark, sf_dir, "files"))


def _rules(spark):
    return [discovery.ignore_rules(spark, rules) for rules in (IGNORE_FILES, TOOL_IGNORE)]


def hashed_files(spark, sf_dir):
    return _narrow(spark, sf_dir).where("path IS NOT NULL").where(listings.is_hashed(F.col("path"), F.col("is_symlink"))).select("file_id", "repo", "path")


def listed_files(spark, sf_dir):
    return _narrow(spark, sf_dir).where("path IS NOT NULL").where(listings.is_listed(F.col("path"))).select("file_id", "repo", "path")


def _level(spark, sf_dir, directory):
    return listings.level(discovery.ignored(_narrow(spark, sf_dir).where("path IS NOT NULL")).select("repo", "path", "is_ignored", "is_binary"), directory)


def root_level(spark, sf_dir):
    return _level(spark, sf_dir, "")


def docs_level(spark, sf_dir):
    return _level(spark, sf_dir, "docs")


def module_files(spark, sf_dir):
    return _narrow(spark, sf_dir).where(listings.in_modules(F.col("path"), MODULES)).select("file_id", "path")


def composite_ignore(spark, sf_dir):
    return discovery.ignored(_narrow(spark, sf_dir).where("path IS NOT NULL"), *_rules(spark)).select("file_id", "is_ignored")


def _links(spark, sf_dir):
    """Links with their targets: here, links of a repository that have a name in common lead to one target, those without an ending nowhere."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return _narrow(spark, sf_dir).where("is_symlink AND path IS NOT NULL").select("repo", "path", F.when(F.contains(name, F.lit(".")), name).alias("real_path"))


def symlink_verdicts(spark, sf_dir):
    return listings.symlink_verdicts(_links(spark, sf_dir)).select("repo", "path", "verdict")


def walk_counts(spark, sf_dir):
    files = discovery.ignored(_narrow(spark, sf_dir).where("path IS NOT NULL"), *_rules(spark))
    wanted = discovery.matches_patterns(F.col("path"), INCLUDE, EXCLUDE, EXTENSIONS)
    return discovery.walk_counts(files, table(spark, sf_dir, "run_files"), listings.symlink_verdicts(_links(spark, sf_dir)), wanted, MAX_BYTES)


def tier_groups(spark, sf_dir):
    grouped = relevance.grouped_by_tier(_tiered(spark, sf_dir).where("path IS NOT NULL"), "repo")
    return grouped.select("repo", "tier", "n_files", "tokens", F.md5(F.array_join("paths", "\n")).alias("paths_md5"))


def inclusion_totals(spark, sf_dir):
    return metadata.inclusion_total(budget.with_used_tokens(*_budgeted(spark, sf_dir)), BUDGET)


def ordered_trace(spark, sf_dir):
    traced = metadata.ordered_trace(_narrow(spark, sf_dir), ("**/*.sql",), ("**/*.go", "**/*.sql", "**/*.md", "docs/**"), PRIORITY)
    return traced.select("file_id", "included", F.size("trace").alias("n_steps"), F.element_at("trace", -1)["rule"].alias("last_rule"), F.element_at("trace", -1)["outcome"].alias("last_outcome"))


def selection_stats(spark, sf_dir):
    chosen = _tiered(spark, sf_dir).where("tokens IS NOT NULL").withColumn("included", F.col("tokens") > 200)
    marked = table(spark, sf_dir, "files").where(F.col("content").rlike(r"AKIA[0-9A-Z]{16}|gh[pors]_[A-Za-z0-9]{36}")).select("file_id")
    return reports.selection_stats(chosen, marked, "repo", "tier")


def validated_matches(spark, sf_dir):
    """Words of contents that look like key ids or tokens of three parts, and whether their structure holds."""
    words = table(spark, sf_dir, "files").where("file_id IS NOT NULL").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?:AKIA|ASIA|ABIA|ACCA|A3T|eyJ)[A-Za-z0-9_.-]*"), F.lit(0))).alias("word")).distinct()
    return words.groupBy("file_id").agg(
        F.sum(validators.is_access_key_id(F.col("word")).cast("long")).alias("n_key_ids"), F.sum(validators.is_token_of_three(F.col("word")).cast("long")).alias("n_tokens"), F.count("*").alias("n_words")
    )


def _edges(spark, sf_dir):
    files = table(spark, sf_dir, "files")
    return imports.import_edges(imports.imports(files), descriptors(files))


def importers(spark, sf_dir):
    """What imports Go files or their directories."""
    return imports.importers(_edges(spark, sf_dir), _narrow(spark, sf_dir).where("path LIKE '%.go'").select("repo", "path"))


def module_slice(spark, sf_dir):
    files = _narrow(spark, sf_dir).where("path IS NOT NULL")
    return workflows.module_slice(files.select("repo", "path", "tokens"), _edges(spark, sf_dir), imports.test_edges(files), MODULES, 6_000)


def brief_documents(spark, sf_dir):
    sections = workflows.brief_sections(table(spark, sf_dir, "files"))
    out = workflows.brief_documents(sections, workflows.module_map(_narrow(spark, sf_dir)), 1_500)
    return out.select("repo", "tokens", F.md5("document").alias("document_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        hashed_files, listed_files, root_level, docs_level, module_files, composite_ignore, symlink_verdicts, walk_counts, tier_groups, inclusion_totals, ordered_trace, selection_stats, validated_matches,
        importers, module_slice, brief_documents,
    )
}

_DIR = "regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1)"


def _by_files_sql(rules) -> str:
    """Whether a path is ignored by ignore files: the last match within each, any of the files."""
    out = []
    for where, lines in rules:
        below = "path" if not where else f"substring(path, {len(where) + 2})"
        state = "FALSE"
        for line in lines:
            if not line.startswith("#"):
                state = f"CASE WHEN {matches(below, ignore_regex(line.lstrip('!')))} THEN {'FALSE' if line.startswith('!') else 'TRUE'} ELSE {state} END"
        out.append(f"({'TRUE' if not where else f'starts_with(path, {q(where + chr(47))})'} AND {state})")
    return " OR ".join(out)


_ANY_IGNORE = f"({IGNORED} OR {_by_files_sql(IGNORE_FILES)} OR {_by_files_sql(TOOL_IGNORE)})"
_LINKS = f"""lk AS (SELECT repo, path, CASE WHEN contains(regexp_extract(path, '([^/]*)$', 1), '.') THEN regexp_extract(path, '([^/]*)$', 1) END AS real_path FROM f WHERE is_symlink AND path IS NOT NULL),
vd AS (SELECT repo, path, CASE WHEN real_path IS NULL THEN 'symlink_error' WHEN row_number() OVER (PARTITION BY repo, real_path ORDER BY path) = 1 THEN 'followed' ELSE 'symlink_loop' END AS verdict FROM lk)"""


def _level_sql(lead: str) -> str:
    return f"""{F_SQL}, b AS (SELECT repo, substring(path, {len(lead) + 1}) AS rest FROM f WHERE path IS NOT NULL AND starts_with(path, {q(lead)}) AND NOT {IGNORED} AND NOT is_binary)
        SELECT DISTINCT repo, {q(lead)} || string_split(rest, '/')[1] AS path, string_split(rest, '/')[1] AS name, contains(rest, '/') AS is_dir FROM b WHERE string_split(rest, '/')[1] <> '.git'"""


def _trace_sql() -> str:
    include = any_regex(glob_regex(g) for g in ("**/*.go", "**/*.sql", "**/*.md", "docs/**"))
    tier = "CASE " + " ".join(f"WHEN {matches('path', glob_regex(p))} THEN {t}" for t in sorted(TIER_PATTERNS) for p in TIER_PATTERNS[t]) + " ELSE 99 END"
    pattern = "CASE " + " ".join(f"WHEN {matches('path', glob_regex(p))} THEN {q(p)}" for t in sorted(TIER_PATTERNS) for p in TIER_PATTERNS[t]) + " END"
    return f"""{F_SQL}, e AS (SELECT file_id, path, CASE WHEN {IGNORED} THEN 1 WHEN {matches('path', glob_regex('**/*.sql'))} THEN 2 WHEN NOT {matches('path', include)} THEN 4 WHEN path = 'README.md' THEN 5 ELSE 0 END AS k,
          {tier} AS tier, {pattern} AS pattern FROM f WHERE path IS NOT NULL)
        SELECT file_id, k IN (0, 5) AS included, CASE WHEN k IN (1, 2, 4) THEN k WHEN k = 5 OR tier = 99 THEN 11 ELSE 6 + tier END::INTEGER AS n_steps,
          CASE k WHEN 1 THEN 'Default ignore patterns' WHEN 2 THEN 'Profile ignore patterns' WHEN 4 THEN 'Include filter' ELSE 'Relevance tier_' || CASE WHEN k = 5 OR tier = 99 THEN 5 ELSE tier END END AS last_rule,
          CASE WHEN k IN (1, 2, 4) THEN 'EXCLUDED' WHEN k = 5 THEN 'skipped (priority file)' WHEN tier = 99 THEN 'no match' ELSE 'MATCH "' || pattern || '" -> assigned tier ' || tier END AS last_outcome FROM e"""


ORACLES = {
    "hashed_files": rf"{F_SQL} SELECT file_id, repo, path FROM f WHERE path IS NOT NULL AND NOT is_symlink AND NOT regexp_matches(path, '(^|/)\.') AND NOT regexp_matches(path, '(^|/)(node_modules|vendor|__pycache__|dist|build|target)/')",
    "listed_files": rf"{F_SQL} SELECT file_id, repo, path FROM f WHERE path IS NOT NULL AND NOT regexp_matches(path, '(^|/)(\.[^/]*|node_modules|vendor|__pycache__|dist)/')",
    "root_level": _level_sql(""),
    "docs_level": _level_sql("docs/"),
    "module_files": f"{F_SQL} SELECT file_id, path FROM f WHERE path IN ('src', 'docs/guides') OR starts_with(path, 'src/') OR starts_with(path, 'docs/guides/')",
    "composite_ignore": f"{F_SQL} SELECT file_id, {_ANY_IGNORE} AS is_ignored FROM f WHERE path IS NOT NULL",
    "symlink_verdicts": f"{F_SQL}, {_LINKS} SELECT repo, path, verdict FROM vd",
    "walk_counts": f"""{F_SQL}, {_LINKS}, tr AS (SELECT DISTINCT file_id FROM run_files), w AS (
        SELECT f.repo, CASE WHEN {_ANY_IGNORE.replace('path', 'f.path')} AND {matches("(CASE WHEN contains(f.path, '/') THEN regexp_extract(f.path, '^(.*/)[^/]*$', 1) ELSE '' END || 'x')", any_regex(ignore_regex(p) for p in DEFAULT_IGNORE))} THEN 'ignored_dir'
          WHEN {_ANY_IGNORE.replace('path', 'f.path')} THEN 'ignored' WHEN f.file_id NOT IN (SELECT file_id FROM tr WHERE file_id IS NOT NULL) THEN 'not_tracked'
          WHEN is_symlink AND verdict <> 'followed' THEN verdict WHEN error IS NOT NULL THEN 'stat_error' WHEN n_bytes > {MAX_BYTES} THEN 'large_file' WHEN is_binary THEN 'binary'
          WHEN NOT {WANTED.replace('path', 'f.path')} THEN 'pattern_filter' ELSE 'kept' END AS reason
        FROM f LEFT JOIN vd ON vd.repo = f.repo AND vd.path = f.path WHERE f.path IS NOT NULL)
        SELECT repo, reason, count(*) AS n FROM w GROUP BY repo, reason""",
    "tier_groups": f"{T_SQL} SELECT repo, tier, count(*) AS n_files, coalesce(sum(tokens), 0)::BIGINT AS tokens, md5(string_agg(path, chr(10) ORDER BY path)) AS paths_md5 FROM t WHERE path IS NOT NULL GROUP BY repo, tier",
    "inclusion_totals": f"""{_CUT}, g AS (SELECT repo, sum((status <> 'excluded')::INT)::BIGINT AS n_included, sum((status = 'excluded')::INT)::BIGINT AS n_excluded, sum(used)::BIGINT AS tokens FROM us GROUP BY repo)
        SELECT repo, n_included, n_excluded, tokens, tokens * 100 // {BUDGET} AS percent FROM g""",
    "ordered_trace": _trace_sql(),
    "selection_stats": f"""{T_SQL}, s AS (SELECT DISTINCT file_id FROM files WHERE regexp_matches(content, 'AKIA[0-9A-Z]{{16}}|gh[pors]_[A-Za-z0-9]{{36}}'))
        SELECT repo, tier, count(*) AS n_files, sum((tokens > 200)::INT)::BIGINT AS n_selected, coalesce(sum(CASE WHEN tokens > 200 THEN tokens END), 0)::BIGINT AS tokens,
          sum((tokens > 200 AND file_id IN (SELECT file_id FROM s WHERE file_id IS NOT NULL))::INT)::BIGINT AS n_with_secrets FROM t WHERE tokens IS NOT NULL GROUP BY repo, tier""",
    "validated_matches": """WITH w AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '(?:AKIA|ASIA|ABIA|ACCA|A3T|eyJ)[A-Za-z0-9_.-]*')) AS word FROM files WHERE file_id IS NOT NULL)
        SELECT file_id, sum((length(word) = 20 AND NOT starts_with(word, 'eyJ'))::INT)::BIGINT AS n_key_ids,
          sum((len(string_split(word, '.')) = 3 AND string_split(word, '.')[1] <> '' AND string_split(word, '.')[2] <> '' AND string_split(word, '.')[3] <> '')::INT)::BIGINT AS n_tokens, count(*) AS n_words FROM w GROUP BY file_id""",
    "importers": f"""WITH x AS ({CONTENT_ORACLES['import_edges']}), g AS (SELECT DISTINCT repo, path FROM files WHERE path LIKE '%.go' AND file_id IS NOT NULL)
        SELECT DISTINCT repo, src AS path FROM x WHERE (EXISTS (SELECT 1 FROM g WHERE g.repo = x.repo AND g.path = x.dst)
          OR EXISTS (SELECT 1 FROM g WHERE g.repo = x.repo AND {_DIR} = regexp_extract(x.dst, '^(?:(.*)/)?[^/]*$', 1))) AND NOT EXISTS (SELECT 1 FROM g WHERE g.repo = x.repo AND g.path = x.src)""",
    "module_slice": rf"""WITH {GRAPH_SQL}, lf AS (SELECT repo, path, max(strlen(content)) // 4 AS tokens FROM files WHERE path IS NOT NULL AND file_id IS NOT NULL
          AND NOT regexp_matches(path, '(^|/)(\.[^/]*|node_modules|vendor|__pycache__|dist)/') GROUP BY repo, path),
        m AS (SELECT repo, path FROM lf WHERE path IN ('src', 'docs/guides') OR starts_with(path, 'src/') OR starts_with(path, 'docs/guides/')), n AS {near_sql('m', 'm')},
        c AS (SELECT lf.repo, lf.path, coalesce(tokens, 0) AS tokens, m.path IS NOT NULL AS is_primary FROM lf LEFT JOIN m ON m.repo = lf.repo AND m.path = lf.path LEFT JOIN n ON n.repo = lf.repo AND n.path = lf.path
          WHERE m.path IS NOT NULL OR n.path IS NOT NULL),
        u AS (SELECT repo, sum(tokens) AS used FROM c WHERE is_primary GROUP BY repo),
        r AS (SELECT *, sum(tokens) OVER (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING) AS running FROM c WHERE NOT is_primary)
        SELECT repo, path, tokens, is_primary FROM c WHERE is_primary
        UNION ALL SELECT r.repo, path, tokens, is_primary FROM r LEFT JOIN u ON u.repo = r.repo WHERE running <= 6000 - coalesce(used, 0) AND 6000 - coalesce(used, 0) > 0""",
}
