"""Queries over the files table: discovery, relevance, tokens, budgets, parts, trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from contextloom.functions.globs import any_regex, glob_regex, ignore_regex
from contextloom.functions.tables import COMPRESSOR_LANGUAGES, DEFAULT_IGNORE, FENCE_LANGUAGES, KNOWN_DIRECTORIES, SENSITIVE_FILES, SENSITIVE_PATHS, TIER_KEYS, TIER_PATTERNS
from contextloom.functions.text import thousands, tokens_ceil
from contextloom.operators import budget, discovery, metadata, relevance, reports, trees, workflows
from contextloom.operators.compression import compressor_language
from contextloom.operators.descriptors import DESCRIPTORS_SQL, descriptors
from contextloom.operators.render import fence_language
from contextloom.sources.tables import table
from contextloom.storage import materialize

BUDGET = 20_000
PART = 8_000
SLICE = 6_000
INCLUDE, EXCLUDE, EXTENSIONS = ("src/**", "docs/**/*.md"), ("**/*_test.go", "**/vendor/**"), ("py", ".RS")
ASSERTED = ("**/go.sum", "src/**/*.py", "docs/*.md", "no/such/**")
#: Ignore files of a repository, as (directory, lines); the deeper negation has no effect.
IGNORE_FILES = (
    ("", ("# generated", "*.lock", "gen/", "!poetry.lock", "/docs/*.md")),
    ("src", ("*.json", "!cache*.json", "**/node/**")),
    ("docs", ("!*.md", "guides/")),
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(column: str, regex: str) -> str:
    return f"regexp_matches({column}, {q(regex)})"


def tier_sql(path: str) -> str:
    normal = rf"regexp_replace(replace({path}, '\', '/'), '^\./', '')"
    cases = " ".join(f"WHEN {matches(normal, any_regex(glob_regex(p) for p in TIER_PATTERNS[t]))} THEN {t}" for t in sorted(TIER_PATTERNS))
    return f"CASE {cases} ELSE 2 END"


def lookup_sql(key: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


F_SQL = f"WITH RECURSIVE {DESCRIPTORS_SQL}"
T_SQL = f"{F_SQL}, t AS (SELECT *, {tier_sql('path')} AS tier FROM f)"
ENDING = r"regexp_extract(path, '\.([^./]*)$', 1)"
NAME = "regexp_extract(path, '([^/]*)$', 1)"
IGNORED = matches("path", any_regex(ignore_regex(p) for p in DEFAULT_IGNORE))
WANTED = (
    f"(NOT {matches('path', any_regex(glob_regex(p) for p in EXCLUDE))} AND ({matches('path', any_regex(glob_regex(p) for p in INCLUDE))} OR lower({ENDING}) IN ('py', 'rs')))"
)


def _files(spark, sf_dir):
    return table(spark, sf_dir, "files")


def _narrow(spark, sf_dir):
    return descriptors(_files(spark, sf_dir))


def _tiered(spark, sf_dir):
    return relevance.classified(_narrow(spark, sf_dir))


def ignore_filter(spark, sf_dir):
    return _narrow(spark, sf_dir).select("file_id", discovery.ignored_by_default(F.col("path")).alias("is_ignored"))


def ignore_files(spark, sf_dir):
    return discovery.ignored_by_files(_narrow(spark, sf_dir), discovery.ignore_rules(spark, IGNORE_FILES))


def _ignore_files_sql() -> str:
    out = []
    for where, lines in IGNORE_FILES:
        below = "path" if not where else f"substring(path, {len(where) + 2})"
        state = "FALSE"
        for line in lines:
            if not line.startswith("#"):
                state = f"CASE WHEN {matches(below, ignore_regex(line.lstrip('!')))} THEN {'FALSE' if line.startswith('!') else 'TRUE'} ELSE {state} END"
        # the last rule decides: it is the outermost case
        out.append(f"({'TRUE' if not where else f'starts_with(path, {q(where + chr(47))})'} AND {state})")
    return f"{F_SQL} SELECT file_id FROM f WHERE {' OR '.join(out)}"


def pattern_filter(spark, sf_dir):
    return _narrow(spark, sf_dir).where(discovery.matches_patterns(F.col("path"), INCLUDE, EXCLUDE, EXTENSIONS)).select("file_id", "path")


def sensitive_paths(spark, sf_dir):
    return _narrow(spark, sf_dir).select("file_id", discovery.is_sensitive_path(F.col("path")).alias("by_path"), discovery.is_sensitive_file(F.col("path")).alias("by_file"))


def binary_contents(spark, sf_dir):
    rows = _files(spark, sf_dir).where("file_id IS NOT NULL").select("file_id", discovery.is_binary_content(F.col("content")).alias("b"))
    return rows.groupBy("file_id").agg(F.max("b").alias("has_zero_byte"))


def skip_reasons(spark, sf_dir):
    wanted = discovery.matches_patterns(F.col("path"), INCLUDE, EXCLUDE, EXTENSIONS)
    reason = discovery.skip_reason(F.col("path"), F.col("n_bytes"), F.col("is_binary"), F.col("is_symlink"), wanted, 100_000)
    return _narrow(spark, sf_dir).select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def scan_skip_counts(spark, sf_dir):
    return discovery.skip_counts(table(spark, sf_dir, "discovery"))


def tracked_files(spark, sf_dir):
    return discovery.tracked_only(_narrow(spark, sf_dir), table(spark, sf_dir, "run_files")).select("file_id", "path")


def assert_include(spark, sf_dir):
    return discovery.unmatched_patterns(_narrow(spark, sf_dir), ASSERTED)


def tier_match(spark, sf_dir):
    return _tiered(spark, sf_dir).select("file_id", "tier", relevance.tier_key(F.col("tier")).alias("tier_key"))


def tier_counts(spark, sf_dir):
    return relevance.tier_summary(_tiered(spark, sf_dir), "repo")


def tier_explain(spark, sf_dir):
    return relevance.explained(_narrow(spark, sf_dir))


def _tier_explain_sql() -> str:
    flat = [(t, n, p) for t in sorted(TIER_PATTERNS) for n, p in enumerate(TIER_PATTERNS[t])]
    normal = r"regexp_replace(replace(path, '\', '/'), '^\./', '')"
    rows = " UNION ALL ".join(f"SELECT file_id, path, CAST({t} AS INTEGER) AS tier, CAST({n} AS INTEGER) AS ord, {q(p)} AS pattern FROM f WHERE {matches(normal, glob_regex(p))}" for t, n, p in flat)
    return f"{F_SQL}, hits AS ({rows}) SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY tier, ord) = 1 AS is_winner FROM hits"


def language_breakdown(spark, sf_dir):
    rows = _narrow(spark, sf_dir).select(F.coalesce(compressor_language(F.col("path")), F.lit("")).alias("compressor"), fence_language(F.col("path")).alias("fence"), "tokens")
    return rows.groupBy("compressor", "fence").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def token_estimates(spark, sf_dir):
    return _narrow(spark, sf_dir).where("n_bytes IS NOT NULL").select("file_id", "tokens", tokens_ceil(F.col("n_bytes")).alias("tokens_ceil"), thousands(F.col("n_bytes")).alias("shown"))


def tier_token_report(spark, sf_dir):
    return reports.token_report(_tiered(spark, sf_dir), "repo")


def top_files_by_tokens(spark, sf_dir):
    return reports.top_files(_narrow(spark, sf_dir), 10).select("file_id", "path", "tokens")


def token_heatmap(spark, sf_dir):
    return reports.heat_map(_narrow(spark, sf_dir))


def document_overhead(spark, sf_dir):
    return reports.estimated_overhead(_narrow(spark, sf_dir), "repo")


def pipeline_stats(spark, sf_dir):
    return reports.pipeline_stats(_narrow(spark, sf_dir), "repo")


#: Tokens of a document around its files, for one repository's budget.
OVERHEAD = 500


def _budgeted(spark, sf_dir):
    """Every file of every repository with its budget's verdict, and the shortened texts of the truncated ones."""
    chosen = materialize(budget.budget_truncate(_tiered(spark, sf_dir), BUDGET, overhead=OVERHEAD), "budgeted")
    cut = chosen.where("status = 'truncated'").select("file_id", "room", "tokens")  # one a repository
    files = _files(spark, sf_dir).select("file_id", "content").join(cut, "file_id").dropDuplicates(["file_id"])
    return chosen, budget.truncated_content(files).select("file_id", "room", F.expr("octet_length(content) div 4").alias("tokens"), F.md5("content").alias("content_md5"))


def budget_truncate(spark, sf_dir):
    return budget.budget_truncate(_tiered(spark, sf_dir), BUDGET, overhead=OVERHEAD).select("file_id", "repo", "tier", "path", "tokens", "status", "room")


def budget_tier_stats(spark, sf_dir):
    return budget.tier_stats(budget.with_used_tokens(*_budgeted(spark, sf_dir)), "repo")


def budget_skip(spark, sf_dir):
    return budget.budget_skip(_tiered(spark, sf_dir), BUDGET, overhead=OVERHEAD)


def budget_unlimited(spark, sf_dir):
    """Without a limit everything is included and no overhead counts."""
    return budget.budget_truncate(_tiered(spark, sf_dir), 0, overhead=OVERHEAD).groupBy("repo", "status").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def budget_truncated_files(spark, sf_dir):
    return _budgeted(spark, sf_dir)[1]


def split_parts(spark, sf_dir):
    return budget.split_parts(_tiered(spark, sf_dir), PART)


def split_part_sizes(spark, sf_dir):
    return split_parts(spark, sf_dir).groupBy("repo", "part_no").agg(F.count("*").alias("n_files"), F.sum("tokens").alias("tokens"))


def dir_tristate(spark, sf_dir):
    chosen = _narrow(spark, sf_dir).withColumn("included", F.col("tokens") > 200).where("tokens IS NOT NULL")
    return trees.selection_states(chosen)


def selection_patterns(spark, sf_dir):
    chosen = _narrow(spark, sf_dir).withColumn("included", F.col("tokens") > 200).where("tokens IS NOT NULL")
    return trees.selection_patterns(chosen)


def tree_nodes(spark, sf_dir):
    return trees.tree_nodes(_narrow(spark, sf_dir))


def tree_drawing(spark, sf_dir):
    return trees.repository_trees(_narrow(spark, sf_dir), 3)


def module_map(spark, sf_dir):
    return workflows.module_map(_narrow(spark, sf_dir))


def health_checks(spark, sf_dir):
    return workflows.health_checks(_narrow(spark, sf_dir))


def quality_coverage(spark, sf_dir):
    return workflows.question_coverage(table(spark, sf_dir, "golden_questions"), _narrow(spark, sf_dir))


def quality_percent(spark, sf_dir):
    return workflows.coverage_percent(quality_coverage(spark, sf_dir))


def slice_budget(spark, sf_dir):
    files = _narrow(spark, sf_dir).where("tokens IS NOT NULL").select("repo", "path", "tokens", F.col("path").startswith("src/").alias("is_primary"))
    return workflows.slice_budget(files, SLICE)


def inclusion_summary(spark, sf_dir):
    return metadata.inclusion_summary(budget.with_used_tokens(*_budgeted(spark, sf_dir)))


def metadata_files(spark, sf_dir):
    """Figures of each repository's metadata text, read back from it."""
    out = metadata.metadata(_tiered(spark, sf_dir), BUDGET)
    part = lambda where: F.get_json_object("metadata", where)
    return out.select("repo", part("$.statistics.total_tokens").cast("long").alias("tokens"), part("$.statistics.budget_used_percent").cast("double").alias("percent"), part("$.files[0].path").alias("first_path"))


def metadata_entries(spark, sf_dir):
    """Every file through a metadata text and back."""
    return metadata.metadata_rows(metadata.metadata(_tiered(spark, sf_dir).where("path IS NOT NULL"), BUDGET)).select("repo", "path", "tier", "tokens", "bytes")


def budget_info(spark, sf_dir):
    return metadata.budget_info(metadata.metadata(_tiered(spark, sf_dir), BUDGET))


def preview_records(spark, sf_dir):
    return metadata.preview(_tiered(spark, sf_dir)).withColumnRenamed("preview", "record")


def verify_sample(spark, sf_dir):
    return metadata.sample(_narrow(spark, sf_dir).where("path IS NOT NULL"), 5, "s").select("file_id", "repo", "path")


def decision_trace(spark, sf_dir):
    return metadata.decision_trace(_narrow(spark, sf_dir), ("**/*.sql",), ("**/*.go", "**/*.sql", "**/*.md", "docs/**"), ("README*",), ("docs/**",))


def fuzzy_search(spark, sf_dir):
    return _narrow(spark, sf_dir).where(metadata.fuzzy_matches(F.col("path"), "srcCo.go")).select("file_id", "path")


_DIRS = """parts AS (SELECT repo, path, tokens, string_split(path, '/') AS p FROM f),
d AS (SELECT repo, path, tokens, array_to_string(list_slice(p, 1, n), '/') AS dir FROM (SELECT *, unnest(range(1, len(p))) AS n FROM parts))"""
_SELECTED = f"""{F_SQL}, parts AS (SELECT repo, path, tokens > 200 AS included, string_split(path, '/') AS p FROM f WHERE tokens IS NOT NULL),
d AS (SELECT repo, included, array_to_string(list_slice(p, 1, n), '/') AS dir FROM (SELECT *, unnest(range(1, len(p))) AS n FROM parts)),
s AS (SELECT repo, dir, count(*) AS n_files, CASE WHEN min(included::INT) = 1 THEN 'included' WHEN max(included::INT) = 0 THEN 'excluded' ELSE 'partial' END AS state FROM d GROUP BY repo, dir)"""
_LIMIT = BUDGET - OVERHEAD
_TRUNCATE = f"""{T_SQL}, r AS (SELECT *, sum(coalesce(tokens, 0)) OVER (PARTITION BY repo ORDER BY tier, path, file_id ROWS UNBOUNDED PRECEDING) AS running FROM t),
b AS (SELECT *, CASE WHEN running <= {_LIMIT} THEN 'included' WHEN {_LIMIT} - (running - coalesce(tokens, 0)) > 0 THEN 'truncated' ELSE 'excluded' END AS status,
        {_LIMIT} - (running - coalesce(tokens, 0)) AS space FROM r)"""
#: Truncated files: the most lines whose joined bytes div 4 leave 20 tokens of the space, then a mark that names the tokens shown.
_CUT = f"""{_TRUNCATE}, ct AS (SELECT file_id, space, tokens, (SELECT max(content) FROM files x WHERE x.file_id = b.file_id) AS content FROM b WHERE status = 'truncated'),
ln AS (SELECT file_id, space, tokens, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM ct),
ps AS (SELECT file_id, space, i, sum(strlen(line)) OVER (PARTITION BY file_id ORDER BY i) + i - 1 AS upto FROM ln),
kp AS (SELECT file_id, coalesce(max(CASE WHEN upto // 4 <= greatest(space - 20, 0) THEN i END), 0) AS k FROM ps GROUP BY file_id),
kt AS (SELECT ct.file_id, space, tokens, array_to_string(string_split(content, chr(10))[1:k], chr(10)) AS kept FROM ct JOIN kp ON kp.file_id = ct.file_id),
tx AS (SELECT file_id, space, CASE WHEN kept = '' THEN '' ELSE kept || chr(10) END || '<!-- Content truncated: ' || (strlen(kept) // 4) || ' of ' || tokens || ' tokens shown -->' AS content FROM kt),
us AS (SELECT b.*, CASE status WHEN 'excluded' THEN 0 WHEN 'truncated' THEN strlen(tx.content) // 4 ELSE coalesce(tokens, 0) END AS used FROM b LEFT JOIN tx ON tx.file_id = b.file_id)"""
_NUMBERED = f"""{T_SQL}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tier, path, file_id) AS k FROM t)"""

def split_sql(part: int, source: str = "t", recursive: bool = True) -> str:
    """Parts of ordered files in SQL; ``source`` has ``file_id, repo, tier, path, tokens``."""
    return f"""{T_SQL + ', ' if recursive else 'WITH RECURSIVE '}o AS MATERIALIZED (
  SELECT file_id, repo, tier, path, coalesce(tokens, 0) AS tokens, regexp_extract(path, '^([^/]*)', 1) AS top, row_number() OVER (PARTITION BY repo ORDER BY tier, path, file_id) AS k,
         sum(coalesce(tokens, 0)) OVER (PARTITION BY repo) + 200 * count(*) OVER (PARTITION BY repo) + 600 AS whole FROM {source}),
-- next_part/filled/used: the part that is open after this file; part_no: where this file went
w AS (
  SELECT o.*, 1 AS part_no,
         CASE WHEN tokens + 200 > {part} - 600 THEN 2 ELSE 1 END AS open_part, CASE WHEN tokens + 200 > {part} - 600 THEN 0 ELSE 1 END AS filled, CASE WHEN tokens + 200 > {part} - 600 THEN 0 ELSE tokens + 200 END AS used
  FROM o WHERE k = 1
  UNION ALL
  SELECT file_id, repo, tier, path, tokens, top, k, whole, part_no,
         CASE WHEN own THEN part_no + 1 ELSE part_no END, CASE WHEN own THEN 0 WHEN part_no > open_part THEN 1 ELSE filled + 1 END, CASE WHEN own THEN 0 WHEN part_no > open_part THEN cost ELSE used + cost END
  FROM (
    SELECT o.*, w.open_part, w.filled, w.used, o.tokens + 200 AS cost,
           o.tokens + 200 > CASE WHEN w.open_part = 1 THEN {part} - 600 ELSE {part} - 300 END AS own,
           CASE WHEN o.tokens + 200 > CASE WHEN w.open_part = 1 THEN {part} - 600 ELSE {part} - 300 END THEN w.open_part + CASE WHEN w.filled > 0 THEN 1 ELSE 0 END
                WHEN w.filled > 0 AND w.used + o.tokens + 200 > CASE WHEN w.open_part = 1 THEN {part} - 600 ELSE {part} - 300 END
                     AND NOT (w.tier = o.tier AND w.top = o.top AND w.used + o.tokens + 200 <= CASE WHEN w.open_part = 1 THEN {part - 600 + (part - 600) * 15 // 100} ELSE {part - 300 + (part - 300) * 15 // 100} END)
                THEN w.open_part + 1 ELSE w.open_part END AS part_no
    FROM w JOIN o ON o.repo = w.repo AND o.k = w.k + 1))
SELECT file_id, repo, tier, path, tokens, CAST(CASE WHEN whole <= {part} THEN 1 ELSE part_no END AS INTEGER) AS part_no FROM w"""


_SPLIT = split_sql(PART)

QUERIES = {
    f.__name__: f
    for f in (
        ignore_filter, ignore_files, pattern_filter, sensitive_paths, binary_contents, skip_reasons, scan_skip_counts, tracked_files, assert_include, tier_match, tier_counts, tier_explain,
        language_breakdown, token_estimates, tier_token_report, top_files_by_tokens, token_heatmap, document_overhead, pipeline_stats, budget_truncate, budget_tier_stats, budget_skip, budget_unlimited,
        budget_truncated_files, split_parts, split_part_sizes, dir_tristate, selection_patterns, tree_nodes, tree_drawing, module_map, health_checks, quality_coverage, quality_percent, slice_budget, inclusion_summary, metadata_files, metadata_entries, budget_info, preview_records, verify_sample, decision_trace, fuzzy_search,
    )
}

_TIER_KEY = "CASE tier " + " ".join(f"WHEN {n} THEN {q(k)}" for n, k in enumerate(TIER_KEYS)) + " END"
_ASSERT = " UNION ALL ".join(f"SELECT {q(p)} AS pattern, coalesce(sum(CASE WHEN {matches('path', glob_regex(p))} THEN 1 ELSE 0 END), 0)::BIGINT AS n_matches FROM f" for p in ASSERTED)

ORACLES = {
    "ignore_filter": f"{F_SQL} SELECT file_id, {IGNORED} AS is_ignored FROM f",
    "ignore_files": _ignore_files_sql(),
    "pattern_filter": f"{F_SQL} SELECT file_id, path FROM f WHERE {WANTED}",
    "sensitive_paths": f"""{F_SQL} SELECT file_id, {matches('path', any_regex(ignore_regex(p) for p in SENSITIVE_PATHS))} AS by_path,
        {matches('path', any_regex(glob_regex(p) for p in SENSITIVE_FILES))} OR {matches(NAME, any_regex(glob_regex(p) for p in SENSITIVE_FILES if '/' not in p))} AS by_file FROM f""",
    "binary_contents": "SELECT file_id, coalesce(max(contains(substring(content, 1, 8192), chr(0))::INT), 0) = 1 AS has_zero_byte FROM files WHERE file_id IS NOT NULL GROUP BY file_id",
    "skip_reasons": f"""{F_SQL} SELECT CASE WHEN {IGNORED} THEN 'ignored' WHEN is_symlink THEN 'symlink_error' WHEN n_bytes > 100000 THEN 'large_file' WHEN is_binary THEN 'binary'
        WHEN NOT {WANTED} THEN 'pattern_filter' ELSE 'kept' END AS reason, count(*) AS n FROM f GROUP BY 1""",
    "scan_skip_counts": """WITH s AS (SELECT DISTINCT discovery_id, repo, skip_reasons FROM discovery WHERE skip_reasons IS NOT NULL),
        e AS (SELECT repo, unnest(map_keys(skip_reasons)) AS reason, unnest(map_values(skip_reasons)) AS n FROM s)
        SELECT repo, lower(trim(reason)) AS reason, sum(n)::BIGINT AS n FROM e GROUP BY 1, 2""",
    "tracked_files": f"{F_SQL} SELECT file_id, path FROM f WHERE file_id IN (SELECT file_id FROM run_files)",
    "assert_include": f"{F_SQL} {_ASSERT}",
    "tier_match": f"{T_SQL} SELECT file_id, tier, {_TIER_KEY} AS tier_key FROM t",
    "tier_counts": f"{T_SQL} SELECT repo, tier, count(*) AS n_files, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM t GROUP BY repo, tier",
    "tier_explain": _tier_explain_sql(),
    "language_breakdown": f"""{F_SQL} SELECT {lookup_sql(ENDING, COMPRESSOR_LANGUAGES, "''")} AS compressor, {lookup_sql(f'lower({ENDING})', FENCE_LANGUAGES, "''")} AS fence,
        count(*) AS n_files, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM f GROUP BY 1, 2""",
    "token_estimates": f"{F_SQL} SELECT file_id, tokens, (n_bytes + 3) // 4 AS tokens_ceil, format('{{:,}}', n_bytes) AS shown FROM f WHERE n_bytes IS NOT NULL",
    "tier_token_report": f"""{T_SQL}, g AS (SELECT repo, tier, count(*) AS n_files, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM t GROUP BY repo, tier)
        SELECT repo, tier, n_files, tokens, CASE WHEN sum(tokens) OVER (PARTITION BY repo) > 0 THEN tokens * 100 // (sum(tokens) OVER (PARTITION BY repo))::BIGINT ELSE 0 END AS percent FROM g""",
    "top_files_by_tokens": f"{F_SQL} SELECT file_id, path, tokens FROM f WHERE tokens IS NOT NULL ORDER BY tokens DESC, path, file_id LIMIT 10",
    "token_heatmap": f"{F_SQL} SELECT file_id, path, tokens, coalesce(n_lines, 0) AS n_lines, CASE WHEN n_lines > 0 THEN round(tokens::DOUBLE / n_lines, 6) ELSE 0.0 END AS density FROM f WHERE tokens IS NOT NULL",
    "document_overhead": f"{F_SQL} SELECT repo, 200 + count(*) * 35 AS overhead_tokens FROM f GROUP BY repo",
    "pipeline_stats": f"""{F_SQL} SELECT repo, count(*) AS n_files, coalesce(sum(tokens), 0)::BIGINT AS tokens, sum(is_binary::INT)::BIGINT AS n_binary,
        CASE WHEN count(error) > 0 THEN 2 ELSE 0 END AS exit_code FROM f GROUP BY repo""",
    "budget_truncate": f"""{_TRUNCATE} SELECT file_id, repo, tier, path, tokens, status, CASE WHEN status = 'truncated' THEN space::BIGINT END AS room FROM b""",
    "budget_tier_stats": f"""{_CUT} SELECT repo, tier, sum((status <> 'excluded')::INT)::BIGINT AS n_included, sum((status = 'excluded')::INT)::BIGINT AS n_excluded,
        sum(used)::BIGINT AS tokens_included FROM us GROUP BY repo, tier""",
    "budget_unlimited": f"{T_SQL} SELECT repo, 'included' AS status, count(*) AS n_files, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM t GROUP BY repo",
    "budget_truncated_files": f"{_CUT} SELECT file_id, space::BIGINT AS room, strlen(content) // 4 AS tokens, md5(content) AS content_md5 FROM tx",
    "budget_skip": f"""{_NUMBERED}, w AS (
        SELECT o.*, CASE WHEN coalesce(tokens, 0) <= {_LIMIT} THEN 'included' ELSE 'excluded' END AS status, {_LIMIT} - CASE WHEN coalesce(tokens, 0) <= {_LIMIT} THEN coalesce(tokens, 0) ELSE 0 END AS left_over FROM o WHERE k = 1
        UNION ALL
        SELECT o.*, CASE WHEN coalesce(o.tokens, 0) <= w.left_over THEN 'included' ELSE 'excluded' END, w.left_over - CASE WHEN coalesce(o.tokens, 0) <= w.left_over THEN coalesce(o.tokens, 0) ELSE 0 END
        FROM w JOIN o ON o.repo = w.repo AND o.k = w.k + 1)
        SELECT file_id, repo, tier, path, tokens, status FROM w""",
    "split_parts": _SPLIT,
    "split_part_sizes": f"SELECT repo, part_no, count(*) AS n_files, sum(tokens)::BIGINT AS tokens FROM ({_SPLIT}) GROUP BY repo, part_no",
    "dir_tristate": f"{_SELECTED} SELECT repo, dir, n_files, state FROM s",
    "selection_patterns": f"""{_SELECTED}, whole AS (SELECT repo, dir FROM s WHERE state = 'included')
        SELECT repo, dir || '/**' AS pattern FROM whole w WHERE NOT EXISTS (SELECT 1 FROM whole x WHERE x.repo = w.repo AND x.dir = regexp_extract(w.dir, '^(?:(.*)/)?[^/]*$', 1))
        UNION ALL SELECT repo, path FROM parts q WHERE included AND NOT EXISTS (SELECT 1 FROM whole x WHERE x.repo = q.repo AND x.dir = regexp_extract(q.path, '^(?:(.*)/)?[^/]*$', 1))""",
    "tree_nodes": f"""{F_SQL}, {_DIRS}, g AS (SELECT repo, dir, count(*) AS n_files, sum(tokens)::BIGINT AS tokens FROM d GROUP BY repo, dir)
        SELECT repo, regexp_extract(dir, '^(?:(.*)/)?[^/]*$', 1) AS parent, regexp_extract(dir, '([^/]*)$', 1) AS name, TRUE AS is_dir, n_files, tokens FROM g
        UNION ALL SELECT repo, regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1), regexp_extract(path, '([^/]*)$', 1), FALSE, 1, tokens FROM f""",
    "module_map": f"""{F_SQL}, m AS (SELECT repo, regexp_extract(path, '^([^/]*)', 1) AS module, lower({ENDING}) AS e FROM f WHERE contains(path, '/')),
        g AS (SELECT repo, module, count(*) AS n_files, {lookup_sql('module', KNOWN_DIRECTORIES, 'NULL')} AS known,
                max((e = 'go')::INT) AS go_, max((e IN ('ts', 'tsx'))::INT) AS ts_, max((e = 'py')::INT) AS py_, max((e = 'rs')::INT) AS rs_, max((e = 'md')::INT) AS md_ FROM m GROUP BY repo, module)
        SELECT repo, module, coalesce(known, CASE WHEN go_ = 1 THEN 'Go package' WHEN ts_ = 1 THEN 'TypeScript module' WHEN py_ = 1 THEN 'Python package' WHEN rs_ = 1 THEN 'Rust module'
               WHEN md_ = 1 THEN 'Documentation' ELSE 'Project directory' END) AS description, n_files FROM g WHERE NOT starts_with(module, '.') OR known IS NOT NULL""",
    "health_checks": f"""{F_SQL}, c AS (SELECT repo, sum((is_binary AND coalesce(n_bytes, 0) > 1048576)::INT)::BIGINT AS a, coalesce(sum((NOT is_binary AND n_bytes > 512000)::INT), 0)::BIGINT AS b,
          sum(regexp_matches(path, '(^|/)(node_modules|dist|build|target|coverage|__pycache__|\\.next)(/|$)')::INT)::BIGINT AS c FROM f GROUP BY repo)
        SELECT repo, 'large_binaries' AS "check", a AS n_found FROM c UNION ALL SELECT repo, 'oversized_text', b FROM c UNION ALL SELECT repo, 'build_artifacts', c FROM c""",
    "quality_coverage": f"""{F_SQL}, w AS (SELECT DISTINCT item_id, unnest(critical_files) AS pattern FROM golden_questions),
        h AS (SELECT item_id, count(*) AS n_critical, sum((pattern IN (SELECT path FROM f WHERE path IS NOT NULL))::INT)::BIGINT AS n_included FROM w GROUP BY item_id)
        SELECT i.item_id, coalesce(n_critical, 0)::BIGINT AS n_critical, coalesce(n_included, 0)::BIGINT AS n_included, coalesce(n_included, 0) >= coalesce(n_critical, 0) AS covered
        FROM (SELECT DISTINCT item_id FROM golden_questions) i LEFT JOIN h USING (item_id)""",
    "slice_budget": f"""{F_SQL}, s AS (SELECT repo, path, tokens, starts_with(path, 'src/') AS is_primary FROM f WHERE tokens IS NOT NULL),
        u AS (SELECT repo, sum(tokens) AS used FROM s WHERE is_primary GROUP BY repo),
        r AS (SELECT *, sum(tokens) OVER (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING) AS running FROM s WHERE NOT is_primary)
        SELECT repo, path, tokens, is_primary FROM s WHERE is_primary
        UNION ALL SELECT r.repo, path, tokens, is_primary FROM r LEFT JOIN u ON u.repo = r.repo WHERE running <= {SLICE} - coalesce(used, 0) AND {SLICE} - coalesce(used, 0) > 0""",
}
ORACLES["quality_percent"] = f"SELECT count(*) AS n_questions, sum(covered::INT)::BIGINT AS n_covered, round(sum(covered::INT) * 100.0 / count(*), 6)::DOUBLE AS percent FROM ({ORACLES['quality_coverage']})"
ORACLES |= {
    "inclusion_summary": f"""{_CUT}, g AS (SELECT repo, tier, sum((status <> 'excluded')::INT)::BIGINT AS n_included, sum((status = 'excluded')::INT)::BIGINT AS n_excluded,
          sum(used)::BIGINT AS tokens FROM us GROUP BY repo, tier), h AS (SELECT *, sum(tokens) OVER (PARTITION BY repo)::BIGINT AS total FROM g)
        SELECT repo, {_TIER_KEY} AS tier_key, n_included, n_excluded, CASE WHEN total > 0 THEN tokens * 100 // total ELSE 0 END AS percent FROM h""",
    "metadata_files": f"{T_SQL} SELECT repo, coalesce(sum(tokens), 0)::BIGINT AS tokens, round(sum(tokens) * 100.0::DOUBLE / {BUDGET}.0::DOUBLE, 4) AS percent, min(path) AS first_path FROM t GROUP BY repo",
    "metadata_entries": f"{T_SQL} SELECT repo, path, tier, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(n_bytes, 0)::BIGINT AS bytes FROM t WHERE path IS NOT NULL",
    "budget_info": f"{T_SQL} SELECT repo, coalesce(sum(tokens), 0)::BIGINT AS total_tokens, {BUDGET}::BIGINT AS max_tokens, round(sum(tokens) * 100.0::DOUBLE / {BUDGET}.0::DOUBLE, 4) AS budget_used_percent FROM t GROUP BY repo",
    "preview_records": f"""{T_SQL}, g AS (SELECT repo, tier, count(*) AS n, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM t GROUP BY repo, tier)
        SELECT repo, '{{"total_files":' || sum(n) || ',"total_tokens":' || sum(tokens) || ',"tiers":{{' || string_agg('"' || tier || '":' || n, ',' ORDER BY tier) || '}}}}' AS record FROM g GROUP BY repo""",
    "verify_sample": f"{F_SQL} SELECT file_id, repo, path FROM f WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY md5(path || '|s')) <= 5",
    "decision_trace": f"""{T_SQL}, d AS (SELECT *, CASE WHEN {IGNORED} THEN 'default ignore' WHEN {matches('path', glob_regex('**/*.sql'))} THEN 'profile ignore'
          WHEN NOT {matches('path', any_regex(glob_regex(g) for g in ('**/*.go', '**/*.sql', '**/*.md', 'docs/**')))} THEN 'not included' ELSE 'kept' END AS decision FROM t)
        SELECT file_id, path, decision, CASE WHEN decision = 'kept' THEN tier ELSE -1 END AS tier, decision = 'kept' AND {matches('path', glob_regex('README*'))} AS is_priority,
          decision = 'kept' AND NOT {matches('path', glob_regex('docs/**'))} AS is_redacted, {lookup_sql(ENDING, COMPRESSOR_LANGUAGES, "''")} AS language FROM d""",
    "fuzzy_search": f"{F_SQL} SELECT file_id, path FROM f WHERE regexp_matches(lower(path), 's.*r.*c.*c.*o.*[.].*g.*o')",
}
