"""Queries over snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contextloom.operators import changes as ops
from contextloom.operators.snapshots import normal_hash, normal_path, series_positions, snapshot_changes
from contextloom.operators.workflows import snapshot_listing, stale_states as stale_states_of, workspace_document, workspace_edges
from contextloom.sources.tables import table
from contextloom.storage import shared_dir
from contextloom.streaming import changes as streaming

#: Common table expressions that give each snapshot's rows and its predecessor, in SQL.
SNAPSHOT_SQL = r"""
heads AS (
  SELECT DISTINCT snapshot_id, repo, profile_name, git_branch, CAST(generated_at AS TIMESTAMPTZ) AS instant, received_at
  FROM snapshots WHERE snapshot_id IS NOT NULL),
ordered AS (
  SELECT snapshot_id, lag(snapshot_id) OVER (PARTITION BY repo, profile_name, git_branch ORDER BY instant, received_at, snapshot_id) AS previous_id
  FROM heads),
cleaned AS (
  SELECT snapshot_id, regexp_replace(path, '^\./', '') AS path, received_at,
         coalesce(nullif(ltrim(regexp_replace(regexp_replace(lower(content_hash), '\s+', '', 'g'), '^0x', ''), '0'), ''),
                  CASE WHEN content_hash IS NOT NULL THEN '0' END) AS hash
  FROM snapshot_files WHERE path IS NOT NULL),
latest AS (
  SELECT snapshot_id, path, hash FROM (
    SELECT *, row_number() OVER (PARTITION BY snapshot_id, path ORDER BY received_at DESC, hash DESC NULLS LAST) AS rn FROM cleaned)
  WHERE rn = 1)"""

P5_SQL = f"""
WITH {SNAPSHOT_SQL},
pairs AS (SELECT snapshot_id, previous_id FROM ordered WHERE previous_id IS NOT NULL),
cur AS (SELECT p.snapshot_id, l.path, l.hash FROM pairs p JOIN latest l ON l.snapshot_id = p.snapshot_id),
prev AS (SELECT p.snapshot_id, l.path, l.hash FROM pairs p JOIN latest l ON l.snapshot_id = p.previous_id)
SELECT coalesce(c.snapshot_id, p.snapshot_id) AS snapshot_id, coalesce(c.path, p.path) AS path,
       CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_kind
FROM cur c FULL JOIN prev p ON c.snapshot_id = p.snapshot_id AND c.path = p.path
WHERE p.path IS NULL OR c.path IS NULL OR c.hash <> p.hash"""


def p5_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "snapshot_files"))


#: A name-status listing, for the parser.
LISTING = ("A\tsrc/new.go", "M\tREADME.md", "D\tdocs/old.md", "R100\tlib/a.py\tlib/b.py", "C075\tsrc/x.ts\tsrc/y.ts", "R061\tREADME.md\tdocs/README.md")


def snapshot_change_counts(spark, sf_dir):
    """Added, modified, deleted paths of each snapshot that changed anything."""
    return p5_found(spark, sf_dir).groupBy("snapshot_id").agg(*[F.sum((F.col("change_kind") == k).cast("long")).alias(f"n_{k}") for k in ("added", "modified", "deleted")])


def _ends(spark, sf_dir):
    """Rows of the first and of the last snapshot of each series."""
    places = series_positions(table(spark, sf_dir, "snapshots"))
    rows = table(spark, sf_dir, "snapshot_files").where("path IS NOT NULL").select("snapshot_id", normal_path(F.col("path")).alias("path"), normal_hash(F.col("content_hash")).alias("hash"))
    joined = rows.join(places, "snapshot_id")
    return [joined.where(w).select("series", "path", "hash") for w in ("pos = 1", "next_id IS NULL")]


def state_compare(spark, sf_dir):
    """The first state of each series against its last, all kinds of change."""
    return ops.compared_states(*_ends(spark, sf_dir), "series").groupBy("change").agg(F.count("*").alias("n"))


def _listing(spark):
    return ops.name_status(spark.createDataFrame([(x,) for x in LISTING], "line string"))


def git_name_status(spark, sf_dir):
    return _listing(spark)


def git_changes(spark, sf_dir):
    return ops.changes_of_status(_listing(spark))


def _summarised(spark, sf_dir):
    """Each snapshot that has a predecessor: its changed paths by kind, in order, and how many paths have an equal hash in both.

    A snapshot's paths that are neither added nor modified were there before; of those, the ones whose hashes are
    both null or of which one is null don't count as equal numbers but as no change, so they are unchanged too.
    """
    snapshots, rows = table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "snapshot_files")
    later = series_positions(snapshots).where("pos > 1").select("snapshot_id").distinct()
    present = rows.where("path IS NOT NULL").select("snapshot_id", normal_path(F.col("path")).alias("path")).distinct().groupBy("snapshot_id").agg(F.count("*").alias("n_paths"))
    kinds = ("added", "modified", "deleted")
    changed = p5_found(spark, sf_dir).groupBy("snapshot_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("change_kind") == k, F.col("path")))).alias(k) for k in kinds])
    none = F.array().cast("array<string>")
    listed = later.join(changed, "snapshot_id", "left").join(present, "snapshot_id", "left").select("snapshot_id", "n_paths", *[F.coalesce(k, none).alias(k) for k in kinds])
    return listed.withColumn("unchanged", F.coalesce("n_paths", F.lit(0)) - F.size("added") - F.size("modified"))


def change_summary(spark, sf_dir):
    """The summary of each snapshot's changes as Markdown; lists are ordered by path."""
    listed = _summarised(spark, sf_dir)
    return listed.select("snapshot_id", F.md5(ops.summary_markdown(*[F.col(c) for c in ("added", "modified", "deleted", "unchanged")])).alias("summary_md5"))


def change_summary_xml(spark, sf_dir):
    listed = _summarised(spark, sf_dir)
    return listed.select("snapshot_id", F.md5(ops.summary_xml(*[F.col(c) for c in ("added", "modified", "deleted", "unchanged")])).alias("summary_md5"))


def cached_states(spark, sf_dir):
    return snapshot_listing(table(spark, sf_dir, "snapshots")).select("repo", "profile_name", "n_snapshots", "head")


def stale_states(spark, sf_dir):
    return stale_states_of(table(spark, sf_dir, "snapshots"))


def _workspace(spark, sf_dir):
    """Repositories of a workspace: here, those whose runs name a target, each integrated with its targets and with the first repository of each."""
    runs = table(spark, sf_dir, "runs").select("repo", "target").where("target IS NOT NULL AND repo IS NOT NULL").distinct()
    first = runs.groupBy("target").agg(F.min("repo").alias("first"))
    links = runs.join(first, "target")
    both = links.select("repo", F.concat(F.lit("target/"), "target").alias("to")).union(links.where("repo <> first").select("repo", "first"))
    return both.groupBy("repo").agg(F.collect_set("to").alias("integrates_with")).unionByName(runs.select("repo").distinct().join(both.select("repo"), "repo", "left_anti").select("repo", F.array().cast("array<string>").alias("integrates_with")))


def workspace_links(spark, sf_dir):
    return workspace_edges(_workspace(spark, sf_dir).withColumnRenamed("repo", "name"))


def workspace_documents(spark, sf_dir):
    empty = F.array().cast("array<string>")
    repos = _workspace(spark, sf_dir).select(
        F.col("repo").alias("name"), F.lit(None).cast("string").alias("path"), F.lit("A repository").alias("description"), empty.alias("entrypoints"), empty.alias("docs"), F.sort_array("integrates_with").alias("integrates_with"), empty.alias("shared_schemas")
    )
    return workspace_document(repos, "all").select(F.md5("document").alias("document_md5"), "tokens")


def deliveries_by_hour(spark, sf_dir):
    """The windowed count of a delivery stream, over the table at rest."""
    counted = streaming.counted_by_window(table(spark, sf_dir, "files").where("ingested_at IS NOT NULL"))
    return counted.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "repo", "n")


def streamed_changes(spark, sf_dir):
    """The files table as a stream of deliveries, followed to its end."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "files").schema
    query = streaming.follow_changes(streaming.delivered(spark, f"{sf_dir}/files.parquet*", schema), folder, f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/changes").groupBy("change").agg(F.count("*").alias("n"))


_STATUS = """WITH l(path, old_path, status) AS (VALUES ('src/new.go', NULL, 'added'), ('README.md', NULL, 'modified'), ('docs/old.md', NULL, 'deleted'), ('lib/b.py', 'lib/a.py', 'renamed'),
  ('src/y.ts', NULL, 'added'), ('docs/README.md', 'README.md', 'renamed'))"""
_LIST = lambda title, kind: f"CASE WHEN count(*) FILTER (change_kind = '{kind}') > 0 THEN chr(10) || '### {title} Files' || chr(10) || string_agg('- `' || path || '`' || chr(10), '' ORDER BY path) FILTER (change_kind = '{kind}') ELSE '' END"

_ESCAPED = """replace(replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""


def _xml_list(tag: str) -> str:
    items = f"""string_agg('    <file path="' || {_ESCAPED} || '"/>' || chr(10), '' ORDER BY path) FILTER (change_kind = '{tag}')"""
    return f"CASE WHEN count(*) FILTER (change_kind = '{tag}') > 0 THEN '  <{tag}_files>' || chr(10) || {items} || '  </{tag}_files>' || chr(10) ELSE '' END"


_SUMMARY_SQL = f"""WITH x AS ({P5_SQL}), {SNAPSHOT_SQL},
c AS (SELECT snapshot_id, count(*) FILTER (change_kind = 'added') AS a, count(*) FILTER (change_kind = 'modified') AS m, count(*) FILTER (change_kind = 'deleted') AS d,
  {_LIST('Added', 'added')} AS la, {_LIST('Modified', 'modified')} AS lm, {_LIST('Deleted', 'deleted')} AS ld, {_xml_list('added')} AS xa, {_xml_list('modified')} AS xm, {_xml_list('deleted')} AS xd
  FROM x GROUP BY snapshot_id),
eq AS (SELECT o.snapshot_id, count(*) AS u FROM ordered o JOIN latest l ON l.snapshot_id = o.snapshot_id JOIN latest p ON p.snapshot_id = o.previous_id AND p.path = l.path
  WHERE NOT coalesce(l.hash <> p.hash, FALSE) GROUP BY o.snapshot_id),
z AS (SELECT o.snapshot_id, coalesce(a, 0) AS a, coalesce(m, 0) AS m, coalesce(d, 0) AS d, coalesce(u, 0) AS u, coalesce(la, '') AS la, coalesce(lm, '') AS lm, coalesce(ld, '') AS ld,
  coalesce(xa, '') AS xa, coalesce(xm, '') AS xm, coalesce(xd, '') AS xd FROM (SELECT snapshot_id FROM ordered WHERE previous_id IS NOT NULL) o LEFT JOIN c USING (snapshot_id) LEFT JOIN eq USING (snapshot_id))"""


_WORKSPACE_SQL = """wr AS (SELECT DISTINCT repo, target FROM runs WHERE target IS NOT NULL AND repo IS NOT NULL), wf AS (SELECT target, min(repo) AS hub FROM wr GROUP BY target),
we AS (SELECT DISTINCT repo, 'target/' || target AS dst FROM wr UNION SELECT DISTINCT repo, hub FROM wr JOIN wf USING (target) WHERE repo <> hub)"""

QUERIES = {
    f.__name__: f
    for f in (p5_found, snapshot_change_counts, state_compare, git_name_status, git_changes, change_summary, change_summary_xml, cached_states, stale_states, workspace_links, workspace_documents, streamed_changes, deliveries_by_hour)
}
ORACLES = {
    "p5_found": P5_SQL,
    "snapshot_change_counts": f"SELECT snapshot_id, " + ", ".join(f"sum((change_kind = '{k}')::INT)::BIGINT AS n_{k}" for k in ("added", "modified", "deleted")) + f" FROM ({P5_SQL}) GROUP BY snapshot_id",
    "git_name_status": f"{_STATUS} SELECT * FROM l",
    "git_changes": f"{_STATUS} SELECT path, status AS change FROM l WHERE status <> 'renamed' UNION SELECT old_path, 'deleted' FROM l WHERE status = 'renamed' UNION SELECT path, 'added' FROM l WHERE status = 'renamed'",
    "change_summary": f"""{_SUMMARY_SQL} SELECT snapshot_id, md5(CASE WHEN a + m + d = 0 THEN 'No changes detected since last run.' || chr(10) ELSE '**' || a || ' added** | **' || m || ' modified** | **'
        || d || ' deleted** (' || u || ' unchanged)' || chr(10) || la || lm || ld END) AS summary_md5 FROM z""",
    "workspace_links": f"WITH {_WORKSPACE_SQL} SELECT repo AS src, dst, dst IN (SELECT repo FROM wr) AS is_known FROM we",
    "workspace_documents": f"""WITH {_WORKSPACE_SQL}, b AS (SELECT repo, string_agg(dst, ', ' ORDER BY dst) AS links FROM we GROUP BY repo),
        d AS (SELECT '# Workspace: all' || chr(10) || chr(10) || '## Repositories' || chr(10) || chr(10)
          || string_agg('### ' || repo || chr(10) || '- **Description:** A repository' || chr(10) || '- **Integrates with:** ' || links || chr(10), chr(10) ORDER BY repo) || chr(10)
          || chr(10) || '## Integrations' || chr(10) || chr(10) || string_agg('- ' || repo || ' → ' || links, chr(10) ORDER BY repo) || chr(10) AS document FROM b)
        SELECT md5(document) AS document_md5, (strlen(document) + 3) // 4 AS tokens FROM d""",
    "cached_states": """WITH s AS (SELECT DISTINCT snapshot_id, repo, profile_name, CAST(generated_at AS TIMESTAMPTZ) AS instant, coalesce(git_head_sha, '') AS head FROM snapshots WHERE snapshot_id IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY repo, profile_name ORDER BY instant DESC, snapshot_id DESC) AS k FROM s)
        SELECT repo, profile_name, count(DISTINCT snapshot_id) AS n_snapshots, substring(max(CASE WHEN k = 1 THEN head END), 1, 7) AS head FROM r GROUP BY repo, profile_name""",
    "state_compare": f"""WITH {SNAPSHOT_SQL},
        e AS (SELECT h.snapshot_id, h.repo, h.profile_name, h.git_branch, row_number() OVER w AS a, count(*) OVER (PARTITION BY repo, profile_name, git_branch) AS n FROM heads h WINDOW w AS (PARTITION BY repo, profile_name, git_branch ORDER BY instant, received_at, snapshot_id)),
        x AS (SELECT repo, profile_name, git_branch, path, max(hash) AS hash FROM cleaned c JOIN e ON e.snapshot_id = c.snapshot_id WHERE a = 1 GROUP BY ALL),
        y AS (SELECT repo, profile_name, git_branch, path, max(hash) AS hash FROM cleaned c JOIN e ON e.snapshot_id = c.snapshot_id WHERE a = n GROUP BY ALL)
        SELECT CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'deleted' WHEN x.hash IS NOT DISTINCT FROM y.hash THEN 'unchanged' ELSE 'modified' END AS change, count(*) AS n
        FROM x FULL JOIN y ON x.repo = y.repo AND x.profile_name = y.profile_name AND x.git_branch = y.git_branch AND x.path = y.path GROUP BY 1""",
}
ORACLES["stale_states"] = """WITH s AS (SELECT DISTINCT snapshot_id, repo, CAST(generated_at AS TIMESTAMPTZ) AS instant FROM snapshots WHERE snapshot_id IS NOT NULL)
    SELECT repo, count(DISTINCT snapshot_id) AS n_states, count(DISTINCT CASE WHEN instant < (SELECT max(instant) FROM s) - INTERVAL 7 DAY THEN snapshot_id END) AS n_stale FROM s GROUP BY repo"""
ORACLES["deliveries_by_hour"] = "SELECT strftime(date_trunc('hour', ingested_at), '%Y-%m-%d %H:%M:%S') AS hour, repo, count(*) AS n FROM files WHERE ingested_at IS NOT NULL GROUP BY ALL"
ORACLES["streamed_changes"] = "SELECT 'added' AS change, count(*) AS n FROM (SELECT DISTINCT repo, path FROM files WHERE path IS NOT NULL)"
ORACLES["change_summary_xml"] = f"""{_SUMMARY_SQL} SELECT snapshot_id, md5('<change_summary>' || chr(10) || '  <counts added="' || a || '" modified="' || m
  || '" deleted="' || d || '" unchanged="' || u || '"/>' || chr(10) || xa || xm || xd || '</change_summary>' || chr(10)) AS summary_md5 FROM z"""
