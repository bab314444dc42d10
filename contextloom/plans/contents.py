"""Queries that read contents: redaction, compression, rendering, verification, hashes, imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from contextloom.functions import entropy
from contextloom.functions.hashing import xxh3_hex
from contextloom.functions.rules import BUILT_IN
from contextloom.functions.tables import ENTROPY_THRESHOLDS, FENCE_LANGUAGES, IMPORT_ENDINGS, INDEX_FILES, SIGNATURE_PATTERNS, SUSPICIOUS_WORDS, COMPRESSOR_LANGUAGES, TIER_KEYS
from contextloom.functions.text import numbered_lines
from contextloom.functions.tokenizers import token_count
from contextloom.operators import budget, compression, imports, redaction, relevance, render, trees, verify, workflows
from contextloom.operators.descriptors import descriptors
from contextloom.plans.files import ENDING, lookup_sql, matches, q, split_sql, tier_sql
from contextloom.sources.tables import spread, table
from contextloom.storage import materialize

#: Contents once per file, for oracles: a common table expression named ``c``.
C_SQL = """WITH RECURSIVE c AS (SELECT file_id, max(repo) AS repo, max(path) AS path, max(content) AS content, max(coalesce(is_compressed, FALSE)::INT) = 1 AS is_compressed
  FROM files WHERE file_id IS NOT NULL AND content IS NOT NULL GROUP BY file_id)"""
TOKEN = r"[^ \t\n\r=:\"']{16,}"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "files")


#: Session setting that names a public vocabulary's file, readable on every executor, and where the test machine keeps one.
VOCABULARY_SETTING, VOCABULARY = "contextloom.vocabulary", "/opt/tokenizers/byte_bpe_50k.json"


def tokenizer_counts(spark, sf_dir):
    """Tokens of each file by a public tokenizer beside the estimate; a vocabulary that isn't there fails."""
    path = spark.conf.get(VOCABULARY_SETTING, VOCABULARY)
    rows = spread(_files(spark, sf_dir).where("file_id IS NOT NULL AND content IS NOT NULL").select("file_id", "content"), "file_id")
    return rows.select("file_id", token_count(F.col("content"), path).alias("tokens"), token_count(F.col("content")).alias("estimate")).distinct()


def rule_hits(spark, sf_dir):
    return redaction.rule_hits(_files(spark, sf_dir))


def redaction_matches(spark, sf_dir):
    return redaction.redaction_matches(_files(spark, sf_dir), "low")


def redaction_excluded(spark, sf_dir):
    """The same where the profile leaves lock files alone."""
    return redaction.redaction_matches(_files(spark, sf_dir), "low", exclude=("**/*.lock",)).groupBy("file_id").agg(F.count("*").alias("n"))


def redaction_by_type(spark, sf_dir):
    return redaction.redaction_summary(redaction.redaction_matches(_files(spark, sf_dir), "low"))


def redaction_by_confidence(spark, sf_dir):
    found = redaction.redaction_matches(_files(spark, sf_dir), "medium")
    return found.groupBy("confidence").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def redaction_reports(spark, sf_dir):
    matches = redaction.redaction_matches(_files(spark, sf_dir), "medium")
    return redaction.redaction_reports(matches, descriptors(_files(spark, sf_dir)).where("path IS NOT NULL"))


def redacted_contents(spark, sf_dir):
    done = redaction.redacted_contents(_files(spark, sf_dir), "medium")
    return done.select("file_id", F.md5("content").alias("content_md5"), "n_redactions").distinct()


def _tokens(spark, sf_dir):
    """Long tokens of all contents, and whether they stand on a line that mentions secrets; once per file before the shuffle."""
    files = spread(_files(spark, sf_dir).where("file_id IS NOT NULL AND content IS NOT NULL").select("file_id", "content"), "file_id")
    # a line is judged once and left behind, not carried along with each of its tokens
    lines = files.select("file_id", F.explode(F.split("content", "\n")).alias("line")).select(
        "file_id", entropy.is_suspicious(F.col("line")).alias("suspicious"), F.array_distinct(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("tokens")
    )
    found = lines.where(F.size("tokens") > 0).select("file_id", "suspicious", F.explode("tokens").alias("token"))
    return found.groupBy("file_id", "token").agg(F.max("suspicious").alias("suspicious"))


def entropy_scores(spark, sf_dir):
    bits, kind = entropy.shannon_entropy(F.col("token")), entropy.charset(F.col("token"))
    return _tokens(spark, sf_dir).select("file_id", "token", kind.alias("charset"), F.round(bits, 6).alias("bits"), entropy.entropy_threshold(kind, F.col("suspicious")).alias("threshold"))


def charset_classes(spark, sf_dir):
    return _tokens(spark, sf_dir).select("token").distinct().groupBy(entropy.charset(F.col("token")).alias("charset")).agg(F.count("*").alias("n"))


def declaration_lines(spark, sf_dir):
    return compression.declaration_lines(_files(spark, sf_dir))


def signature_rows(spark, sf_dir):
    return compression.signature_rows(_files(spark, sf_dir)).select("file_id", "kind", "name", "start_line", "end_line")


def regex_signatures(spark, sf_dir):
    return compression.signature_rows(_files(spark, sf_dir), "regex").select("file_id", "kind", "start_line", "end_line")


def compression_report(spark, sf_dir):
    return compression.compression_stats(compression.compressed_files(_files(spark, sf_dir)))


def compression_savings(spark, sf_dir):
    return compression.compression_savings(compression_report(spark, sf_dir))


def _renderable(spark, sf_dir):
    return render.renderable(_files(spark, sf_dir), relevance.tier_of(F.col("path")))


def line_numbers(spark, sf_dir):
    rows = _files(spark, sf_dir).where("content IS NOT NULL AND file_id IS NOT NULL")
    return rows.select("file_id", F.md5(numbered_lines(F.col("content"))).alias("text_md5")).distinct()


def markdown_blocks(spark, sf_dir):
    return _renderable(spark, sf_dir).select("file_id", F.md5(render.markdown_block()).alias("block_md5")).distinct()


def xml_blocks(spark, sf_dir):
    return _renderable(spark, sf_dir).select("file_id", F.md5(render.xml_block()).alias("block_md5")).distinct()


#: Tokens of one part of a document.
DOCUMENT_PART = 50_000


def _parted(spark, sf_dir, block, name):
    """Blocks of all files, each in the part of its repository's document, and the narrow rows of the parts' members."""
    blocks = materialize(_renderable(spark, sf_dir).select("file_id", "repo", "tier", "path", "tokens", "n_bytes", block.alias("block")), name)
    members = blocks.select("file_id", "repo", "tier", "path", "tokens", "n_bytes").dropDuplicates(["file_id"])
    parts = materialize(budget.split_parts(members, DOCUMENT_PART).select("file_id", "part_no"), f"{name}-parts")
    return blocks.join(parts, "file_id"), members.join(parts, "file_id")


def _documents(spark, sf_dir):
    blocks, members = _parted(spark, sf_dir, render.markdown_block(), "markdown-blocks")
    return render.documents(blocks, render.document_heads(members, render.repository_hash(_files(spark, sf_dir))))


def markdown_documents(spark, sf_dir):
    """Each part of each repository's document, over all files."""
    return _documents(spark, sf_dir).select("repo", "part_no", F.md5("document").alias("document_md5"), F.octet_length("document").alias("n_bytes"))


def document_heads(spark, sf_dir):
    """Heads with the tree to a depth of three and the masked secrets."""
    _, members = _parted(spark, sf_dir, F.lit(""), "head-blocks")
    masked = redaction.redaction_matches(_files(spark, sf_dir), "medium").join(members.select("file_id", "repo"), "file_id").groupBy("repo", "secret_type").agg(F.count("*").alias("n"))
    return render.document_heads(members, None, masked, trees.repository_trees(members, 3))


def parsed_markdown_files(spark, sf_dir):
    return render.parsed_markdown(_documents(spark, sf_dir)).select("repo", "path", F.md5("content").alias("content_md5"), "redactions")


def _xml_documents(spark, sf_dir):
    blocks, members = _parted(spark, sf_dir, render.xml_block(), "xml-blocks")
    return render.xml_documents(blocks, render.xml_heads(members, render.repository_hash(_files(spark, sf_dir))))


def xml_documents(spark, sf_dir):
    """Each part of each repository's XML document, over all files."""
    return _xml_documents(spark, sf_dir).select("repo", "part_no", F.md5("document").alias("document_md5"), F.octet_length("document").alias("n_bytes"))


def parsed_xml_files(spark, sf_dir):
    """The same files through XML documents and back."""
    return render.parsed_xml(_xml_documents(spark, sf_dir)).select("repo", "path", F.md5("content").alias("content_md5"), "redactions")


def verify_status(spark, sf_dir):
    return verify.verified(render.parsed_markdown(_documents(spark, sf_dir)), _files(spark, sf_dir))


def verify_tallies(spark, sf_dir):
    """Tallies over masked, shortened, lost and unchanged files: each file is shown in one of five ways, by its id."""
    source = _files(spark, sf_dir).where("content IS NOT NULL AND path IS NOT NULL AND file_id IS NOT NULL").select("file_id", "repo", "path", "content").dropDuplicates(["file_id"])
    way = F.pmod("file_id", F.lit(5))
    shown = (
        F.when(way == 1, F.concat(F.lit("[REDACTED:x]\n"), F.regexp_replace("content", r"^[^\n]*\n?", ""))).when(way == 2, F.concat("content", F.lit("\nmore\nlines\n"))).otherwise(F.col("content"))
    )
    parsed = source.select("repo", F.when(way == 4, F.concat(F.lit("gone/"), F.col("path"))).otherwise(F.col("path")).alias("path"), shown.alias("content"), (way == 3).alias("is_compressed"), (way == 1).cast("int").alias("redactions"))
    return verify.tallies(verify.verified(parsed, _files(spark, sf_dir)))


def verify_redacted(spark, sf_dir):
    """Masked contents against their sources."""
    masked = redaction.redacted_contents(_files(spark, sf_dir), "medium").where("n_redactions > 0").select("file_id", F.col("content").alias("shown"), "n_redactions")
    both = masked.dropDuplicates(["file_id"]).join(_files(spark, sf_dir).select("file_id", "content").dropDuplicates(["file_id"]), "file_id")
    return both.select("file_id", verify.status(F.col("content"), F.col("shown"), F.lit(False), F.col("n_redactions")).alias("status"))


def line_differences(spark, sf_dir):
    """Each file against its masked form by built-in expressions, line by line."""
    source = _files(spark, sf_dir).where("content IS NOT NULL AND file_id IS NOT NULL").select("file_id", "content").dropDuplicates(["file_id"])
    changed = F.regexp_replace("content", r"AKIA[0-9A-Z]{16}", "[REDACTED:aws_access_key_id]")
    rows = source.select("file_id", F.explode(verify.line_differences(F.col("content"), changed)).alias("d"))
    return rows.select("file_id", "d.line", "d.old", "d.new")


def content_hash_md5(spark, sf_dir):
    return render.repository_hash(_files(spark, sf_dir))


def content_hash_ordered(spark, sf_dir):
    return render.ordered_hash(_files(spark, sf_dir).where("content IS NOT NULL"))


def content_hash_xxh3(spark, sf_dir):
    return _files(spark, sf_dir).where("file_id IS NOT NULL").select("file_id", xxh3_hex(F.col("content")).alias("hash")).distinct()


def _edges(spark, sf_dir):
    files = _files(spark, sf_dir)
    return imports.import_edges(imports.imports(files), descriptors(files))


def import_targets(spark, sf_dir):
    return imports.imports(_files(spark, sf_dir))


def import_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


def test_edges(spark, sf_dir):
    return imports.test_edges(descriptors(_files(spark, sf_dir)))


def neighbours_depth2(spark, sf_dir):
    """Around the files of ``cmd/`` and every document on caches, columns and cursors."""
    paths = descriptors(_files(spark, sf_dir)).where("path IS NOT NULL").select("repo", "path")
    changed = paths.where(F.col("path").startswith("cmd/") | F.col("path").rlike(r"(^|/)c(ache|olumn|ursor)[^/]*\.md$"))
    return imports.neighbours(changed, paths, _edges(spark, sf_dir), imports.test_edges(paths), 2)


def review_slice(spark, sf_dir):
    """Changed files with their neighbours, as many as the budget takes."""
    files = descriptors(_files(spark, sf_dir)).where("path IS NOT NULL").select("repo", "path", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    paths = files.select("repo", "path")
    changed = paths.where(F.col("path").startswith("cmd/"))
    near = imports.neighbours(changed, paths, _edges(spark, sf_dir), imports.test_edges(paths), 1).select("repo", "path")
    chosen = changed.withColumn("is_primary", F.lit(True)).unionByName(near.withColumn("is_primary", F.lit(False)))
    return workflows.slice_budget(files.join(chosen, ["repo", "path"]).select("repo", "path", "tokens", "is_primary"), 6_000)


def manifest_sections(spark, sf_dir):
    return workflows.manifest_sections(_files(spark, sf_dir))


def brief_budget(spark, sf_dir):
    sections = workflows.brief_sections(_files(spark, sf_dir)).select("repo", "priority", "name", F.expr("(octet_length(content) + 3) div 4").alias("tokens"))
    return workflows.brief_budget(sections, 1_500)


QUERIES = {
    f.__name__: f
    for f in (
        tokenizer_counts, rule_hits, redaction_matches, redaction_excluded, redaction_by_type, redaction_by_confidence, redaction_reports, redacted_contents, entropy_scores, charset_classes, declaration_lines, signature_rows, regex_signatures,
        compression_report, compression_savings, line_numbers, markdown_blocks, xml_blocks, markdown_documents, xml_documents, document_heads, parsed_markdown_files, parsed_xml_files, verify_status, verify_tallies, verify_redacted, line_differences, content_hash_md5,
        content_hash_ordered, content_hash_xxh3, import_targets, import_edges, test_edges, neighbours_depth2, review_slice, manifest_sections, brief_budget,
    )
}


def _rule_hits_sql() -> str:
    rows = []
    for rule in BUILT_IN:
        guard = " OR ".join(f"contains(lower(content), {q(k)})" for k in rule.lowered)
        rows.append(f"SELECT {q(rule.rule_id)} AS rule_id, CASE WHEN {guard} THEN len(regexp_extract_all(content, {q(rule.pattern)})) ELSE 0 END AS n FROM c")
    return f"{C_SQL} SELECT rule_id, sum((n > 0)::INT)::BIGINT AS n_files, sum(n)::BIGINT AS n_hits FROM ({' UNION ALL '.join(rows)}) GROUP BY rule_id"


_TOKENS = rf"""{C_SQL}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line FROM c),
tk AS (SELECT DISTINCT file_id, line, unnest(regexp_extract_all(line, {q(TOKEN)})) AS token FROM l)"""
_CHARSET = "CASE WHEN regexp_full_match(token, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(token, '[0-9A-Za-z]+') THEN 'alphanumeric' WHEN regexp_full_match(token, '[0-9A-Za-z+/=_-]+') THEN 'base64' ELSE 'mixed' END"
_THRESHOLD = "CASE charset " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in ENTROPY_THRESHOLDS.items()) + f" END - CASE WHEN regexp_matches(lower(line), '{'|'.join(SUSPICIOUS_WORDS)}') THEN 0.5 ELSE 0 END"
_ENTROPY_SQL = f"""{_TOKENS}, k AS (SELECT *, {_CHARSET} AS charset FROM tk),
ch AS (SELECT token, unnest(string_split(substring(token, 1, 256), '')) AS x FROM (SELECT DISTINCT token FROM k)),
n AS (SELECT token, x, count(*) AS n FROM ch GROUP BY token, x), s AS (SELECT token, sum(n) AS total FROM n GROUP BY token),
b AS (SELECT n.token, -sum((n / total) * log2(n / total)) AS bits FROM n JOIN s ON s.token = n.token GROUP BY n.token)
SELECT file_id, k.token, charset, round(max(bits), 6) + 0.0 AS bits, min({_THRESHOLD})::DOUBLE AS threshold FROM k JOIN b ON b.token = k.token GROUP BY file_id, k.token, charset"""


def _declarations_sql() -> str:
    language = lookup_sql(ENDING, COMPRESSOR_LANGUAGES, "NULL")
    bare = "CASE WHEN language = 'python' THEN trim(line) ELSE line END"
    cases = " ".join(f"WHEN language = {q(lang)} AND {matches('bare', pattern)} THEN {q(kind)}" for lang, kind, pattern in SIGNATURE_PATTERNS)
    return f"""{C_SQL}, g AS (SELECT file_id, {language} AS language, content FROM c),
s AS (SELECT file_id, language, string_split(content, chr(10)) AS p FROM g WHERE language IS NOT NULL AND language NOT IN ('json', 'yaml', 'toml')),
l AS (SELECT file_id, language, unnest(p) AS line, unnest(range(1, len(p) + 1)) AS line_no FROM s),
b AS (SELECT file_id, language, line_no, {bare} AS bare FROM l WHERE language = 'python' OR NOT regexp_matches(line, '^\\s'))
SELECT file_id, line_no::INTEGER AS line_no, kind FROM (SELECT file_id, line_no, CASE {cases} END AS kind FROM b) WHERE kind IS NOT NULL"""


_TIER_KEY = "CASE tier " + " ".join(f"WHEN {n} THEN {q(k)}" for n, k in enumerate(TIER_KEYS)) + " END"
_FENCE = lookup_sql(f"lower({ENDING})", FENCE_LANGUAGES, "''")
_SIZE = "CASE WHEN n_bytes < 1024 THEN format('{} B', n_bytes) WHEN n_bytes < 1048576 THEN format('{:.1f} KB', n_bytes / 1024.0::DOUBLE) ELSE format('{:.1f} MB', n_bytes / 1048576.0::DOUBLE) END"
_R_SQL = f"{C_SQL}, r AS (SELECT file_id, repo, path, content, is_compressed, strlen(content) AS n_bytes, strlen(content) // 4 AS tokens, {tier_sql('path')} AS tier FROM c WHERE path IS NOT NULL)"
_BLOCK = f"""'### `' || path || '`' || chr(10) || chr(10) || '> **Size:** ' || {_SIZE} || ' | **Tokens:** ' || format('{{:,}}', tokens) || ' | **Tier:** ' || {_TIER_KEY} || ' | **Compressed:** '
  || CASE WHEN is_compressed THEN 'yes' ELSE 'no' END || chr(10) || chr(10) || '```' || {_FENCE} || chr(10) || replace(content, '```', '`` `') || chr(10) || '```'"""
_XML = f"""'<file path="' || replace(replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '" tokens="' || tokens || '" tier="' || {_TIER_KEY} || '" size="' || n_bytes
  || '" language="' || {_FENCE} || '" compressed="' || is_compressed || '">' || chr(10) || '<![CDATA[' || replace(content, ']]>', ']]]]><![CDATA[>') || ']]>' || chr(10) || '</file>'"""
_HASH_SQL = """hc AS (SELECT repo, path, max(md5(content)) AS digest FROM files WHERE content IS NOT NULL AND path IS NOT NULL AND repo IS NOT NULL GROUP BY repo, path),
hb AS (SELECT repo, substring(md5(path), 1, 3) AS bucket, md5(string_agg(path || ':' || digest, chr(10) ORDER BY path)) AS digest FROM hc GROUP BY ALL),
rh AS (SELECT repo, md5(string_agg(digest, chr(10) ORDER BY bucket)) AS content_hash FROM hb GROUP BY repo)"""


def _markdown_documents_sql() -> str:
    size = lambda n: _SIZE.replace("n_bytes", n)
    line = "chr(10)"
    tiers = " || ".join(f"CASE WHEN sum((tier = {t})::INT) > 0 THEN '| {t} | {key} | ' || sum((tier = {t})::INT) || ' |' || {line} ELSE '' END" for t, key in enumerate(TIER_KEYS))
    fact = lambda name, value: f"'| {name} | ' || {value} || ' |' || {line}"
    return f"""{_R_SQL}, sp AS MATERIALIZED ({split_sql(DOCUMENT_PART, source="(SELECT file_id, repo, tier, path, tokens FROM r)", recursive=False)}), {_HASH_SQL},
m AS (SELECT r.*, sp.part_no, {_BLOCK} AS block FROM (SELECT file_id, part_no FROM sp) sp JOIN r USING (file_id)),
tp AS (SELECT repo, string_agg('| ' || path || ' | ' || format('{{:,}}', tokens) || ' | ' || {size('n_bytes')} || ' |' || {line}, '' ORDER BY tokens DESC, tier, path) AS top
  FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY repo ORDER BY tokens DESC, tier, path) <= 5) GROUP BY repo),
pt AS (SELECT repo, part_no, count(*) AS n, sum(tokens)::BIGINT AS t, {tiers} AS tiers, string_agg(block, {line} || {line} ORDER BY tier, path, block) AS body FROM m GROUP BY repo, part_no),
np AS (SELECT repo, max(part_no) AS n_parts FROM pt GROUP BY repo),
d AS (SELECT repo, part_no, '# Context: ' || repo || CASE WHEN n_parts > 1 THEN ' (Part ' || part_no || ' of ' || n_parts || ')' ELSE '' END || {line} || {line} || '| Field | Value |' || {line} || '|-------|-------|' || {line}
  || {fact('Content Hash', 'content_hash')} || {fact('Profile', "'default'")} || {fact('Tokenizer', "'none'")} || {fact('Total Tokens', "format('{:,}', t)")} || {fact('Total Files', 'n')}
  || {line} || '## File Summary' || {line} || {line} || '**Total Files:** ' || n || ' | **Total Tokens:** ' || format('{{:,}}', t) || {line} || {line} || '### Files by Tier' || {line} || {line}
  || '| Tier | Label | Count |' || {line} || '|------|-------|-------|' || {line} || tiers
  || CASE WHEN part_no = 1 THEN {line} || '### Top Files by Token Count' || {line} || {line} || '| File | Tokens | Size |' || {line} || '|------|--------|------|' || {line} || top ELSE '' END
  || {line} || '## Files' || {line} || {line} || body || {line} AS document
  FROM pt JOIN np USING (repo) JOIN rh USING (repo) JOIN tp USING (repo))
SELECT repo, part_no, md5(document) AS document_md5, strlen(document) AS n_bytes FROM d"""


def _xml_documents_sql() -> str:
    size = lambda n: _SIZE.replace("n_bytes", n)
    line = "chr(10)"
    escaped = lambda c: f"""replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''''', '&apos;')"""
    tag = lambda name, value: f"'    <{name}>' || {value} || '</{name}>' || {line}"
    tiers = " || ".join(f"CASE WHEN sum((tier = {t})::INT) > 0 THEN '      <tier number=\"{t}\" label=\"{key}\" count=\"' || sum((tier = {t})::INT) || '\"/>' || {line} ELSE '' END" for t, key in enumerate(TIER_KEYS))
    name = "repo || CASE WHEN n_parts > 1 THEN ' (Part ' || part_no || ' of ' || n_parts || ')' ELSE '' END"
    return f"""{_R_SQL}, sp AS MATERIALIZED ({split_sql(DOCUMENT_PART, source="(SELECT file_id, repo, tier, path, tokens FROM r)", recursive=False)}), {_HASH_SQL},
m AS (SELECT r.*, sp.part_no, {_XML} AS block FROM (SELECT file_id, part_no FROM sp) sp JOIN r USING (file_id)),
tp AS (SELECT repo, string_agg('      <file path="' || {escaped('path')} || '" tokens="' || format('{{:,}}', tokens) || '" size="' || {size('n_bytes')} || '"/>' || {line}, '' ORDER BY tokens DESC, tier, path) AS top
  FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY repo ORDER BY tokens DESC, tier, path) <= 5) GROUP BY repo),
pt AS (SELECT repo, part_no, count(*) AS n, sum(tokens)::BIGINT AS t, {tiers} AS tiers, string_agg(block, {line} ORDER BY tier, path, block) AS body FROM m GROUP BY repo, part_no),
np AS (SELECT repo, max(part_no) AS n_parts FROM pt GROUP BY repo),
d AS (SELECT repo, part_no, '<?xml version="1.0" encoding="UTF-8"?>' || {line} || '<repository>' || {line} || '  <metadata>' || {line} || {tag('project_name', escaped(name))} || {tag('content_hash', 'content_hash')}
  || {tag('profile', "'default'")} || {tag('tokenizer', "'none'")} || {tag('total_tokens', 't')} || {tag('total_files', 'n')} || '  </metadata>' || {line}
  || '  <file_summary>' || {line} || {tag('total_files', 'n')} || {tag('total_tokens', "format('{:,}', t)")} || '    <files_by_tier>' || {line} || tiers || '    </files_by_tier>' || {line}
  || CASE WHEN part_no = 1 THEN '    <top_files>' || {line} || top || '    </top_files>' || {line} ELSE '' END || '    <redaction_summary total="0"/>' || {line} || '  </file_summary>' || {line}
  || '<files>' || {line} || body || {line} || '</files>' || {line} || '  <statistics>' || {line} || {tag('total_files', 'n')} || {tag('total_tokens', 't')} || '  </statistics>' || {line} || '</repository>' || {line} AS document
  FROM pt JOIN np USING (repo) JOIN rh USING (repo) JOIN tp USING (repo))
SELECT repo, part_no, md5(document) AS document_md5, strlen(document) AS n_bytes FROM d"""


_IMPORTS_SQL = rf"""{C_SQL}, l AS (SELECT file_id, repo, path, lower({ENDING}) AS kind, unnest(string_split(content, chr(10))) AS line FROM c WHERE lower({ENDING}) IN ('go', 'ts', 'tsx', 'js', 'jsx', 'py')),
g AS (SELECT *, regexp_extract(line, {q(imports.GO_IMPORT)}, 1) AS go_, regexp_extract(line, {q(imports.JS_IMPORT)}, 1) AS js1, regexp_extract(line, {q(imports.JS_REQUIRE)}, 1) AS js2,
             coalesce(nullif(regexp_extract(line, {q(imports.PY_IMPORT)}, 1), ''), regexp_extract(line, {q(imports.PY_IMPORT)}, 2)) AS py_ FROM l),
p AS (SELECT *, length(regexp_extract(py_, '^(\.*)', 1)) AS dots, replace(regexp_replace(py_, '^\.+', ''), '.', '/') AS rest FROM g),
x AS (
  SELECT file_id, repo, path, CASE WHEN starts_with(go_, './') OR starts_with(go_, '../') THEN go_ WHEN contains(go_, '/internal/') THEN substring(go_, instr(go_, '/internal/') + 1)
    WHEN contains(go_, '/cmd/') THEN substring(go_, instr(go_, '/cmd/') + 1) WHEN contains(go_, '/pkg/') THEN substring(go_, instr(go_, '/pkg/') + 1) END AS target FROM p WHERE kind = 'go'
  UNION ALL SELECT file_id, repo, path, CASE WHEN rest <> '' THEN repeat('../', greatest(dots - 1, 0)) || rest END FROM p WHERE kind = 'py'
  UNION ALL SELECT file_id, repo, path, js1 FROM p WHERE kind NOT IN ('go', 'py') AND (starts_with(js1, './') OR starts_with(js1, '../'))
  UNION ALL SELECT file_id, repo, path, js2 FROM p WHERE kind NOT IN ('go', 'py') AND (starts_with(js2, './') OR starts_with(js2, '../')))
SELECT DISTINCT file_id, repo, path, target FROM x WHERE target IS NOT NULL AND target <> ''"""

ORACLES = {
    "rule_hits": _rule_hits_sql(),
    "entropy_scores": _ENTROPY_SQL,
    "charset_classes": f"{_TOKENS} SELECT {_CHARSET} AS charset, count(DISTINCT token) AS n FROM tk GROUP BY 1",
    "declaration_lines": _declarations_sql(),
    "line_numbers": f"""{C_SQL}, s AS (SELECT file_id, string_split(content, chr(10)) AS p FROM c)
        SELECT file_id, md5(array_to_string(list_transform(range(1, len(p) + 1), lambda i: lpad(i::VARCHAR, length(len(p)::VARCHAR)::INTEGER, ' ') || ' | ' || p[i]), chr(10))) AS text_md5 FROM s""",
    "markdown_blocks": f"{_R_SQL} SELECT file_id, md5({_BLOCK}) AS block_md5 FROM r",
    "xml_blocks": f"{_R_SQL} SELECT file_id, md5({_XML}) AS block_md5 FROM r",
    "markdown_documents": _markdown_documents_sql(),
    "xml_documents": _xml_documents_sql(),
    "content_hash_md5": f"WITH {_HASH_SQL} SELECT repo, content_hash FROM rh",
    "import_targets": _IMPORTS_SQL,
    "line_differences": f"""{C_SQL}, s AS (SELECT file_id, string_split(content, chr(10)) AS a, string_split(regexp_replace(content, 'AKIA[0-9A-Z]{{16}}', '[REDACTED:aws_access_key_id]', 'g'), chr(10)) AS b FROM c),
        l AS (SELECT file_id, unnest(range(1, len(a) + 1)) AS line, unnest(a) AS old, unnest(b) AS new FROM s)
        SELECT file_id, line::INTEGER AS line, old, new FROM l WHERE old <> new QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line) <= 10""",
    "parsed_markdown_files": f"{C_SQL} SELECT repo, path, md5(content) AS content_md5, len(regexp_extract_all(content, '\\[REDACTED:[^\\]]*\\]'))::INTEGER AS redactions FROM c",
    "verify_status": f"{C_SQL} SELECT repo, path, 'MATCH' AS status FROM c",
    "verify_tallies": f"""{C_SQL}, w AS (SELECT CASE file_id % 5 WHEN 1 THEN CASE WHEN rtrim(content, chr(10)) = rtrim('[REDACTED:x]' || chr(10) || regexp_replace(content, '^[^\\n]*\\n?', ''), chr(10)) THEN 'MATCH' ELSE 'REDACTION_DIFF' END
          WHEN 2 THEN 'UNEXPECTED_DIFF' WHEN 3 THEN 'COMPRESSION_DIFF' WHEN 4 THEN 'FILE_CHANGED' ELSE 'MATCH' END AS status, repo FROM c WHERE path IS NOT NULL)
        SELECT repo, count(*) AS n_files, sum((status IN ('MATCH', 'REDACTION_DIFF', 'COMPRESSION_DIFF'))::INT)::BIGINT AS n_passed, sum((status IN ('UNEXPECTED_DIFF', 'FILE_CHANGED'))::INT)::BIGINT AS n_failed,
          sum((status = 'REDACTION_DIFF')::INT)::BIGINT AS n_redacted, sum((status = 'COMPRESSION_DIFF')::INT)::BIGINT AS n_compressed FROM w GROUP BY repo""",
}
ORACLES["parsed_xml_files"] = ORACLES["parsed_markdown_files"]


def _cleaned_sql(path: str) -> str:
    """Dots resolved in a path below its root; deep enough for the imports here."""
    path = f"replace('/' || {path}, '/./', '/')"
    for _ in range(8):
        path = rf"regexp_replace({path}, '/[^/.][^/]*/[.][.]/', '/')"
    return f"ltrim({path}, '/')"


_VARIANTS = ", ".join(q(x) for x in ("", *IMPORT_ENDINGS, *INDEX_FILES))
_EDGES_SQL = f"""WITH RECURSIVE i AS ({_IMPORTS_SQL}), k AS (SELECT DISTINCT repo, path FROM files WHERE path IS NOT NULL),
t AS (SELECT DISTINCT repo, path AS src, CASE WHEN starts_with(target, './') OR starts_with(target, '../') THEN {_cleaned_sql("regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1) || '/' || target")} ELSE target END AS t FROM i),
v AS (SELECT repo, src, t, unnest([{_VARIANTS}]) AS tail FROM t),
h AS (SELECT v.repo, src, t, tail = '' AS exact, k.path AS dst FROM v JOIN k ON k.repo = v.repo AND k.path = t || tail
      UNION ALL SELECT t.repo, src, t, FALSE, k.path FROM t JOIN k ON k.repo = t.repo AND regexp_extract(k.path, '^(?:(.*)/)?[^/]*$', 1) = t.t AND ends_with(k.path, '.go')),
e AS (SELECT repo, src, t, max(exact::INT) AS any_exact FROM h GROUP BY ALL)
SELECT DISTINCT h.repo, h.src, h.dst FROM h JOIN e ON e.repo = h.repo AND e.src = h.src AND e.t = h.t WHERE h.exact OR any_exact = 0"""
ORACLES["import_edges"] = _EDGES_SQL

_FOLDER = "regexp_extract({}, '^(?:(.*)/)?[^/]*$', 1)"
_LEAF = "regexp_extract(path, '([^/]*)$', 1)"
_BASE = r"regexp_replace(path, '\.[^./]*$', '')"
_STEM = rf"regexp_replace({_LEAF}, '\.[^./]*$', '')"


def _beside(name: str) -> str:
    return f"CASE WHEN {_FOLDER.format('path')} <> '' THEN {_FOLDER.format('path')} || '/' ELSE '' END || {name}"


def _script(a: str, b: str) -> str:
    """Candidates of the tests of a script, whose own ending comes first."""
    return "[" + ", ".join([*[f"{_BASE} || '{x}'" for x in (f".test.{a}", f".spec.{a}", f".test.{b}", f".spec.{b}")], _beside(f"'__tests__/' || {_LEAF}")]) + "]"


_TESTS_SQL = f"""SELECT DISTINCT t.repo, t.src, t.dst FROM (
  SELECT repo, path AS src, unnest(CASE lower({ENDING}) WHEN 'go' THEN [{_BASE} || '_test.go'] WHEN 'ts' THEN {_script('ts', 'tsx')} WHEN 'tsx' THEN {_script('ts', 'tsx')} WHEN 'js' THEN {_script('js', 'jsx')}
    WHEN 'jsx' THEN {_script('js', 'jsx')} WHEN 'py' THEN [{_beside(f"'test_' || {_STEM} || '.py'")}, {_BASE} || '_test.py', {_beside(f"'tests/test_' || {_STEM} || '.py'")}] WHEN 'rs' THEN [{_beside(f"'tests/' || {_LEAF}")}]
    ELSE [] END) AS dst FROM (SELECT DISTINCT repo, path FROM files WHERE path IS NOT NULL AND file_id IS NOT NULL)) t
  JOIN (SELECT DISTINCT repo, path FROM files WHERE path IS NOT NULL AND file_id IS NOT NULL) k ON k.repo = t.repo AND k.path = t.dst"""


def near_sql(frontier: str, seen: str) -> str:
    """The files around those of ``frontier`` that aren't among ``seen``; with ``e``, ``te`` and ``k`` for imports, tests and all paths."""
    return f"""(SELECT DISTINCT n.repo, n.path FROM (
      SELECT e.repo, e.dst AS path FROM (SELECT * FROM e UNION ALL SELECT * FROM te) e JOIN {frontier} f ON f.repo = e.repo AND f.path = e.src
      UNION ALL SELECT e.repo, e.src FROM e JOIN {frontier} f ON f.repo = e.repo AND f.path = e.dst
      UNION ALL SELECT k.repo, k.path FROM k JOIN {frontier} f ON f.repo = k.repo AND {_FOLDER.format('f.path')} = {_FOLDER.format('k.path')} WHERE lower({ENDING.replace('path', 'f.path')}) NOT IN ('go', 'ts', 'tsx', 'js', 'jsx', 'py')) n
    WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.repo = n.repo AND s.path = n.path))"""


GRAPH_SQL = f"e AS ({_EDGES_SQL}), te AS ({_TESTS_SQL}), k AS (SELECT DISTINCT repo, path FROM files WHERE path IS NOT NULL AND file_id IS NOT NULL)"
ORACLES |= {
    "test_edges": _TESTS_SQL,
    "neighbours_depth2": rf"""WITH {GRAPH_SQL}, f0 AS (SELECT repo, path FROM k WHERE starts_with(path, 'cmd/') OR regexp_matches(path, '(^|/)c(ache|olumn|ursor)[^/]*\.md$')),
        f1 AS {near_sql('f0', 'f0')}, s1 AS (SELECT * FROM f0 UNION ALL SELECT * FROM f1), f2 AS {near_sql('f1', 's1')}
        SELECT repo, path, 1 AS depth FROM f1 UNION ALL SELECT repo, path, 2 FROM f2""",
}
