"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from contextloom.llm.code_docs import function_docs, once
from contextloom.llm.credentials import credential_spans, redacted_files
from contextloom.llm.leakage import leaked_items
from contextloom.llm.origin import source_origins
from contextloom.llm.packing import fill_report, packed
from contextloom.llm.reading_level import demanding_documents, reading_levels
from contextloom.llm.splitting import file_pieces, oversized, run_pieces
from contextloom.sources.tables import table


def p1_found(spark, sf_dir):
    return source_origins(table(spark, sf_dir, "files")).where("origin <> 'hand_written'").select("file_id")


def p1_origins(spark, sf_dir):
    return source_origins(table(spark, sf_dir, "files"))


def _run_tables(spark, sf_dir):
    return [table(spark, sf_dir, name) for name in ("files", "runs", "run_files")]


def p2_found(spark, sf_dir):
    return run_pieces(*_run_tables(spark, sf_dir)).select("run_id", "file_id").distinct()


def p2_pieces(spark, sf_dir):
    return run_pieces(*_run_tables(spark, sf_dir))


def p2_texts(spark, sf_dir):
    files, runs, run_files = _run_tables(spark, sf_dir)
    texts = file_pieces(files, oversized(files, runs, run_files), texts=True)
    return texts.select("file_id", "max_tokens", "overlap_tokens", "piece_no", F.expr("octet_length(text) div 4").alias("tokens"), F.md5("text").alias("text_md5"))


def p2_whole(spark, sf_dir):
    """Per file and setting: the pieces' own parts put together again, and whether sizes and repeats hold."""
    files, runs, run_files = _run_tables(spark, sf_dir)
    texts = file_pieces(files, oversized(files, runs, run_files), texts=True)
    own = F.struct("piece_no", F.expr("substring(cast(text AS binary), cast(n_repeated + 1 AS int))").alias("own"))
    repeats = F.when(F.col("piece_no") == 1, F.col("n_repeated") == 0).otherwise(F.col("n_repeated").between(F.least(4 * F.col("overlap_tokens"), F.col("cut_start")), 4 * F.col("overlap_tokens") + 3))
    checked = texts.groupBy("file_id", "max_tokens", "overlap_tokens").agg(
        F.array_sort(F.collect_list(own)).alias("parts"), F.bool_and(F.expr("octet_length(text) div 4 <= max_tokens")).alias("all_fit"), F.bool_and(repeats).alias("all_repeat")
    )
    whole = F.aggregate("parts", F.expr("cast('' AS binary)"), lambda s, p: F.concat(s, p["own"]))
    return checked.select("file_id", "max_tokens", "overlap_tokens", F.md5(whole).alias("content_md5"), "all_fit", "all_repeat")


P2_SQL = """
WITH limits AS (SELECT run_id, max(max_tokens) AS max_tokens FROM runs WHERE max_tokens > 0 GROUP BY run_id),
lengths AS (SELECT file_id, max(strlen(content)) AS n_bytes FROM files WHERE content IS NOT NULL GROUP BY file_id)
SELECT DISTINCT m.run_id, m.file_id
FROM run_files m JOIN limits l USING (run_id) JOIN lengths b USING (file_id)
WHERE b.n_bytes // 4 > l.max_tokens"""
P2_WHOLE_SQL = """
WITH limits AS (SELECT run_id, max(max_tokens) AS max_tokens, least(greatest(coalesce(max_by(overlap_tokens, max_tokens), 0), 0), max(max_tokens) - 1) AS overlap_tokens FROM runs WHERE max_tokens > 0 GROUP BY run_id),
texts AS (SELECT file_id, max(strlen(content)) AS n_bytes, arg_max(md5(content), strlen(content)) AS content_md5 FROM files WHERE content IS NOT NULL GROUP BY file_id)
SELECT DISTINCT m.file_id, l.max_tokens, l.overlap_tokens, b.content_md5, TRUE AS all_fit, TRUE AS all_repeat
FROM run_files m JOIN limits l USING (run_id) JOIN texts b USING (file_id)
WHERE b.n_bytes // 4 > l.max_tokens"""


def p3_found(spark, sf_dir):
    return once(function_docs(table(spark, sf_dir, "files")).select("file_id", "fn_line", "fn_name"))


def p3_pairs(spark, sf_dir):
    return once(function_docs(table(spark, sf_dir, "files")))


def p4_found(spark, sf_dir):
    return credential_spans(table(spark, sf_dir, "files")).select("file_id", "line_no").distinct()


def _packing_tables(spark, sf_dir):
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers")


def p4_intact(spark, sf_dir):
    """Per file with content: its lines after masking, and whether every line is as before, holds a mask, or is what a masked span of several lines left of it."""
    files = table(spark, sf_dir, "files").where("content IS NOT NULL AND file_id IS NOT NULL").select("file_id", "path", "content", F.col("content").alias("original"))
    masked, original = F.split("content", "\n", -1), F.split("original", "\n", -1)
    kept = F.zip_with(original, masked, lambda a, b: (a == b) | F.contains(b, F.lit("[REDACTED:")) | F.endswith(a, b))
    return redacted_files(files).select("file_id", F.size(masked).alias("n_lines"), ((F.size(masked) == F.size(original)) & F.forall(kept, lambda ok: F.coalesce(ok, F.lit(False)))).alias("is_intact")).distinct()


def p6_assignment(spark, sf_dir):
    return packed(*_packing_tables(spark, sf_dir))


def p6_fill(spark, sf_dir):
    documents, containers = _packing_tables(spark, sf_dir)
    return fill_report(packed(documents, containers), containers)


def p6_whole(spark, sf_dir):
    """Per kind of container: every text's tokens once, nothing above the capacity, and few enough containers."""
    documents, containers = _packing_tables(spark, sf_dir)
    kinds = containers.select("container", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens")).distinct()
    placed = packed(documents, containers)
    loads = placed.groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).join(kinds, "container")
    used = F.col("tokens") + F.col("separator_tokens") * (F.col("n") - 1)
    least = F.ceil((F.sum("tokens") + F.sum("n") * F.first("separator_tokens")) / (F.first("capacity_tokens") + F.first("separator_tokens")))
    return loads.groupBy("container").agg(
        F.sum("tokens").alias("tokens"), F.sum("n").alias("n_parts"), F.bool_and(used <= F.col("capacity_tokens")).alias("all_fit"), (F.count("*") <= F.ceil(least * 1.02)).alias("few_enough")
    )


def p7_found(spark, sf_dir):
    return p7_leaks(spark, sf_dir).where("how = 'verbatim'").select("doc_id", "item_id")


def p7_leaks(spark, sf_dir):
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "golden_questions"))


def p8_found(spark, sf_dir):
    return demanding_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p8_levels(spark, sf_dir):
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_labels"))


def p4_by_type(spark, sf_dir):
    return credential_spans(table(spark, sf_dir, "files")).groupBy("secret_type").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def p4_redacted(spark, sf_dir):
    masked = redacted_files(table(spark, sf_dir, "files").select("file_id", "path", "content"))
    return masked.select("file_id", F.md5("content").alias("content_md5"), "found_redactions").distinct()


P4_SQL = "SELECT DISTINCT file_id, len(string_split(content, chr(10)))::INTEGER AS n_lines, TRUE AS is_intact FROM files WHERE content IS NOT NULL AND file_id IS NOT NULL"
P6_SQL = """
WITH d AS (SELECT doc_id, max(strlen(text) // 4) AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
k AS (SELECT DISTINCT container, capacity_tokens AS c FROM containers WHERE container IS NOT NULL AND capacity_tokens > 0)
SELECT container, sum(t)::BIGINT AS tokens, sum(greatest(1, (t + c - 1) // c))::BIGINT AS n_parts, TRUE AS all_fit, TRUE AS few_enough FROM d, k GROUP BY container"""


def _words_sql(column: str) -> str:
    """A list of a text's words in lower case, in SQL; entities and escapes become spaces or vanish."""
    text = column
    for pattern, by in ((r"&(?:#39|#x27|apos|rsquo|shy|zwnj|zwj);", "''"), (r"&#?\w+;", " "), (r"\\u[0-9a-fA-F]{4}|\\[nrtbfv\"''/\\]", " "), (r"</?[A-Za-z!][^<>]*>", " "), ("[\u00ad\u200b-\u200f\u2060\ufeff]", "")):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def _windows_sql(key: str, words: str, source: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string({words}[i : i + 11], ' ') AS w FROM (SELECT {key}, {words}, unnest(range(1, len({words}) - 10)) AS i FROM {source})"


P7_SQL = f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS x FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT item_id, {_words_sql("t")} AS y FROM (SELECT item_id, unnest([question, expected_answer]) AS t FROM golden_questions) WHERE t IS NOT NULL),
dw AS ({_windows_sql("doc_id", "x", "d")}),
iw AS ({_windows_sql("item_id", "y", "i")})
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (w)"""


QUERIES = {
    query.__name__: query
    for query in (p1_found, p1_origins, p2_found, p2_pieces, p2_texts, p2_whole, p3_found, p3_pairs, p4_found, p4_by_type, p4_redacted, p4_intact, p6_assignment, p6_fill, p6_whole, p7_found, p7_leaks, p8_found, p8_levels)
}
ORACLES: dict[str, str] = {"p2_found": P2_SQL, "p2_whole": P2_WHOLE_SQL, "p4_intact": P4_SQL, "p6_whole": P6_SQL, "p7_found": P7_SQL}
