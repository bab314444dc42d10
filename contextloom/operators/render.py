"""Rendered blocks of files and whole documents, and reading them back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.tables import FENCE_LANGUAGES, TIER_KEYS
from contextloom.functions.text import cdata, ending, fenced, human_bytes, lookup, numbered_lines, thousands, unfenced, xml_attribute
from contextloom.operators.relevance import tier_key


def fence_language(path: Column) -> Column:
    return lookup(F.lower(ending(path)), FENCE_LANGUAGES)


def markdown_block(line_numbers: bool = False) -> Column:
    """The block of one file from its columns ``path, n_bytes, tokens, tier, is_compressed, content``."""
    shown = fenced(F.coalesce("content", F.lit("")))
    body = numbered_lines(shown) if line_numbers else shown
    facts = F.concat(
        F.lit("> **Size:** "), human_bytes(F.col("n_bytes")), F.lit(" | **Tokens:** "), thousands(F.col("tokens")), F.lit(" | **Tier:** "), tier_key(F.col("tier")),
        F.lit(" | **Compressed:** "), F.when(F.col("is_compressed"), "yes").otherwise("no"),
    )
    return F.concat(F.lit("### `"), F.col("path"), F.lit("`\n\n"), facts, F.lit("\n\n```"), fence_language(F.col("path")), F.lit("\n"), body, F.lit("\n```"))


def xml_block() -> Column:
    """The element of one file from the same columns."""
    attributes = F.concat(
        F.lit('<file path="'), xml_attribute(F.col("path")), F.lit('" tokens="'), F.col("tokens").cast("string"), F.lit('" tier="'), tier_key(F.col("tier")),
        F.lit('" size="'), F.col("n_bytes").cast("string"), F.lit('" language="'), fence_language(F.col("path")), F.lit('" compressed="'), F.col("is_compressed").cast("string"), F.lit('">'),
    )
    return F.concat(attributes, F.lit("\n"), cdata(F.coalesce("content", F.lit(""))), F.lit("\n</file>"))


def renderable(files: DataFrame, tier: Column) -> DataFrame:
    """``file_id, repo, path, n_bytes, tokens, tier, is_compressed, content`` of files with content."""
    n_bytes = F.octet_length("content").cast("long")
    return files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull() & F.col("path").isNotNull()).select(
        "file_id", "repo", "path", n_bytes.alias("n_bytes"), F.expr("octet_length(content) div 4").cast("long").alias("tokens"), tier.alias("tier"), F.coalesce("is_compressed", F.lit(False)).alias("is_compressed"), "content"
    )


def top_members(members: DataFrame, n: int = 5) -> DataFrame:
    """``repo, top``: each repository's ``n`` largest files in order of tokens, then tier and path; kept while aggregating."""
    entry = F.struct((-F.col("tokens")).alias("less"), "tier", "path", "tokens", "n_bytes")
    few = members.groupBy("repo", F.pmod(F.xxhash64("path"), F.lit(256)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(entry)), 1, n).alias("top"))
    return few.groupBy("repo").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, n).alias("top"))


def document_heads(members: DataFrame, hashes: DataFrame | None = None, redactions: DataFrame | None = None, trees: DataFrame | None = None, *, title: str = "Context", profile: str = "default", tokenizer: str = "none", generated: str = "") -> DataFrame:
    """``repo, part_no, head``: title, table of facts, summary and tree of each part of each repository's document.

    ``members`` has ``repo, part_no, path, tier, tokens, n_bytes``. Figures are those of the part; the largest
    files, masked secrets (``redactions``: ``repo, secret_type, n``) and the tree (``trees``: ``repo, tree``) stand in the
    first part only. Without a given time, hash or tree these lines are left out.
    """
    parts = members.groupBy("repo", "part_no").agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), *[F.sum((F.col("tier") == t).cast("long")).alias(f"t{t}") for t in range(len(TIER_KEYS))]
    )
    totals = parts.groupBy("repo").agg(F.max("part_no").alias("n_parts"))
    joined = parts.join(totals, "repo").join(top_members(members), "repo", "left")
    joined = joined.join(hashes.select("repo", "content_hash"), "repo", "left") if hashes is not None else joined.withColumn("content_hash", F.lit(None).cast("string"))
    joined = joined.join(trees.select("repo", "tree"), "repo", "left") if trees is not None else joined.withColumn("tree", F.lit(None).cast("string"))
    if redactions is not None:
        listed = redactions.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("secret_type", "n"))).alias("masked"))  # one entry a type
        joined = joined.join(listed, "repo", "left")
    else:
        joined = joined.withColumn("masked", F.lit(None).cast("array<struct<secret_type: string, n: bigint>>"))
    first = F.col("part_no") == 1
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), value, F.lit(" |\n"))
    lines = lambda rows, shape: F.array_join(F.transform(rows, shape), "")
    name = F.concat(F.col("repo"), F.when(F.col("n_parts") > 1, F.format_string(" (Part %d of %d)", F.col("part_no"), F.col("n_parts"))).otherwise(""))
    facts = F.concat(
        F.lit("| Field | Value |\n|-------|-------|\n"), row("Generated", F.lit(generated)) if generated else F.lit(""), F.coalesce(row("Content Hash", F.col("content_hash")), F.lit("")), row("Profile", F.lit(profile)),
        row("Tokenizer", F.lit(tokenizer)), row("Total Tokens", thousands(F.col("n_tokens"))), row("Total Files", F.col("n_files").cast("string")),
    )
    tiers = F.concat(*[F.when(F.col(f"t{t}") > 0, F.format_string(f"| {t} | {key} | %d |\n", F.col(f"t{t}"))).otherwise("") for t, key in enumerate(TIER_KEYS)])
    top = F.concat(
        F.lit("\n### Top Files by Token Count\n\n| File | Tokens | Size |\n|------|--------|------|\n"), lines("top", lambda f: F.concat(F.lit("| "), f["path"], F.lit(" | "), thousands(f["tokens"]), F.lit(" | "), human_bytes(f["n_bytes"]), F.lit(" |\n")))
    )
    masked = F.concat(F.lit("\n### Redaction Summary\n\n| Type | Count |\n|------|-------|\n"), lines("masked", lambda m: F.concat(F.lit("| "), m["secret_type"], F.lit(" | "), m["n"].cast("string"), F.lit(" |\n"))))
    tree = F.concat(F.lit("\n## Directory Tree\n\n```\n"), F.when(first, F.coalesce("tree", F.lit(""))).otherwise("(See Part 1 for full directory tree and file summary)"), F.lit("\n```\n"))
    head = F.concat(
        F.lit(f"# {title}: "), name, F.lit("\n\n"), facts, F.lit("\n## File Summary\n\n**Total Files:** "), F.col("n_files").cast("string"), F.lit(" | **Total Tokens:** "), thousands(F.col("n_tokens")),
        F.lit("\n\n### Files by Tier\n\n| Tier | Label | Count |\n|------|-------|-------|\n"), tiers, F.when(first & (F.size("top") > 0), top).otherwise(""), F.when(first & (F.size("masked") > 0), masked).otherwise(""),
        tree if trees is not None else F.lit(""),
    )
    return joined.select("repo", "part_no", head.alias("head"))


def documents(blocks: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``repo, part_no, document``: each part's blocks in order of tier and path, under its head or a title.

    ``blocks`` has ``repo, part_no, tier, path, block``; a part comes from ``split_parts``, so that a document is one value of
    bounded size: its tokens, or those of a single larger file. Blocks delivered again count once.
    """
    grouped = blocks.groupBy("repo", "part_no").agg(F.sort_array(F.collect_set(F.struct("tier", "path", "block"))).alias("b"))
    head = F.concat(F.lit("# "), F.col("repo"), F.lit("\n"))
    if heads is not None:
        grouped, head = grouped.join(heads, ["repo", "part_no"]), F.col("head")
    return grouped.select("repo", "part_no", F.concat(head, F.lit("\n## Files\n\n"), F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit("\n")).alias("document"))


def change_section(changes: DataFrame) -> DataFrame:
    """``repo, section``: the closing section on changes, from ``repo, path, change``; repositories without changes have none."""
    kinds = ("added", "modified", "deleted")
    listed = changes.groupBy("repo").agg(*[F.sort_array(F.collect_list(F.when(F.col("change") == k, F.col("path")))).alias(k) for k in kinds])
    counts = F.concat(*[F.format_string(f"| {k.title()} | %d |\n", F.size(k)) for k in kinds])
    lists = [F.when(F.size(k) > 0, F.concat(F.lit(f"\n### {k.title()} Files\n\n"), F.array_join(F.transform(k, lambda p: F.concat(F.lit("- "), p, F.lit("\n"))), ""))).otherwise("") for k in kinds]
    return listed.select("repo", F.concat(F.lit("\n## Change Summary\n\n| Change Type | Count |\n|-------------|-------|\n"), counts, *lists).alias("section"))


def parsed_markdown(docs: DataFrame, document: str = "document") -> DataFrame:
    """The columns of ``docs`` but the document, and ``path, content, redactions`` of each file block after ``## Files``.

    A block's first fenced part is its content, with taken-apart fences put together again.
    """
    body = F.regexp_extract(F.col(document), r"(?s)(?:^|\n)## Files\n(.*)$", 1)
    pieces = F.slice(F.split(body, r"(?:^|\n)### `"), 2, 2_000_000_000)
    rest = [c for c in docs.columns if c != document]
    rows = docs.select(*rest, F.explode(pieces).alias("piece"))
    content = unfenced(F.regexp_extract("piece", r"(?s)\n```[^\n]*\n(.*?)\n```(?:\n|$)", 1))
    out = rows.select(*rest, F.regexp_extract("piece", r"^([^`\n]*)`", 1).alias("path"), content.alias("content"))
    return out.withColumn("redactions", F.size(F.regexp_extract_all("content", F.lit(r"\[REDACTED:[^\]]*\]"), F.lit(0))))


def repository_hash(files: DataFrame) -> DataFrame:
    """``repo, content_hash``: one hash over all paths and contents of a repository.

    Contents are hashed where they are. Digests are joined in order of path within each of 4,096 buckets of
    the path's hash, and the buckets' hashes in order, so that no repository is gathered in one task.
    """
    per_file = files.where(F.col("content").isNotNull() & F.col("path").isNotNull() & F.col("repo").isNotNull()).select("repo", "path", F.md5("content").alias("digest")).groupBy("repo", "path").agg(F.max("digest").alias("digest"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("path", "digest"))), lambda x: F.concat(x["path"], F.lit(":"), x["digest"]))
    buckets = per_file.groupBy("repo", F.substring(F.md5("path"), 1, 3).alias("bucket")).agg(F.md5(F.array_join(lines, "\n")).alias("digest"))
    return buckets.groupBy("repo").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda x: x["digest"]), "\n")).alias("content_hash"))


def xml_heads(members: DataFrame, hashes: DataFrame | None = None, redactions: DataFrame | None = None, *, profile: str = "default", tokenizer: str = "none", generated: str = "") -> DataFrame:
    """``repo, part_no, head, tail``: metadata and summary before the files of each part, statistics behind them; see ``document_heads``."""
    parts = members.groupBy("repo", "part_no").agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), *[F.sum((F.col("tier") == t).cast("long")).alias(f"t{t}") for t in range(len(TIER_KEYS))]
    )
    joined = parts.join(parts.groupBy("repo").agg(F.max("part_no").alias("n_parts")), "repo").join(top_members(members), "repo", "left")
    joined = joined.join(hashes.select("repo", "content_hash"), "repo", "left") if hashes is not None else joined.withColumn("content_hash", F.lit(""))
    if redactions is not None:
        joined = joined.join(redactions.groupBy("repo").agg(F.sort_array(F.collect_list(F.struct("secret_type", "n"))).alias("masked"), F.sum("n").alias("n_masked")), "repo", "left")
    else:
        joined = joined.withColumn("masked", F.lit(None).cast("array<struct<secret_type: string, n: bigint>>")).withColumn("n_masked", F.lit(0).cast("long"))
    first = F.col("part_no") == 1
    tag = lambda name, value, lead="    ": F.concat(F.lit(f"{lead}<{name}>"), value, F.lit(f"</{name}>\n"))
    lines = lambda rows, shape: F.array_join(F.transform(rows, shape), "")
    name = F.concat(F.col("repo"), F.when(F.col("n_parts") > 1, F.format_string(" (Part %d of %d)", F.col("part_no"), F.col("n_parts"))).otherwise(""))
    n_files, n_tokens = F.col("n_files").cast("string"), F.col("n_tokens").cast("string")
    facts = F.concat(
        F.lit("  <metadata>\n"), tag("project_name", xml_attribute(name)), tag("generated", F.lit(generated)) if generated else F.lit(""), tag("content_hash", F.coalesce("content_hash", F.lit(""))), tag("profile", F.lit(profile)),
        tag("tokenizer", F.lit(tokenizer)), tag("total_tokens", n_tokens), tag("total_files", n_files), F.lit("  </metadata>\n"),
    )
    tiers = F.concat(*[F.when(F.col(f"t{t}") > 0, F.format_string(f'      <tier number="{t}" label="{key}" count="%d"/>\n', F.col(f"t{t}"))).otherwise("") for t, key in enumerate(TIER_KEYS)])
    file_line = lambda f: F.concat(F.lit('      <file path="'), xml_attribute(f["path"]), F.lit('" tokens="'), thousands(f["tokens"]), F.lit('" size="'), human_bytes(f["n_bytes"]), F.lit('"/>\n'))
    top = F.when(first & (F.size("top") > 0), F.concat(F.lit("    <top_files>\n"), lines("top", file_line), F.lit("    </top_files>\n"))).otherwise("")
    masked = F.when(
        first & (F.size("masked") > 0),
        F.concat(
            F.lit('    <redaction_summary total="'), F.col("n_masked").cast("string"), F.lit('">\n'), lines("masked", lambda m: F.concat(F.lit('      <type name="'), m["secret_type"], F.lit('" count="'), m["n"].cast("string"), F.lit('"/>\n'))),
            F.lit("    </redaction_summary>\n"),
        ),
    ).otherwise('    <redaction_summary total="0"/>\n')
    summary = F.concat(
        F.lit("  <file_summary>\n"), tag("total_files", n_files), tag("total_tokens", thousands(F.col("n_tokens"))), F.lit("    <files_by_tier>\n"), tiers, F.lit("    </files_by_tier>\n"), top, masked, F.lit("  </file_summary>\n")
    )
    tail = F.concat(F.lit("  <statistics>\n"), tag("total_files", n_files), tag("total_tokens", n_tokens), F.lit("  </statistics>\n"))
    return joined.select("repo", "part_no", F.concat(facts, summary).alias("head"), tail.alias("tail"))


def xml_documents(blocks: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``repo, part_no, document``: each part's XML elements in order of tier and path, between the parts' heads and tails; see ``documents``."""
    grouped = blocks.groupBy("repo", "part_no").agg(F.sort_array(F.collect_set(F.struct("tier", "path", "block"))).alias("b"))
    head = tail = F.lit("")
    if heads is not None:
        grouped, head, tail = grouped.join(heads, ["repo", "part_no"]), F.col("head"), F.col("tail")
    body = F.array_join(F.transform("b", lambda x: x["block"]), "\n")
    return grouped.select("repo", "part_no", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<repository>\n'), head, F.lit("<files>\n"), body, F.lit("\n</files>\n"), tail, F.lit("</repository>\n")).alias("document"))


def ordered_hash(files: DataFrame) -> DataFrame:
    """``repo, content_hash``: XXH3 over path, a zero byte and content of all files of a repository, in order of path, as hex.

    The order makes it one stream a repository: rows are sorted by path and hashed as they pass, in constant
    memory. ``repository_hash`` is the one that spreads a repository over tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, last, state = None, None, None
        for pdf in batches:
            done = []
            for here, path, content in zip(pdf["repo"], pdf["path"], pdf["content"]):
                if here != repo:
                    if state is not None:
                        done.append((repo, f"{state.intdigest():x}"))
                    repo, last, state = here, None, xxhash.xxh3_64()
                if path != last:  # delivered again
                    state.update(path.encode("utf-8", "surrogatepass") + b"\0" + (content or "").encode("utf-8", "surrogatepass"))
                    last = path
            yield pd.DataFrame(done, columns=["repo", "content_hash"])
        if state is not None:
            yield pd.DataFrame([(repo, f"{state.intdigest():x}")], columns=["repo", "content_hash"])

    rows = files.where(F.col("repo").isNotNull() & F.col("path").isNotNull()).select("repo", "path", "content")
    return rows.repartition("repo").sortWithinPartitions("repo", "path", "content").mapInPandas(run, "repo string, content_hash string")


def parsed_xml(docs: DataFrame, document: str = "document") -> DataFrame:
    """The columns of ``docs`` but the document, and ``path, content, redactions`` of each file element."""
    body = F.regexp_extract(F.col(document), r"(?s)<files>\n(.*)\n</files>", 1)
    pieces = F.slice(F.split(body, r'(?:^|\]\]>\n</file>\n)<file path="'), 2, 2_000_000_000)
    rest = [c for c in docs.columns if c != document]
    rows = docs.select(*rest, F.explode(pieces).alias("piece"))
    path = F.regexp_extract("piece", r'^([^"]*)"', 1)
    for raw, escaped in (("'", "&apos;"), ('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        path = F.replace(path, F.lit(escaped), F.lit(raw))
    inner = F.regexp_replace(F.regexp_extract("piece", r"(?s)^[^>]*>\n<!\[CDATA\[(.*)$", 1), r"\]\]>\n</file>$", "")
    out = rows.select(*rest, path.alias("path"), F.replace(inner, F.lit("]]]]><![CDATA[>"), F.lit("]]>")).alias("content"))
    return out.withColumn("redactions", F.size(F.regexp_extract_all("content", F.lit(r"\[REDACTED:[^\]]*\]"), F.lit(0))))
