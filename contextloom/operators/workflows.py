"""Composite queries: slices around a change, briefs, module maps, coverage, workspaces and health checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.globs import glob_regex
from contextloom.functions.manifests import manifest_section
from contextloom.functions.tables import KNOWN_DIRECTORIES
from contextloom.functions.text import ending, lookup, tokens_ceil, top_dir
from contextloom.operators.imports import neighbours
from contextloom.operators.listings import in_modules, is_listed
from contextloom.operators.ordered import running_sum

LARGE_TEXT_BYTES, LARGE_BINARY_BYTES = 512_000, 1 << 20
SECTION_OVERHEAD = 20
# Directories that builds leave behind.
ARTIFACT_DIRS = ("node_modules", "dist", "build", "target", "coverage", "__pycache__", ".next")


def module_map(paths: DataFrame) -> DataFrame:
    """``repo, module, description, n_files`` of top-level directories; hidden ones only if they are well known.

    Unknown directories are described by the first of Go, TypeScript, Python, Rust and Markdown they hold.
    """
    kind = F.lower(ending(F.col("path")))
    held = paths.where(F.contains("path", F.lit("/"))).select("repo", top_dir(F.col("path")).alias("module"), kind.alias("kind"))
    grouped = held.groupBy("repo", "module").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.max(F.col("kind").isin(*kinds).cast("int")).alias(name) for name, kinds in (("go", ["go"]), ("ts", ["ts", "tsx"]), ("py", ["py"]), ("rs", ["rs"]), ("md", ["md"]))]
    )
    inferred = F.when(F.col("go") == 1, "Go package").when(F.col("ts") == 1, "TypeScript module").when(F.col("py") == 1, "Python package").when(F.col("rs") == 1, "Rust module").when(F.col("md") == 1, "Documentation").otherwise("Project directory")
    known = lookup(F.col("module"), KNOWN_DIRECTORIES, None)
    return grouped.where(~F.col("module").startswith(".") | known.isNotNull()).select("repo", "module", F.coalesce(known, inferred).alias("description"), "n_files")


def question_coverage(questions: DataFrame, paths: DataFrame) -> DataFrame:
    """``item_id, n_critical, n_included, covered``: whether each question's critical files are among ``paths``.

    Plain names join by equality; only patterns with wildcards are compared as globs, against distinct paths.
    A question without critical files is covered.
    """
    wanted = questions.where(F.col("item_id").isNotNull()).select("item_id", F.explode_outer("critical_files").alias("pattern")).distinct()
    plain = wanted.where(~F.col("pattern").rlike(r"[*?\[{]"))
    here = paths.where(F.col("path").isNotNull()).select(F.col("path").alias("pattern")).distinct()
    exact = plain.join(here, "pattern", "left_semi")
    globs = [r.pattern for r in wanted.where(F.col("pattern").rlike(r"[*?\[{]")).select("pattern").distinct().collect()]  # of a test of fixed size
    if globs:
        tests = F.filter(F.array(*[F.when(F.col("pattern").rlike(glob_regex(g)), F.lit(g)) for g in globs]), lambda g: g.isNotNull())
        hit = here.select(F.explode(tests).alias("pattern")).distinct()
        exact = exact.unionByName(wanted.join(hit, "pattern", "left_semi").select(*exact.columns))
    found = exact.groupBy("item_id").agg(F.countDistinct("pattern").alias("n_included"))
    need = wanted.groupBy("item_id").agg(F.count("pattern").alias("n_critical"))
    included = F.coalesce("n_included", F.lit(0))
    return need.join(found, "item_id", "left").select("item_id", "n_critical", included.alias("n_included"), (included >= F.col("n_critical")).alias("covered"))


def coverage_percent(coverage: DataFrame) -> DataFrame:
    """One row: questions, covered ones and the percentage; 100 of no questions."""
    n, ok = F.count(F.lit(1)), F.coalesce(F.sum(F.col("covered").cast("long")), F.lit(0))
    return coverage.agg(n.alias("n_questions"), ok.alias("n_covered"), F.when(n == 0, F.lit(100.0)).otherwise(F.round(ok * 100 / n, 6)).alias("percent"))


def slice_budget(files: DataFrame, max_tokens: int) -> DataFrame:
    """``files`` (``repo, path, tokens, is_primary``) that fit: primary ones always, then the others by path up to the first that doesn't."""
    main = files.where("is_primary")
    used = main.groupBy("repo").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"))
    rest = running_sum(files.where("NOT is_primary"), ["repo"], ["path"], "tokens").join(used, "repo", "left")
    room = F.lit(max_tokens) - F.coalesce("used", F.lit(0))
    kept = rest.where((room > 0) & (F.col("running") <= room)).select(*files.columns)
    return main.unionByName(kept)


def brief_budget(sections: DataFrame, max_tokens: int) -> DataFrame:
    """``sections`` (``repo, priority, name, tokens``) up to the last that fits, each with an overhead."""
    if max_tokens <= 0:
        return sections
    costed = sections.withColumn("__cost", F.coalesce("tokens", F.lit(0)) + SECTION_OVERHEAD)
    return running_sum(costed, ["repo"], ["priority", "name"], "__cost").where(F.col("running") <= max_tokens).drop("__cost", "running")


def brief_sections(files: DataFrame) -> DataFrame:
    """``repo, priority, name, source, content``: what a repository says about itself, first file of each kind by path.

    1 read-me, 2 rules and invariants, 3 architecture and decisions, 4 build commands, 5 configuration, 6 review rules.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    priority = (
        F.when(name.rlike(r"^readme(\.\w+)?$"), 1).when(name.isin("agents.md", "conventions.md", "contributing.md"), 2)
        .when(F.lower("path").rlike(r"(^|/)(architecture|design)[^/]*\.md$|(^|/)(adr|decisions)/[^/]*\.md$"), 3)
        .when(name.isin("makefile", "package.json", "go.mod", "cargo.toml", "pyproject.toml", "justfile"), 4)
        .when(name.rlike(r"\.(toml|ya?ml|ini|cfg)$"), 5).when(name.isin("codeowners", "review.md", "pull_request_template.md"), 6)
    )
    picked = files.where(F.col("content").isNotNull()).select("repo", priority.alias("priority"), "path", "content").where(F.col("priority").isNotNull())
    first = picked.select("repo", "priority", "path").groupBy("repo", "priority").agg(F.min("path").alias("path"))
    labels = F.array(*[F.lit(x) for x in ("readme", "invariants", "architecture", "build", "config", "review")])
    return picked.join(first, ["repo", "priority", "path"], "left_semi").dropDuplicates(["repo", "priority"]).select("repo", "priority", F.element_at(labels, F.col("priority")).alias("name"), F.col("path").alias("source"), "content")


def make_targets(content: Column) -> Column:
    """Targets of a make file in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(r"(?m)^([a-zA-Z_][a-zA-Z0-9_\-]*)\s*:"), F.lit(1)))


def manifest_sections(files: DataFrame) -> DataFrame:
    """``repo, path, section``: what each build file or package manifest says; files without a word are left out."""
    names = F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).isin("makefile", "gnumakefile", "package.json", "go.mod", "cargo.toml", "pyproject.toml")

    def run(batches):
        for pdf in batches:
            pdf["section"] = [manifest_section(p, c) for p, c in zip(pdf["path"], pdf["content"])]
            yield pdf[pdf["section"] != ""][["repo", "path", "section"]]

    return files.where(names & F.col("content").isNotNull()).select("repo", "path", "content").mapInPandas(run, "repo string, path string, section string").distinct()


def health_checks(df: DataFrame) -> DataFrame:
    """``repo, check, n_found``: large binaries, large texts and build artifacts of each repository, also where none is found."""
    segment = F.exists(F.split("path", "/"), lambda s: s.isin(*ARTIFACT_DIRS))
    tests = {"large_binaries": F.col("is_binary") & (F.coalesce("n_bytes", F.lit(0)) > LARGE_BINARY_BYTES), "oversized_text": ~F.col("is_binary") & (F.col("n_bytes") > LARGE_TEXT_BYTES), "build_artifacts": segment}
    counted = df.groupBy("repo").agg(*[F.coalesce(F.sum(t.cast("long")), F.lit(0)).alias(k) for k, t in tests.items()])
    return counted.unpivot("repo", list(tests), "check", "n_found")


def workspace_edges(repos: DataFrame) -> DataFrame:
    """``src, dst, is_known``: integrations of repositories (``name, integrates_with``), and whether the target exists."""
    edges = repos.select(F.col("name").alias("src"), F.explode("integrates_with").alias("dst")).distinct()
    return edges.join(repos.select(F.col("name").alias("dst"), F.lit(True).alias("known")).distinct(), "dst", "left").select("src", "dst", F.coalesce("known", F.lit(False)).alias("is_known"))


def workspace_document(repos: DataFrame, name: str = "", description: str = "") -> DataFrame:
    """``document, tokens``: a workspace's repositories by name, their integrations and shared schemas, as Markdown.

    ``repos`` has ``name, path, description, entrypoints, docs, integrates_with, shared_schemas``; what is null or empty is left out. A
    workspace is a list kept by hand, so it makes one value; without repositories only its title.
    """
    code = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    line = lambda title, value, shown: F.when(shown, F.concat(F.lit(f"- **{title}:** "), value, F.lit("\n"))).otherwise("")
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    block = F.concat(
        F.lit("### "), F.col("name"), F.lit("\n"), line("Path", F.col("path"), text(F.col("path"))), line("Description", F.col("description"), text(F.col("description"))), line("Entrypoints", code("entrypoints"), filled("entrypoints")),
        line("Docs", code("docs"), filled("docs")), line("Integrates with", F.array_join("integrates_with", ", "), filled("integrates_with")),
    )
    edge = F.when(filled("integrates_with"), F.concat(F.lit("- "), F.col("name"), F.lit(" → "), F.array_join(F.sort_array("integrates_with"), ", ")))
    schemas = F.transform(F.coalesce("shared_schemas", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- `"), x, F.lit("` ("), F.col("name"), F.lit(")")))
    listed = repos.where(F.col("name").isNotNull()).select("name", block.alias("block"), edge.alias("edge"), schemas.alias("schemas"))
    one = listed.agg(F.sort_array(F.collect_list(F.struct("name", "block", "edge"))).alias("r"), F.sort_array(F.flatten(F.collect_list("schemas"))).alias("s"))
    blocks, edges = F.transform("r", lambda x: x["block"]), F.filter(F.transform("r", lambda x: x["edge"]), lambda x: x.isNotNull())
    part = lambda title, rows, between: F.when(F.size(rows) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(rows, between), F.lit("\n"))).otherwise("")
    head = F.lit(f"# Workspace: {name or 'Workspace'}\n\n" + (f"> {description}\n\n" if description else ""))
    whole = F.concat(head, part("Repositories", blocks, "\n"), F.when(F.size(edges) > 0, F.concat(F.lit("\n"), part("Integrations", edges, "\n"))).otherwise(""), F.when(F.size("s") > 0, F.concat(F.lit("\n"), part("Shared Schemas", F.col("s"), "\n"))).otherwise(""))
    return one.select(whole.alias("document")).withColumn("tokens", tokens_ceil(F.octet_length("document")))


def stale_states(snapshots: DataFrame, days: int = 7) -> DataFrame:
    """``repo, n_states, n_stale``: stored states of each repository, and those more than ``days`` older than the newest of all; a state without a readable time is none."""
    states = snapshots.where(F.col("snapshot_id").isNotNull()).select("snapshot_id", "repo", F.try_to_timestamp("generated_at").alias("at")).where("at IS NOT NULL").distinct()
    newest = states.agg(F.max("at").cast("string").alias("newest")).first()["newest"]
    late = F.col("at") < F.lit(newest).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return states.groupBy("repo").agg(F.countDistinct("snapshot_id").alias("n_states"), F.countDistinct(F.when(late, F.col("snapshot_id"))).alias("n_stale"))


def snapshot_listing(snapshots: DataFrame) -> DataFrame:
    """``repo, profile_name, n_snapshots, latest, head``: stored states; commit ids cut to seven characters."""
    rows = snapshots.where(F.col("snapshot_id").isNotNull()).select("snapshot_id", "repo", "profile_name", F.try_to_timestamp("generated_at").alias("at"), "git_head_sha").distinct()
    return rows.groupBy("repo", "profile_name").agg(F.countDistinct("snapshot_id").alias("n_snapshots"), F.max("at").alias("latest"), F.substring(F.max_by(F.coalesce("git_head_sha", F.lit("")), F.struct("at", "snapshot_id")), 1, 7).alias("head"))


def module_slice(files: DataFrame, edges: DataFrame, tests: DataFrame, modules: Sequence[str], max_tokens: int, depth: int = 1) -> DataFrame:
    """``repo, path, tokens, is_primary``: the files of modules with their neighbours, as many as the budget takes.

    ``files`` has ``repo, path, tokens`` of what workflows see. Module files are always kept.
    """
    listed = files.where(is_listed(F.col("path")))
    paths, inside = listed.select("repo", "path"), in_modules(F.col("path"), modules)
    near = neighbours(paths.where(inside), paths, edges, tests, depth).select("repo", "path", F.lit(False).alias("is_primary")).join(paths, ["repo", "path"], "left_semi")
    chosen = paths.where(inside).withColumn("is_primary", F.lit(True)).unionByName(near)
    return slice_budget(listed.join(chosen, ["repo", "path"]).select("repo", "path", F.coalesce("tokens", F.lit(0)).alias("tokens"), "is_primary"), max_tokens)


def brief_documents(sections: DataFrame, modules: DataFrame, max_tokens: int) -> DataFrame:
    """``repo, document, tokens``: what a repository says about itself, in order of priority, under a header, within a budget.

    ``sections`` has ``repo, priority, name, content``, ``modules`` the map of ``module_map``, which makes the last section.
    The budget bounds a document's size. Tokens are counted again over the finished text.
    """
    listed = modules.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("module", "description"))), lambda m: F.concat(F.lit("- `"), m["module"], F.lit("/`: "), m["description"])), "\n").alias("content"))
    everything = sections.select("repo", "priority", "name", "content").unionByName(listed.select("repo", F.lit(7).alias("priority"), F.lit("modules").alias("name"), "content"))
    kept = brief_budget(everything.withColumn("tokens", tokens_ceil(F.octet_length("content"))), max_tokens)
    block = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), F.rtrim("content"), F.lit("\n"))
    body = kept.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("priority", "name", block.alias("block")))), lambda s: s["block"]), "\n").alias("body"))
    header = F.concat(F.lit("# Brief: "), F.col("repo"), F.lit("\n\n| Field | Value |\n|-------|-------|\n| Content Hash | "), F.md5("body"), F.lit(" |\n| Tokens | "), tokens_ceil(F.octet_length("body")).cast("string"), F.lit(" |\n\n"))
    return body.select("repo", F.concat(header, F.col("body")).alias("document")).withColumn("tokens", tokens_ceil(F.octet_length("document")))
