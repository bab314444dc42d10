"""The import graph: parsed imports, resolved edges, test files, and neighbourhoods by iterated joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.tables import GO_LOCAL_MARKERS, IMPORT_ENDINGS, INDEX_FILES
from contextloom.functions.text import ending, file_name, parent_dir
from contextloom.storage import materialize

# How imports are written.
GO_IMPORT = r"^\s*(?:import\s+)?(?:\w+\s+|[._]\s+)?\"([^\"]+)\""
JS_IMPORT = r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"
JS_REQUIRE = r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
PY_IMPORT = r"^\s*(?:from\s+(\S+)\s+import|import\s+(\S+))"


def _cleaned(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; leading ``..`` beyond the root stay."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != ".") & (s != ""))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    return F.array_join(folded, "/")


def imports(files: DataFrame) -> DataFrame:
    """``file_id, repo, path, target``: what each file imports from its own repository, as written, once each.

    Go: relative paths and those below well-known local directories; JavaScript and TypeScript: relative paths;
    Python: dotted modules as paths, where each dot beyond the first climbs one directory. Others import nothing.
    """
    kind = F.lower(ending(F.col("path")))
    line = F.explode(F.split("content", "\n")).alias("line")
    lines = files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull() & kind.isin("go", "ts", "tsx", "js", "jsx", "py")).select("file_id", "repo", "path", kind.alias("kind"), line)
    lines = lines.where(F.contains("line", F.lit("import")) | F.contains("line", F.lit("require")) | (F.col("kind") == "go") & F.contains("line", F.lit('"')))
    go = F.regexp_extract("line", GO_IMPORT, 1)
    is_relative = lambda c: c.startswith("./") | c.startswith("../")
    local = F.lit(None).cast("string")
    for marker in reversed(GO_LOCAL_MARKERS):
        local = F.when(F.instr(go, marker) > 0, F.expr("substring(g, instr(g, '%s') + 1)" % marker)).otherwise(local)
    module = F.regexp_extract("line", PY_IMPORT, 1)
    module = F.when(module != "", module).otherwise(F.regexp_extract("line", PY_IMPORT, 2))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")
    python = F.when(rest != "", F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), rest))
    js = F.filter(F.array(F.regexp_extract("line", JS_IMPORT, 1), F.regexp_extract("line", JS_REQUIRE, 1)), lambda t: is_relative(t))
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("kind") == "go", one(F.when(is_relative(go), go).otherwise(local))).when(F.col("kind") == "py", one(python)).otherwise(js)
    return lines.withColumn("g", go).select("file_id", "repo", "path", F.explode(found).alias("target")).distinct()


def import_edges(found: DataFrame, paths: DataFrame) -> DataFrame:
    """``repo, src, dst``: imports resolved to files of the repository by equi-joins on candidate paths.

    Tried: the path itself, else with each known ending, each index file, and the Go files right in the directory.
    """
    target = F.when(F.col("target").startswith("./") | F.col("target").startswith("../"), _cleaned(F.concat_ws("/", parent_dir(F.col("path")), "target"))).otherwise(F.col("target"))
    wanted = found.select("repo", F.col("path").alias("src"), target.alias("t")).distinct()
    variants = F.array(F.struct(F.lit(0).alias("rank"), F.col("t").alias("dst")), *[F.struct(F.lit(1).alias("rank"), F.concat("t", F.lit(x)).alias("dst")) for x in (*IMPORT_ENDINGS, *INDEX_FILES)])
    known = paths.select("repo", F.col("path").alias("dst")).distinct()
    direct = wanted.select("repo", "src", "t", F.explode(variants).alias("v")).select("repo", "src", "t", "v.rank", "v.dst").join(known, ["repo", "dst"])
    in_dir = wanted.join(
        known.where(F.col("dst").endswith(".go")).select("repo", F.col("dst"), parent_dir(F.col("dst")).alias("t")), ["repo", "t"]
    ).select("repo", "src", "t", F.lit(1).alias("rank"), "dst")
    hits = direct.select("repo", "src", "t", "rank", "dst").unionByName(in_dir)
    exact = hits.where("rank = 0").select("repo", "src", "t").distinct()
    rest = hits.where("rank = 1").join(exact, ["repo", "src", "t"], "left_anti")
    return hits.where("rank = 0").select("repo", "src", "dst").union(rest.select("repo", "src", "dst")).distinct()


def test_candidates(path: Column) -> Column:
    """Paths at which a file's tests would stand, by the custom of its language."""
    base, folder, name = F.regexp_replace(path, r"\.[^./]*$", ""), parent_dir(path), file_name(path)
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    beside = lambda *parts: F.concat_ws("/", F.when(folder != "", folder), *parts)
    kind = F.lower(ending(path))
    script = lambda a, b: F.array(*[F.concat(base, F.lit(s)) for s in (f".test.{a}", f".spec.{a}", f".test.{b}", f".spec.{b}")], beside(F.lit("__tests__"), name))
    return (
        F.when(kind == "go", F.array(F.concat(base, F.lit("_test.go"))))
        .when(kind.isin("ts", "tsx"), script("ts", "tsx"))
        .when(kind.isin("js", "jsx"), script("js", "jsx"))
        .when(kind == "py", F.array(beside(F.concat(F.lit("test_"), stem, F.lit(".py"))), F.concat(base, F.lit("_test.py")), beside(F.lit("tests"), F.concat(F.lit("test_"), stem, F.lit(".py")))))
        .when(kind == "rs", F.array(beside(F.lit("tests"), name)))
        .otherwise(F.array().cast("array<string>"))
    )


def test_edges(paths: DataFrame) -> DataFrame:
    """``repo, src, dst``: files and the tests that stand where custom puts them."""
    known = paths.select("repo", F.col("path").alias("dst")).distinct()
    return paths.select("repo", F.col("path").alias("src"), F.explode(test_candidates(F.col("path"))).alias("dst")).join(known, ["repo", "dst"]).select("repo", "src", "dst").distinct()


def importers(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """``repo, path`` of files that import a changed file or anything in the directory of one; changed files themselves are left out.

    Semi joins on file and on directory, united.
    """
    files = changed.select("repo", F.col("path").alias("dst")).distinct()
    folders = changed.select("repo", parent_dir(F.col("path")).alias("folder")).distinct()
    by_file = edges.join(files, ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("path"))
    by_folder = edges.withColumn("folder", parent_dir(F.col("dst"))).join(folders, ["repo", "folder"], "left_semi").select("repo", F.col("src").alias("path"))
    return by_file.unionByName(by_folder).distinct().join(changed.select("repo", "path"), ["repo", "path"], "left_anti")


def neighbours(changed: DataFrame, paths: DataFrame, edges: DataFrame, tests: DataFrame, depth: int) -> DataFrame:
    """``repo, path, depth``: files around ``changed`` ones, level by level.

    A level's neighbours: what the frontier imports, its tests, what imports it, and for languages without
    imports the files of its directory. One round of joins per level; each level is written before the next.
    Depth 0 or less gives none; a file counts at its first level.
    """
    seen = materialize(changed.select("repo", "path", F.lit(0).alias("depth")).distinct(), "frontier")
    frontier = seen.select("repo", "path")
    linked = ("go", "ts", "tsx", "js", "jsx", "py")
    for level in range(1, depth + 1):
        at = frontier.select("repo", F.col("path").alias("src"))
        forward = edges.unionByName(tests).join(at, ["repo", "src"], "left_semi").select("repo", F.col("dst").alias("path"))
        back = edges.join(frontier.select("repo", F.col("path").alias("dst")), ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("path"))
        folders = frontier.where(~F.lower(ending(F.col("path"))).isin(*linked)).select("repo", parent_dir(F.col("path")).alias("folder")).distinct()
        beside = paths.withColumn("folder", parent_dir(F.col("path"))).join(folders, ["repo", "folder"], "left_semi").select("repo", "path")
        new = forward.unionByName(back).unionByName(beside).distinct().join(seen.select("repo", "path"), ["repo", "path"], "left_anti")
        new = materialize(new.withColumn("depth", F.lit(level)), "frontier")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new.select("repo", "path")
    return seen.where("depth > 0")
