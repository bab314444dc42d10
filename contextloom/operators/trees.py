"""Directory trees: nodes, roll-ups of a selection, patterns that stand for it, and drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.functions.text import parent_dir


def directories(paths: DataFrame, *carry: str) -> DataFrame:
    """Each path once per directory above it: ``repo, path, carry, dir, depth``; files at the top have none."""
    parts = F.split("path", "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return paths.select("repo", "path", *carry, F.explode(above).alias("dir")).withColumn("depth", F.size(F.split("dir", "/")))


def selection_states(paths: DataFrame, included: str = "included") -> DataFrame:
    """``repo, dir, n_files, state``: ``included``, ``excluded`` or ``partial``, by what the directory holds at any depth."""
    grouped = directories(paths, included).groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n_files"), F.min(F.col(included).cast("int")).alias("lo"), F.max(F.col(included).cast("int")).alias("hi"))
    state = F.when(F.col("lo") == 1, "included").when(F.col("hi") == 0, "excluded").otherwise("partial")
    return grouped.select("repo", "dir", "n_files", state.alias("state"))


def selection_patterns(paths: DataFrame, included: str = "included") -> DataFrame:
    """``repo, pattern``: the fewest patterns for a selection: ``dir/**`` of topmost whole directories, else single files."""
    whole = selection_states(paths, included).where("state = 'included'").select("repo", "dir")
    parents = whole.withColumn("above", parent_dir(F.col("dir")))
    top = parents.join(whole.select("repo", F.col("dir").alias("above")), ["repo", "above"], "left_anti").select("repo", "dir")
    single = paths.where(F.col(included)).select("repo", "path", parent_dir(F.col("path")).alias("dir")).join(whole, ["repo", "dir"], "left_anti")
    return top.select("repo", F.concat("dir", F.lit("/**")).alias("pattern")).unionByName(single.select("repo", F.col("path").alias("pattern")))


def tree_nodes(paths: DataFrame) -> DataFrame:
    """``repo, parent, name, is_dir, n_files, tokens``: the edges of the tree, with sizes rolled up."""
    rolled = directories(paths, "tokens").groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("tokens").alias("tokens"))
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    dirs = rolled.select("repo", parent_dir(F.col("dir")).alias("parent"), name(F.col("dir")).alias("name"), F.lit(True).alias("is_dir"), "n_files", "tokens")
    leaves = paths.select("repo", parent_dir(F.col("path")).alias("parent"), name(F.col("path")).alias("name"), F.lit(False).alias("is_dir"), F.lit(1).cast("long").alias("n_files"), "tokens")
    return dirs.unionByName(leaves)


def drawn_tree(paths: list[str], max_depth: int = 0) -> str:
    """A drawing of one repository's tree: directories first, names without regard to case, single-directory chains joined."""
    root: dict = {}
    for path in paths:
        node = root
        *above, leaf = [p for p in path.split("/") if p]
        for part in above:
            node = node.setdefault(part + "/", {})
        node[leaf] = None
    lines: list[str] = []

    def draw(node: dict, lead: str, depth: int) -> None:
        entries = sorted(node.items(), key=lambda e: (e[1] is None, e[0].lower(), e[0]))
        for n, (name, child) in enumerate(entries):
            while child and len(child) == 1 and depth > 0 and next(iter(child.values())) is not None:
                more, child = next(iter(child.items()))
                name += more
            last = n == len(entries) - 1
            lines.append(f"{lead}{'└── ' if last else '├── '}{name}")
            if child:
                below = lead + ("    " if last else "│   ")
                if max_depth and depth + 1 >= max_depth:
                    lines.append(below + "...")
                else:
                    draw(child, below, depth + 1)

    draw(root, "", 0)
    return "\n".join(lines)


def repository_trees(paths: DataFrame, max_depth: int = 0) -> DataFrame:
    """``repo, tree``: each repository's tree as one text, so a repository's paths have to fit in a task."""

    def run(key, pdf):
        import pandas as pd

        return pd.DataFrame({"repo": [key[0]], "tree": [drawn_tree(sorted(pdf["path"]), max_depth)]})

    return paths.select("repo", "path").groupBy("repo").applyInPandas(run, "repo string, tree string")
