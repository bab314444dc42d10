"""Comparing states: snapshots against each other, version-control output, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.functions.text import xml_attribute


def compared_states(previous: DataFrame, current: DataFrame, *keys: str) -> DataFrame:
    """``keys, path, change``: a full outer hash join on path; ``added``, ``modified``, ``deleted`` or ``unchanged``.

    Presence is told by the row, not by its hash; two null hashes are equal, one null hash is a change. Rows
    repeated on a side collapse to the greatest hash. Size and time don't matter.
    """
    on = [*keys, "path"]
    side = lambda df, name: df.where(F.col("path").isNotNull()).groupBy(*on).agg(F.max("hash").alias(name), F.lit(True).alias(f"in_{name}"))
    joined = side(previous, "old").join(side(current, "new"), on, "full_outer")
    change = (
        F.when(F.col("in_old").isNull(), "added")
        .when(F.col("in_new").isNull(), "deleted")
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged")
        .otherwise("modified")
    )
    return joined.select(*on, change.alias("change"))


def change_counts(changes: DataFrame, *by: str) -> DataFrame:
    """Per group: numbers of added, modified, deleted and unchanged paths."""
    return changes.groupBy(*by).agg(*[F.sum((F.col("change") == c).cast("long")).alias(f"n_{c}") for c in ("added", "modified", "deleted", "unchanged")])


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """``path, old_path, status`` of lines of a name-status listing; copies are additions, unknown letters raise."""
    parts = F.split(F.col(line), "\t")
    letter = F.substring(F.get(parts, F.lit(0)), 1, 1)
    status = (
        F.when(letter.isin("A", "C"), "added").when(letter == "M", "modified").when(letter == "D", "deleted").when(letter == "R", "renamed")
        .otherwise(F.raise_error(F.concat(F.lit("unknown status: "), F.col(line))))
    )
    moved = letter.isin("R", "C")
    return lines.where(F.trim(line) != "").select(
        F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"), F.when(letter == "R", F.get(parts, F.lit(1))).alias("old_path"), status.alias("status")
    )


def changes_of_status(statuses: DataFrame) -> DataFrame:
    """``path, change``: a rename is a deletion of the old path and an addition of the new one."""
    pair = lambda path, change: F.struct(path.alias("path"), F.lit(change).alias("change"))
    own = F.struct(F.col("path").alias("path"), F.col("status").alias("change"))
    both = F.array(pair(F.col("old_path"), "deleted"), pair(F.col("path"), "added"))
    return statuses.select(F.explode(F.when(F.col("status") == "renamed", both).otherwise(F.array(own))).alias("c")).select("c.path", "c.change").distinct()


def summary_markdown(added: Column, modified: Column, deleted: Column, unchanged: Column) -> Column:
    """The change summary of ordered path arrays; lists of a kind appear only if they hold something."""

    def listed(title: str, paths: Column) -> Column:
        items = F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- `"), p, F.lit("`\n"))), "")
        return F.when(F.size(paths) > 0, F.concat(F.lit(f"\n### {title} Files\n"), items)).otherwise("")

    counts = F.format_string("**%d added** | **%d modified** | **%d deleted** (%d unchanged)\n", F.size(added), F.size(modified), F.size(deleted), unchanged)
    nothing = F.size(added) + F.size(modified) + F.size(deleted) == 0
    return F.when(nothing, F.lit("No changes detected since last run.\n")).otherwise(F.concat(counts, listed("Added", added), listed("Modified", modified), listed("Deleted", deleted)))


def summary_xml(added: Column, modified: Column, deleted: Column, unchanged: Column) -> Column:
    """The change summary of ordered path arrays as XML."""

    def listed(tag: str, paths: Column) -> Column:
        items = F.array_join(F.transform(paths, lambda p: F.concat(F.lit('    <file path="'), xml_attribute(p), F.lit('"/>\n'))), "")
        return F.when(F.size(paths) > 0, F.concat(F.lit(f"  <{tag}_files>\n"), items, F.lit(f"  </{tag}_files>\n"))).otherwise("")

    counts = F.format_string('  <counts added="%d" modified="%d" deleted="%d" unchanged="%d"/>\n', F.size(added), F.size(modified), F.size(deleted), unchanged)
    return F.concat(F.lit("<change_summary>\n"), counts, listed("added", added), listed("modified", modified), listed("deleted", deleted), F.lit("</change_summary>\n"))
