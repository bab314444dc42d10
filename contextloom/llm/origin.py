"""Generated, minified and taken-over source files.

1. Attribute files (``.gitattributes``) are parsed into rules; for each path the rule of the deepest
   directory wins, within one file the last. A declared value is final for its repository.
2. Every file is read once, in Arrow batches, for what its own text says (signature of a tool, origin
   of a copy, stamped-out or squeezed lines) and for a MinHash signature. The narrow marks are written
   once; no text is shuffled.
3. Equivalent path patterns (name prefix, name suffix, directory) are mined for both attributes: in
   repositories that declare, a file counts as declared or not; in the others as its own text tells. Specific
   names overrule general patterns. They are applied to repositories that don't declare the attribute.
4. Copies of third-party code outside its usual directories are found by hash-joining MinHash bands
   with the buckets of known third-party files; the few pairs that meet are compared by their exact shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.llm import minhash
from contextloom.llm.globs import parse_attributes
from contextloom.llm.origin_marks import CODE, FOREIGN_DIRS, LOCK_NAMES, content_marks, extension
from contextloom.sources.tables import spread
from contextloom.storage import materialize

#: Below this share of distinct line runs, code is stamped out from templates.
STAMPED_OUT = 0.58
#: Above this share of space-free long lines, code is data.
DATA_SHARE = 0.8
#: A mined pattern needs so many files, and so large a share of evident ones among them.
MIN_SUPPORT = 4
MIN_DIR_SUPPORT = 8
MIN_SHARE = 0.6
MIN_DIR_SHARE = 0.5
#: A name with at most this share of evident files is one that people use, whatever it looks like.
MAX_KEPT_SHARE = 0.25
SIMILARITY = 0.8
#: Slots of a signature that have to agree before two texts are compared exactly: four deviations below ``SIMILARITY``.
CANDIDATE_SLOTS = 38
ATTRIBUTE_FILE = ".gitattributes"
#: Parts into which the files under one path pattern are split, as a pattern may hold most of all files.
PATTERN_SALTS = 16
#: A bucket with more known texts is told apart by a second band.
HOT_BUCKET = 64

_RULE = "struct<line: int, regex: string, attribute: string, value: boolean>"
_MARKS = (
    "file_id long, repo string, path string, signed boolean, kept boolean, `foreign` boolean, dense boolean, "
    f"repetition float, literal float, is_code boolean, text_id long, sig array<int>, rules array<{_RULE}>"
)


def _text_id(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _read_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ext = [extension(p) for p in pdf["path"]]
        marks = pd.DataFrame([content_marks(p, c) for p, c in zip(pdf["path"], pdf["content"])])
        sigs = minhash.signatures([c if e in CODE else None for e, c in zip(ext, pdf["content"])])
        marks.insert(0, "path", pdf["path"].to_numpy())
        marks.insert(0, "repo", pdf["repo"].to_numpy())
        marks.insert(0, "file_id", pdf["file_id"].to_numpy())
        marks["is_code"] = [e in CODE for e in ext]
        marks["text_id"] = [_text_id(c) for c in pdf["content"]]
        marks["sig"] = [None if s is None else s.astype("uint32").view("int32") for s in sigs]
        marks["rules"] = [
            [dict(zip(("line", "regex", "attribute", "value"), rule)) for rule in parse_attributes(c)] if p.rsplit("/", 1)[-1] == ATTRIBUTE_FILE else None
            for p, c in zip(pdf["path"], pdf["content"])
        ]
        yield marks


def file_marks(files: DataFrame) -> DataFrame:
    """What each file's own text and path say; one row per delivery, files without content left out."""
    source = files.where(F.col("content").isNotNull() & F.col("file_id").isNotNull()).select(
        "file_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), "content"
    )
    return spread(source, "file_id").mapInPandas(_read_marks, _MARKS)


def attribute_rules(told: DataFrame) -> DataFrame:
    """``repo, dir, line, regex, attribute, value`` of all attribute files; few rows, whatever the collection's size."""
    rows = told.where(F.size("rules") > 0).select("repo", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("dir"), F.explode("rules").alias("rule"))
    return rows.select("repo", "dir", "rule.*").distinct()


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``file_id, declared_generated, declared_vendored`` of the files that some rule speaks of.

    The match is an equi-join on (repo, directory of the rule), which is one of the file's ancestors, so
    its size is that of the rules that can apply, never all rules by all files.
    """
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(F.split("path", "/"), 1, n), "/"), F.lit("/"))),
    )
    inside = paths.select("file_id", "repo", "path", F.explode(ancestors).alias("dir"))
    hits = inside.join(rules, ["repo", "dir"]).where(F.expr("substring(path, length(dir) + 1) rlike regex"))
    rank = F.struct(F.length("dir").alias("depth"), F.col("line"))
    best = hits.groupBy("file_id").agg(
        F.max_by(F.when(F.col("attribute") == "generated", F.col("value")), F.when(F.col("attribute") == "generated", rank)).alias("declared_generated"),
        F.max_by(F.when(F.col("attribute") == "vendored", F.col("value")), F.when(F.col("attribute") == "vendored", rank)).alias("declared_vendored"),
    )
    return best


def path_patterns(path: Column) -> Column:
    """Patterns that a path falls under, as ``struct(kind, rank, pattern)``; a higher rank is more specific.

    Kinds: ``dir``, ``name`` (shapes of names) and ``own`` (one name, whatever its directory and ending).
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(name, r"(\.(test|spec))?\.[^.]*$", "")
    core = F.regexp_replace(stem, r"^test_|_(test|spec)$|(Test|Spec)$", "")
    prefix = F.regexp_extract(stem, r"^([A-Za-z0-9]+_)[^_]+_[^_]+", 1)
    prefix2 = F.regexp_extract(stem, r"^([A-Za-z0-9]+_[A-Za-z0-9]+_)[^_]+_[^_]+", 1)
    suffix = F.regexp_extract(stem, r"[^_]_[^_]+(_[A-Za-z0-9]+)$", 1)
    inner = F.regexp_extract(name, r"[^.](\.[A-Za-z]+\.[^.]+)$", 1)
    camel = F.regexp_extract(stem, r"[a-z0-9]((?:[A-Z][a-z0-9]+){1,2})$", 1)
    camel1 = F.regexp_extract(stem, r"[a-z0-9]([A-Z][a-z0-9]+)$", 1)
    parent = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    parents = F.regexp_extract(path, r"([^/]+/[^/]+)/[^/]*$", 1)
    grand = F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]*$", 1)

    def entry(kind: str, rank: int, value: Column, *shape: Column) -> Column:
        return F.when(value != "", F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), F.concat(*shape).alias("pattern")))

    star = F.lit("*")
    return F.filter(
        F.array(
            entry("dir", 1, grand, F.lit("**/"), grand, F.lit("/*/*")),
            entry("dir", 2, parent, F.lit("**/"), parent, F.lit("/*")),
            entry("dir", 3, parents, F.lit("**/"), parents, F.lit("/*")),
            entry("name", 1, prefix, prefix, star, ext),
            entry("name", 1, suffix, star, suffix, ext),
            entry("name", 1, inner, star, inner),
            entry("name", 1, camel1, star, camel1, ext),
            entry("name", 2, camel, star, camel, ext),
            entry("name", 2, prefix2, prefix2, star, ext),
            entry("own", 1, core, core, F.lit(".*")),
        ),
        lambda p: p.isNotNull(),
    )


def mined_patterns(marks: DataFrame) -> DataFrame:
    """``attribute, kind, pattern, verdict``: patterns that evidence makes generated or vendored (true), or that people's files fill (false).

    ``marks`` has the evidence as ``evident_generated`` and ``evident_vendored``, null where a file has no say.
    A count per pattern over all files; it is combined before the shuffle, as patterns repeat.
    """
    evidence = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"evident_{a}").alias("evident")) for a in ("generated", "vendored")])
    counted = (
        marks.where("is_code")
        .select(F.explode(path_patterns(F.col("path"))).alias("p"), evidence.alias("evidence"))
        .select("p.kind", "p.pattern", F.explode("evidence").alias("e"))
        .where(F.col("e.evident").isNotNull())
        .groupBy("e.attribute", "kind", "pattern")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e.evident").cast("long")).alias("k"))
    )
    share = F.col("k") / F.col("n")
    least = F.when(F.col("kind") == "dir", MIN_DIR_SUPPORT).otherwise(MIN_SUPPORT)
    enough = F.when(F.col("kind") == "dir", MIN_DIR_SHARE).otherwise(MIN_SHARE)
    yes, no = share >= enough, (share <= MAX_KEPT_SHARE) & (F.col("kind") != "name")
    return counted.where((F.col("n") >= least) & (yes | no)).select("attribute", "kind", "pattern", yes.alias("verdict"))


def mined_verdicts(marks: DataFrame, patterns: DataFrame) -> DataFrame:
    """``file_id, mined_generated, mined_vendored``: what a path is by the patterns.

    The most specific pattern of each kind decides for its kind, no before yes; a name of its own that
    people use overrules the rest. Files under one pattern are joined in ``PATTERN_SALTS`` parts.
    """
    salt = F.pmod(F.xxhash64("file_id"), F.lit(PATTERN_SALTS)).cast("int").alias("salt")
    under = marks.where("is_code").select("file_id", salt, F.explode(path_patterns(F.col("path"))).alias("p")).select("file_id", "salt", "p.kind", "p.rank", "p.pattern")
    salted = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PATTERN_SALTS - 1))))

    def decided(kind: str, attribute: str) -> Column:
        here = (F.col("kind") == kind) & (F.col("attribute") == attribute)
        return F.max(F.when(here, F.struct("rank", (~F.col("verdict")).alias("no"), F.lit(1).alias("one")))).getField("no").alias(f"{kind}_{attribute}")

    kinds, attributes = ("dir", "name", "own"), ("generated", "vendored")
    votes = under.join(salted, ["kind", "pattern", "salt"]).groupBy("file_id").agg(*[decided(k, a) for a in attributes for k in kinds])
    yes = lambda kind, a: F.coalesce(~F.col(f"{kind}_{a}"), F.lit(False))
    said = [((yes("dir", a) | yes("name", a) | yes("own", a)) & ~F.coalesce(F.col(f"own_{a}"), F.lit(False))).alias(f"mined_{a}") for a in attributes]
    return votes.select("file_id", *said)


def in_foreign_dir(path: Column) -> Column:
    """Whether a directory above the file is one for other projects' code."""
    return F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d.isin(sorted(FOREIGN_DIRS)))


def _read_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"text_id": [_text_id(c) for c in pdf["content"]], "shingles": [minhash.shingles(c) for c in pdf["content"]]})


def foreign_copies(known: DataFrame, others: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id`` of the ``others`` that equal a ``known`` file in ``SIMILARITY`` of their shingles or more.

    Equal texts collapse first on both sides, so a text that a third of all files share is one row.
    Each bucket names one of its known texts; a text that isn't similar enough to any of those is compared
    with all known texts of its buckets, where a bucket of more than ``HOT_BUCKET`` is told apart by each text's
    other bands first: similar texts share several. Only bucket keys and ids are joined; signatures are fetched for the
    pairs that meet, and of the texts of those that agree in ``CANDIDATE_SLOTS`` the shingles are compared.
    """
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(minhash.BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * minhash.ROWS + 1, minhash.ROWS))))
    distinct = lambda df: df.where(F.col("sig").isNotNull()).groupBy("text_id").agg(F.first("sig").alias("sig"), F.min("file_id").alias("file_id"))
    known_texts, other_texts = distinct(known), distinct(others)
    known_rows = known_texts.select(F.col("text_id").alias("known_id"), band.alias("band"))
    leaders = known_rows.groupBy("band").agg(F.min("known_id").alias("known_id"))
    rows = other_texts.select("text_id", band.alias("band"))
    members = known_texts.select("file_id", "text_id").unionByName(other_texts.select("file_id", "text_id"))

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        agree = F.aggregate(F.zip_with("sig", "known_sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
        met = (
            pairs.distinct()
            .join(other_texts.select("text_id", "sig"), "text_id")
            .join(known_texts.select(F.col("text_id").alias("known_id"), F.col("sig").alias("known_sig")), "known_id")
            .where(agree >= CANDIDATE_SLOTS)
            .select("text_id", "known_id")
        )
        met = materialize(met, f"origin-{name}-pairs")
        needed = met.select("text_id").union(met.select("known_id")).distinct()
        needed = materialize(members.join(needed, "text_id", "left_semi").groupBy("text_id").agg(F.min("file_id").alias("file_id")), f"origin-{name}-needed")
        # A file delivered with several contents gives several texts; each is known by its hash.
        texts = files.where(F.col("content").isNotNull()).select("file_id", "content").join(needed.select("file_id").distinct(), "file_id", "left_semi")
        sets = materialize(texts.select("content").mapInPandas(_read_shingles, "text_id long, shingles array<long>").dropDuplicates(["text_id"]), f"origin-{name}-shingles")
        both = F.size(F.array_intersect("shingles", "known_shingles"))
        return (
            met.join(sets, "text_id")
            .join(sets.select(F.col("text_id").alias("known_id"), F.col("shingles").alias("known_shingles")), "known_id")
            .where(both >= SIMILARITY * (F.size("shingles") + F.size("known_shingles") - both))
            .select("text_id")
            .distinct()
        )

    near = materialize(rows.join(leaders, "band").select("text_id", "known_id").distinct(), "origin-near")
    first = materialize(similar(near, "first"), "origin-first")
    rest = near.select("text_id").distinct().join(first, "text_id", "left_anti")
    hot = known_rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("band")
    left, known_by = rows.join(rest, "text_id", "left_semi"), known_rows.withColumnRenamed("known_id", "text_id")

    def by_two_bands(bands: DataFrame) -> DataFrame:
        crowded = bands.join(hot, "band", "left_semi").select("text_id", F.col("band").alias("hot"))
        return crowded.join(bands, "text_id").where("band <> hot").select("text_id", F.xxhash64("hot", "band").alias("band"))

    plain = left.join(hot, "band", "left_anti").unionByName(by_two_bands(left).select("text_id", "band"), allowMissingColumns=True)
    known_plain = known_by.join(hot, "band", "left_anti").unionByName(by_two_bands(known_by)).withColumnRenamed("text_id", "known_id")
    second = similar(plain.join(known_plain, "band").select("text_id", "known_id"), "second")
    return others.join(first.union(second), "text_id", "left_semi").select("file_id").distinct()


def source_origins(files: DataFrame) -> DataFrame:
    """``file_id, origin, reason`` of every file with content; ``origin`` is ``hand_written`` or what it is instead.

    Origins: ``generated`` (lock files included), ``minified``, ``vendored``, ``data``. Files delivered again
    give one row. A null path or repo counts as an empty one, an empty text as hand-written unless its path
    says otherwise. Further columns are ignored; an empty table gives an empty result.
    """
    told = materialize(file_marks(files), "origin-marks")
    rules = attribute_rules(told)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    looks_foreign = in_foreign_dir(F.col("path")) | F.col("foreign")
    marks = told.drop("sig", "text_id", "rules").dropDuplicates(["file_id"])
    known = told.where(looks_foreign).select("file_id", "text_id", "sig")
    others = told.where(~looks_foreign).select("file_id", "text_id", "sig")
    if rules.isEmpty():
        marks = marks.withColumns({f"declared_{a}": F.lit(None).cast("boolean") for a in ("generated", "vendored")} | {f"declares_{a}": F.lit(False) for a in ("generated", "vendored")})
    else:
        spoken = declared(marks.select("file_id", "repo", "path"), rules)
        declaring = rules.groupBy("repo").agg(*[F.bool_or(F.col("attribute") == a).alias(f"declares_{a}") for a in ("generated", "vendored")])
        marks = marks.join(spoken, "file_id", "left").join(declaring, "repo", "left").fillna(False, ["declares_generated", "declares_vendored"])
        said = spoken.where(F.col("declared_vendored").isNotNull()).select("file_id", "declared_vendored")
        both = told.select("file_id", "text_id", "sig", looks_foreign.alias("looks")).join(said, "file_id", "left").withColumn("known", F.coalesce("declared_vendored", "looks"))
        known, others = both.where("known").select("file_id", "text_id", "sig"), both.where("NOT known").select("file_id", "text_id", "sig")
    marks = marks.withColumns(
        {
            "stamped": (F.col("repetition") < STAMPED_OUT) & ~F.col("kept"),
            "known_foreign": F.coalesce("declared_vendored", looks_foreign),
        }
    )
    # a repository that declares speaks for all its files; where none does, a file's own text is the evidence
    made = F.when(F.col("declares_generated"), F.coalesce("declared_generated", F.lit(False))).otherwise(F.col("signed") | F.col("stamped"))
    taken = F.when(F.col("declares_vendored"), F.coalesce("declared_vendored", F.lit(False))).otherwise(F.col("foreign"))
    patterns = mined_patterns(
        marks.withColumns({"evident_generated": F.when(~F.col("known_foreign") & ~F.col("dense"), made), "evident_vendored": F.when(~F.col("dense"), taken)})
    )
    verdicts = mined_verdicts(marks.where("NOT declares_generated OR NOT declares_vendored"), patterns)
    copies = foreign_copies(known, others, files).withColumn("is_copy", F.lit(True))
    everything = (
        marks
        .join(verdicts, "file_id", "left")
        .join(copies, "file_id", "left")
    )
    mined = F.coalesce("mined_generated", F.lit(False)) & ~F.col("kept") & ~F.col("declares_generated")
    mined_foreign = F.coalesce("mined_vendored", F.lit(False)) & ~F.col("kept") & ~F.col("declares_vendored")
    reason = (
        F.when(F.col("declared_vendored"), "declared vendored")
        .when(F.col("declared_generated"), "declared generated")
        .when(name.isin(sorted(LOCK_NAMES)), "lock file")
        .when(F.col("known_foreign"), F.when(F.col("foreign"), "names another project").otherwise("third-party directory"))
        .when(F.coalesce("is_copy", F.lit(False)), "copy of third-party code")
        .when(mined_foreign, "mined third-party path")
        .when(F.col("declared_generated") == F.lit(False), None)
        .when(F.col("dense"), "minified")
        .when(F.col("literal") >= DATA_SHARE, "data")
        .when(F.col("signed"), "signed by a tool")
        .when(F.col("stamped"), "stamped out")
        .when(mined, "mined path pattern")
    )
    origin = (
        F.when(reason.isNull(), "hand_written")
        .when(reason.isin("declared vendored", "names another project", "third-party directory", "copy of third-party code", "mined third-party path"), "vendored")
        .when(reason == "minified", "minified")
        .when(reason == "data", "data")
        .otherwise("generated")
    )
    return everything.select("file_id", origin.alias("origin"), F.coalesce(reason, F.lit("")).alias("reason"))
