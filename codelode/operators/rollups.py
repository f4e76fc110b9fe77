"""Reports, roll-ups, rankings and listings over the fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.functions.access import flag_list, java_version
from codelode.operators.ordered import number_rows
from codelode.operators.usage import FAMILIES, INVOKE_KINDS


def archive_report(archives: DataFrame, classes: DataFrame, resources: DataFrame, call_sites: DataFrame) -> DataFrame:
    """One row of counters per archive; each table is counted on its own and joined by archive."""
    per = lambda df, *aggs: df.groupBy("archive_id").agg(*aggs)
    versioned = F.col("runtime_version") > 0
    kind = F.col("kind")
    counts = [
        per(classes, F.count_if(~versioned).alias("class_count"), F.count_if(versioned).alias("versioned_class_count")),
        per(resources, F.count("*").alias("resource_count")),
        per(
            call_sites,
            F.count_if(kind.isin(INVOKE_KINDS)).alias("method_call_count"),
            F.count_if(kind.isin(FAMILIES["read"] + FAMILIES["write"])).alias("field_access_count"),
            F.count_if(kind.isin(FAMILIES["type"])).alias("class_use_count"),
        ),
    ]
    out = archives
    for c in counts:
        out = out.join(c, "archive_id", "left")
    counters = [c for df in counts for c in df.columns if c != "archive_id"]
    return out.select(*archives.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters])


def _ancestor_prefixes(path: Column, sep: str) -> Column:
    """``a.b.c`` to ``[a, a.b, a.b.c]``; nothing for an empty path."""
    parts = F.split(path, f"[{sep}]")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), sep)
    )
    return F.when(path == "", F.array().cast("array<string>")).otherwise(prefixes)


def folder_rollup(rows: DataFrame, path: str, sep: str, by: list[str]) -> DataFrame:
    """Entries directly in, and anywhere under, every ancestor folder of ``path``.

    Rows are counted per folder before prefixes are exploded, so a folder of a million entries
    contributes its depth, not a million rows.
    """
    own = rows.groupBy(*by, F.col(path).alias("own_path")).agg(F.count("*").alias("n"))
    return (
        own.select(*by, "own_path", "n", F.explode(_ancestor_prefixes(F.col("own_path"), sep)).alias("folder"))
        .groupBy(*by, "folder")
        .agg(
            F.sum("n").alias("entries_below"),
            F.coalesce(F.sum(F.when(F.col("folder") == F.col("own_path"), F.col("n"))), F.lit(0)).alias("entries_here"),
        )
        .withColumn("label", F.substring_index("folder", sep, -1))
    )


def package_rollup(classes: DataFrame) -> DataFrame:
    """Package tree of the plain classes, and one per runtime version for versioned ones."""
    return folder_rollup(classes, "package_name", ".", ["archive_id", "runtime_version"])


def resource_rollup(resources: DataFrame) -> DataFrame:
    rows = resources.withColumn("folder_path", S.parent_path(F.col("path")))
    return folder_rollup(rows, "folder_path", "/", ["archive_id"])


# --- fixed values: which kind of node comes first among the children of a node ------------------
NODE_RANKS = {"PACKAGE": 0, "RESOURCE_FOLDER": 1, "CLASS": 2, "RESOURCE": 3, "MULTI_RELEASE_ROOT": 4, "MULTI_RELEASE_VERSION": 5}


def _step(kind: str, label: Column) -> Column:
    """A node's part of a sort path: children follow their parent, by kind, then by label without regard to case."""
    return F.concat(F.lit(f"{NODE_RANKS[kind]}\x02"), F.lower(F.upper(label)), F.lit("\x02"), label, F.lit("\x01"))


def archive_tree(classes: DataFrame, resources: DataFrame) -> DataFrame:
    """The tree of every archive in the order it is shown: ``(archive_id, position, depth, kind, label, sort_path)``.

    Packages and classes stand at the top, classes for later runtime versions in packages under ``[Multi-Release]`` and their version,
    resources in their folders under ``resources``.  A sort path is made of the steps from the top, so sorting by it
    gives each node before its children.  Folders are made distinct before their ancestors are exploded; an archive of
    any size is numbered in parts.
    """
    version = F.coalesce(F.col("runtime_version"), F.lit(0)) if "runtime_version" in classes.columns else F.lit(0)
    parts = lambda path, sep: F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, f"[{sep}]"))
    java = F.concat(F.lit("Java "), version.cast("string"))
    many, none = _step("MULTI_RELEASE_ROOT", F.lit("[Multi-Release]")), F.lit("")
    leaf = lambda rows, kind, folder_kind, label, folders, top, depth: rows.select(
        "archive_id", F.lit(kind).alias("kind"), F.lit(folder_kind).alias("folder_kind"), label.alias("label"), folders.alias("folders"),
        top.alias("top"), depth.cast("int").alias("depth"), (version if kind == "CLASS" else F.lit(0)).alias("version"),
    )
    package = parts(F.coalesce("package_name", F.lit("")), ".")
    later = version > 0
    leaves = leaf(
        classes, "CLASS", "PACKAGE", F.col("simple_name"), package,
        F.when(later, F.concat(many, _step("MULTI_RELEASE_VERSION", java))).otherwise(none), F.when(later, 2).otherwise(0),
    ).unionByName(
        leaf(
            resources, "RESOURCE", "RESOURCE_FOLDER", S.simple_name(F.col("path")), parts(S.parent_path(F.col("path")), "/"),
            _step("RESOURCE_FOLDER", F.lit("resources")), F.lit(1),
        )
    )
    steps = F.when(F.col("folder_kind") == "PACKAGE", F.transform("folders", lambda x: _step("PACKAGE", x))).otherwise(
        F.transform("folders", lambda x: _step("RESOURCE_FOLDER", x))
    )
    own = F.when(F.col("kind") == "CLASS", _step("CLASS", F.col("label"))).otherwise(_step("RESOURCE", F.col("label")))
    rows = leaves.select(
        "archive_id", (F.col("depth") + F.size("folders")).alias("depth"), "kind", "label", F.concat("top", F.array_join(steps, ""), own).alias("sort_path")
    )
    held = leaves.select("archive_id", "folder_kind", "folders", "top", "depth").distinct().withColumn("steps", steps)
    folders = held.filter(F.size("folders") > 0).select("*", F.explode(F.sequence(F.lit(1), F.size("folders"))).alias("n")).select(
        "archive_id", (F.col("depth") + F.col("n") - 1).alias("depth"), F.col("folder_kind").alias("kind"), F.get("folders", F.col("n") - 1).alias("label"),
        F.concat("top", F.array_join(F.slice("steps", F.lit(1), F.col("n")), "")).alias("sort_path"),
    )
    named = lambda kind, label, depth, path: F.struct(F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), label.alias("label"), path.alias("sort_path"))
    shown = F.col("version").cast("string")
    tops = leaves.select("archive_id", "kind", "version", "top").distinct().filter("top <> ''").select(
        "archive_id",
        F.explode(
            F.when(F.col("kind") == "RESOURCE", F.array(named("RESOURCE_FOLDER", F.lit("resources"), 0, F.col("top")))).otherwise(
                F.array(named("MULTI_RELEASE_ROOT", F.lit("[Multi-Release]"), 0, many), named("MULTI_RELEASE_VERSION", F.concat(F.lit("Java "), shown), 1, F.col("top")))
            )
        ).alias("t"),
    ).select("archive_id", "t.*")
    nodes = rows.unionByName(folders.unionByName(tops).distinct())
    return number_rows(nodes, ["archive_id"], ["sort_path"], "position").select("archive_id", "position", "depth", "kind", "label", "sort_path")


def member_listing(methods: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields as declared, then initialisers, then methods by name: ``position`` per class.

    A class file declares at most 65 535 fields and as many methods, so the window stays bounded.
    """
    empty = F.lit("")
    f = fields.select("archive_id", "owner", F.lit("FIELD").alias("kind"), "name", "desc",
                      F.lit(0).alias("block"), empty.alias("sort_name"), "ordinal")
    m = methods.select("archive_id", "owner", F.lit("METHOD").alias("kind"), "name", "desc",
                       F.when(F.col("name").startswith("<"), 1).otherwise(2).alias("block"),
                       F.col("name").alias("sort_name"), "ordinal")
    order = Window.partitionBy("archive_id", "owner").orderBy("block", "sort_name", "ordinal", "name", "desc")
    listed = f.unionByName(m).withColumn("position", F.row_number().over(order))
    return listed.drop("block", "sort_name", "ordinal")


def class_overview(classes: DataFrame) -> DataFrame:
    """Readable header facts of classes."""
    return classes.select(
        "archive_id", "internal_name",
        F.concat_ws(" ", flag_list(F.col("access"), "class")).alias("flags"),
        java_version(F.col("major")).alias("java_version"),
    )


def go_to_class(classes: DataFrame, text: str) -> DataFrame:
    """The shortest class name containing the text; ties go to the smallest name."""
    if not text.strip():
        return classes.select("archive_id", "name").limit(0)
    name = F.col("name")
    best = F.min_by(F.struct("name"), F.struct(F.length(name), name)).alias("best")
    return (
        classes.filter(F.lower(name).contains(text.lower()))
        .groupBy("archive_id")
        .agg(best)
        .select("archive_id", "best.name")
    )


def fuzzy_rank(paths: DataFrame, text: str) -> DataFrame:
    """Score by file name, by the whole path when the name does not match; best first."""
    needle = F.lit(text.strip())
    by_name = S.fuzzy_score(S.simple_name(F.col("path")), needle)
    scored = paths.withColumn("by_name", by_name).withColumn(
        "score", F.when(F.col("by_name") >= 0, F.col("by_name")).otherwise(S.fuzzy_score(F.col("path"), needle))
    )
    return scored.filter(F.col("score") >= 0).drop("by_name").orderBy("score", "path")


def pass_counters(counters: DataFrame) -> DataFrame:
    """Sum ``(pass, counter, n)`` rows of rewrite passes."""
    return counters.groupBy("pass", "counter").agg(F.sum("n").alias("n"))
