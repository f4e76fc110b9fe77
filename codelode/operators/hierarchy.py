"""Type hierarchy: edges, ancestor chains, subtype closures and trees, overriders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions.access import bit, class_kind
from codelode.operators.adjacency import Adjacency, stored_edges
from codelode.operators.identity import definitions
from codelode.session import cut_lineage


def hierarchy_edges(classes: DataFrame) -> DataFrame:
    """``(archive_id, child, parent, edge_kind)`` for direct extends and implements."""
    tagged = lambda kind, parent: F.struct(F.lit(kind).alias("edge_kind"), parent.alias("parent"))
    parents = F.concat(
        F.array(tagged("EXTENDS", F.col("super_name"))),
        F.transform(F.coalesce("interfaces", F.array()), lambda i: tagged("IMPLEMENTS", i)),
    )
    return (
        classes.select("archive_id", F.col("internal_name").alias("child"), F.explode(parents).alias("e"))
        .select("archive_id", "child", "e.parent", "e.edge_kind")
        .filter(F.col("parent").isNotNull())
    )


def with_class_kind(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Add the kind of ``nodes(archive_id, internal_name)``; classes outside the archive are EXTERNAL."""
    known = definitions(classes, "access")
    return nodes.join(known, ["archive_id", "internal_name"], "left").withColumn(
        "kind", class_kind(F.col("access"))
    ).drop("access")


def direct_interfaces(classes: DataFrame, name: str) -> DataFrame:
    return classes.filter(F.col("internal_name") == name).select(
        "archive_id", F.explode("interfaces").alias("interface")
    )


def direct_implementers(edges: DataFrame, interface: str) -> DataFrame:
    return edges.filter((F.col("edge_kind") == "IMPLEMENTS") & (F.col("parent") == interface)).select(
        "archive_id", "child"
    )


def ancestor_chains(seeds: DataFrame, classes: DataFrame) -> DataFrame:
    """Superclass chain of every ``seeds(archive_id, internal_name)``: rows ``(archive_id, start, level, node)``.

    Level 0 is the root-most ancestor.  The chain ends with the first class outside the archive and holds no class twice, so
    superclasses in a circle end it too.  Pointer doubling: after k rounds a table of jumps leads 2^k classes up and the rows hold
    the nearest 2^k classes of each chain; a round applies the jumps to all rows and to themselves.  A chain of n classes
    takes about log2(n) rounds and is n short rows, in any task.
    """
    key = ["archive_id", "start", "node"]
    jumps = definitions(classes, "super_name").select("archive_id", F.col("internal_name").alias("node"), F.col("super_name").alias("far"))
    jumps = cut_lineage(jumps.where("far is not null and far <> node"))
    rows = seeds.select("archive_id", F.col("internal_name").alias("start"), F.col("internal_name").alias("node"), F.lit(0).alias("dist")).distinct()
    rows = cut_lineage(rows)
    n, reach = rows.count(), 1
    while True:
        up = rows.join(jumps, ["archive_id", "node"]).select("archive_id", "start", F.col("far").alias("node"), (F.col("dist") + reach).alias("dist"))
        # A node that comes up again lies on a circle; it stays where it was met first.
        rows = cut_lineage(rows.unionByName(up).groupBy(*key).agg(F.min("dist").alias("dist")))
        before, n = n, rows.count()
        if n == before:
            break
        reach *= 2
        further = jumps.select("archive_id", F.col("node").alias("far"), F.col("far").alias("beyond"))
        jumps = cut_lineage(jumps.join(further, ["archive_id", "far"]).select("archive_id", "node", F.col("beyond").alias("far")))
    top = F.max("dist").over(Window.partitionBy("archive_id", "start"))
    return rows.select("archive_id", "start", (top - F.col("dist")).alias("level"), "node")


def type_edges(edges: DataFrame) -> DataFrame:
    """Hierarchy edges as ``(archive_id, src, dst)``, child to parent, each once; what ``Adjacency.build`` takes."""
    return edges.select("archive_id", F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()


def subtype_closure(seeds: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """All subtypes of each seed, itself included: ``(archive_id, root, node)`` without repeats.

    Takes hierarchy edges, or the table that ``Adjacency.build(type_edges(edges), path)`` wrote; of that only the folders of the
    frontier are read.
    """
    table = stored_edges(edges, type_edges)
    frontier = cut_lineage(
        seeds.select("archive_id", F.col("internal_name").alias("root"), F.col("internal_name").alias("node")).distinct()
    )
    visited = frontier
    while buckets := table.touched(frontier):
        found = table.around(frontier, "IN", buckets).select("archive_id", "root", F.col("src").alias("node")).distinct()
        frontier = cut_lineage(found.join(visited, ["archive_id", "root", "node"], "left_anti"))
        visited = visited.unionByName(frontier)
    return visited


def subtype_tree(seeds: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """Subtype tree rows ``(root, parent, node, path, expanded)`` in depth-first order of ``path``.

    Children are sorted by name.  A class reached twice opens its children only where a depth-first
    walk meets it first, which is at its smallest path; every other row of it is a leaf.  Smallest
    paths are found by relaxing the frontier, so no path is enumerated that is not a best one.
    Takes the same edges as ``subtype_closure``.
    """
    keys = ["archive_id", "root", "node"]
    table = stored_edges(edges, type_edges)
    best = cut_lineage(
        seeds.select(
            "archive_id", F.col("internal_name").alias("root"), F.col("internal_name").alias("node"),
            F.array("internal_name").alias("path"),
        ).distinct()
    )
    start = frontier = best
    while buckets := table.touched(frontier):
        reached = (
            table.around(frontier, "IN", buckets)
            .filter(~F.array_contains("path", F.col("src")))
            .select("archive_id", "root", F.col("src").alias("node"), F.array_append("path", F.col("src")).alias("path"))
            .groupBy(*keys)
            .agg(F.min("path").alias("new_path"))
        )
        frontier = cut_lineage(
            reached.join(best, keys, "left")
            .filter(F.col("path").isNull() | (F.col("new_path") < F.col("path")))
            .select(*keys, F.col("new_path").alias("path"))
        )
        best = cut_lineage(
            best.join(frontier.select(*keys), keys, "left_anti").unionByName(frontier)
        )
    children = table.around(best, "IN").select(
        "archive_id", "root", F.col("node").alias("parent"), F.col("src").alias("node"), F.array_append("path", F.col("src")).alias("path")
    )
    first = best.select(*keys, F.col("path").alias("best_path"))
    rows = children.join(first, keys, "left").select(
        "archive_id", "root", "parent", "node", "path",
        F.coalesce(F.col("path") == F.col("best_path"), F.lit(False)).alias("expanded"),
    )
    roots = start.select(
        "archive_id", "root", F.lit(None).cast("string").alias("parent"), "node", "path", F.lit(True).alias("expanded")
    )
    return roots.unionByName(rows)


def implementers(seeds: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """Subtype closure without the seed itself."""
    return subtype_closure(seeds, edges).filter(F.col("root") != F.col("node"))


def overriders(targets: DataFrame, edges: DataFrame | Adjacency, methods: DataFrame) -> DataFrame:
    """Subtypes declaring the same method: ``targets(archive_id, declaring, name, desc)``.

    Static and private declarations do not override, and constructors are never dispatched.
    """
    wanted = targets.filter(~F.col("name").isin("<init>", "<clinit>"))
    seeds = wanted.select("archive_id", F.col("declaring").alias("internal_name")).distinct()
    below = implementers(seeds, edges).select(
        "archive_id", F.col("root").alias("declaring"), F.col("node").alias("internal_name")
    )
    access = F.col("access")
    candidates = methods.filter(~bit(access, "static", "method") & ~bit(access, "private", "method")).select(
        "archive_id", F.col("owner").alias("internal_name"), "name", "desc", "access"
    )
    return (
        wanted.join(below, ["archive_id", "declaring"])
        .join(candidates, ["archive_id", "internal_name", "name", "desc"])
        .select("archive_id", "declaring", "name", "desc", "internal_name", "access")
    )
