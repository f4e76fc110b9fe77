"""Call graphs: bounded expansion around roots, caller trees, degrees."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators import walks
from codelode.operators.adjacency import FAR, NEAR, Adjacency, stored_edges
from codelode.operators.strong import strong_components
from codelode.operators.usage import method_calls
from codelode.session import cut_lineage

MEMBER = ["owner", "name", "desc"]


def class_node_id(fqn: Column) -> Column:
    return F.concat(F.lit("C:"), fqn)


def method_node_id(fqn: Column, name: Column, desc: Column) -> Column:
    return F.concat(F.lit("M:"), fqn, F.lit("#"), name, desc)


def node_columns(owner: Column, name: Column, desc: Column, mode: str) -> tuple[Column, Column, Column]:
    """``(id, label, fqn)`` of a graph node."""
    fqn = S.dotted(owner)
    simple = S.simple_name(fqn, ".")
    if mode == "CLASS":
        return class_node_id(fqn), simple, fqn
    return method_node_id(fqn, name, desc), F.concat(simple, F.lit("#"), name), fqn


def call_edges(call_sites: DataFrame, mode: str) -> DataFrame:
    """Weighted edges ``(archive_id, src, dst, n)`` over method calls.

    Sites are counted per edge before anything is traversed: a much-called method contributes its
    callers once each, not once per site.
    """
    ends = {"src": ("in_class", "in_method", "in_desc"), "dst": ("target_owner", "target_name", "target_desc")}
    calls = method_calls(call_sites).filter(F.coalesce("target_owner", F.lit("")) != "")
    # Sites are counted by what the ids are made of, so that the ids need not travel.
    parts = [S.dotted(F.col(cols[0])).alias(f"{end}_fqn") for end, cols in ends.items()]
    if mode != "CLASS":
        parts += [F.concat(F.lit("#"), F.col(cols[1]), F.col(cols[2])).alias(f"{end}_member") for end, cols in ends.items()]
    sites = calls.select("archive_id", *parts)
    return sites.groupBy(*sites.columns).agg(F.count("*").alias("n")).selectExpr("*", *[f"{made} AS {end}" for end, made in call_ends(mode).items()])


def call_ends(mode: str) -> dict[str, str]:
    """The ids of an edge from its other columns, for ``Adjacency.build(..., made=...)``."""
    return {end: f"concat('C:', {end}_fqn)" if mode == "CLASS" else f"concat('M:', {end}_fqn, {end}_member)" for end in ("src", "dst")}


#: The same for ``method_edges``.
METHOD_ENDS = {end: f"concat({end}_owner, '#', {end}_name, {end}_desc)" for end in ("src", "dst")}


def method_edges(call_sites: DataFrame) -> DataFrame:
    """Edges between methods ``(archive_id, src, dst, src_*, dst_*, n, line)``: number of sites and line of the first one."""
    calls = method_calls(call_sites)
    ends = {"src": ("in_class", "in_method", "in_desc"), "dst": ("target_owner", "target_name", "target_desc")}
    parts = [F.col(c).alias(f"{end}_{part}") for end, cols in ends.items() for c, part in zip(cols, MEMBER)]
    counted = (
        calls.select("archive_id", *parts, "site_idx", "line")
        .groupBy("archive_id", *[f"{end}_{part}" for end in ends for part in MEMBER])
        .agg(F.count("*").alias("n"), F.min(F.struct("site_idx", "line"))["line"].alias("line"))
    )
    key = lambda end: S.method_key(*[F.col(f"{end}_{part}") for part in MEMBER]).alias(end)
    return counted.select("*", key("src"), key("dst"))


def call_graph(
    call_sites: DataFrame | Adjacency,
    roots: DataFrame,
    mode: str = "CLASS",
    direction: str = "OUT",
    depth: int = 1,
    package_filter: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first call graph around ``roots(archive_id, node)``: ``(nodes, edges)``.

    Takes call sites, or the table that ``Adjacency.build(call_edges(call_sites, mode), path)`` wrote.  Nodes above ``depth`` are
    expanded; every neighbour but the root must pass the package prefix.  An edge weighs its number of sites once
    per expanded end, so with direction BOTH an edge between two expanded nodes counts double.  Self edges are left out.
    """
    table = stored_edges(call_sites, lambda sites: call_edges(sites, mode), call_ends(mode))
    ways = {"OUT": ["OUT"], "IN": ["IN"], "BOTH": ["OUT", "IN"]}[direction]
    frontier = cut_lineage(roots.select("archive_id", "node", F.lit(0).alias("level")).distinct())
    nodes = frontier
    seen_edges: list[DataFrame] = []
    for level in range(depth):
        buckets = table.touched(frontier)
        if not buckets:
            break
        around = [
            table.around(frontier.select("archive_id", "node"), way, buckets)
            .filter(S.included_by_prefix(F.col(f"{FAR[way]}_fqn"), package_filter))
            .select("archive_id", "src", "dst", "n", F.col(FAR[way]).alias("reached"))
            for way in ways
        ]
        step = cut_lineage(reduce(DataFrame.unionByName, around))
        seen_edges.append(step)
        frontier = cut_lineage(
            step.select("archive_id", F.col("reached").alias("node"))
            .distinct()
            .join(nodes, ["archive_id", "node"], "left_anti")
            .withColumn("level", F.lit(level + 1))
        )
        nodes = nodes.unionByName(frontier)
    if not seen_edges:
        empty = table.edges.select("archive_id", "src", "dst", F.col("n").alias("weight")).limit(0)
        return nodes, empty
    weighted = (
        reduce(DataFrame.unionByName, seen_edges)
        .filter(F.col("src") != F.col("dst"))
        .groupBy("archive_id", "src", "dst")
        .agg(F.sum("n").alias("weight"))
    )
    return nodes, weighted


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("src") == node)


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("dst") == node)


def _first_callers(rows: DataFrame, by: list[str], per_node: int | None) -> DataFrame:
    """``cut``: whether callers of the row's callee were left out; at most ``per_node`` of them stay, the first by key."""
    if per_node is None:
        return rows.withColumn("cut", F.lit(False))
    ordered = Window.partitionBy(*by, "dst").orderBy("src")
    # One row past the limit tells that there is more, so Spark may still trim each task's rows before the shuffle.
    some = rows.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= per_node + 1)
    more = F.max("rank").over(Window.partitionBy(*by, "dst")) > per_node
    return some.withColumn("cut", more).filter(F.col("rank") <= per_node).drop("rank")


def _whole_dag(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``caller_dag`` without limits, of ``edges`` that fit one task and ``roots (archive_id, root)``."""
    ends = [edges.select("archive_id", F.col(end).alias("node")) for end in ("src", "dst")]
    salt = walks.numbered(ends[0].unionByName(ends[1]).unionByName(roots.select("archive_id", F.col("root").alias("node"))))
    of = lambda end: walks.node_id(F.col("archive_id"), F.col(end), salt=salt)
    known = edges.where("archive_id is not null and src is not null and dst is not null").withColumns({"src_id": of("src"), "dst_id": of("dst")})
    asked = roots.na.drop().select("root", of("root").alias("root_id"))
    found = walks.climbed(known.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")), asked.select(F.col("root_id").alias("root")))
    found = found.withColumnsRenamed({"root": "root_id", "src": "src_id", "dst": "dst_id"})
    return known.join(found, ["src_id", "dst_id"]).join(asked, "root_id").select(
        "archive_id", "root", F.col("src").alias("caller"), F.col("dst").alias("callee"), "level", "line", F.col("n").alias("sites"), "cyclic",
        F.lit(False).alias("truncated"),
    )


def caller_dag(
    call_sites: DataFrame | Adjacency, roots: DataFrame, depth: int | None = None, per_node: int | None = None
) -> DataFrame:
    """Everything that calls ``roots(archive_id, owner, name, desc)``, directly or not: one row per caller and callee.

    ``(archive_id, root, caller, callee, level, line, sites, cyclic, truncated)``: ``level`` is the least number of calls from the caller to
    the root over this edge, ``line`` that of the edge's first site, and ``cyclic`` says that the callee also reaches the caller, so
    following callers up this edge would come back.  Each method is expanded once per root, at its first level, so there are as
    many rows as edges however many ways lead up.  Takes call sites, or the table that ``Adjacency.build(method_edges(...), path)`` wrote.
    Without limits, one task walks a table of few edges as numbers; a larger one takes a round of joins per level.

    There is no limit unless the caller sets one: ``depth`` ends the walk, ``per_node`` keeps the first callers of a method by
    key.  ``truncated`` marks rows whose callee has more callers than shown, or whose caller was not expanded although it has some.
    """
    table = stored_edges(call_sites, method_edges, METHOD_ENDS)
    by = ["archive_id", "root"]
    key = S.method_key(F.col("owner"), F.col("name"), F.col("desc"))
    frontier = cut_lineage(roots.select("archive_id", key.alias("root"), key.alias("node")).distinct())
    if depth is None and per_node is None:
        edges = table.edges.where("way = 'IN'")
        if edges.count() * frontier.count() <= walks.TASK_EDGES:
            return _whole_dag(edges, frontier.select(*by))
    seen, steps, level = frontier, [], 0
    while (buckets := table.touched(frontier)) and (depth is None or level < depth):
        level += 1
        edges = _first_callers(table.around(frontier, "IN", buckets), by, per_node)
        known = seen.select(*by, F.col("node").alias("src"), F.lit(True).alias("known"))
        step = cut_lineage(
            edges.join(known, [*by, "src"], "left").select(
                *by, "src", "dst", F.lit(level).alias("level"), "line", F.col("n").alias("sites"), "cut", F.col("known").isNull().alias("new")
            )
        )
        steps.append(step.drop("new"))
        frontier = cut_lineage(step.filter("new").select(*by, F.col("src").alias("node")).distinct())
        seen = seen.unionByName(frontier)
    if not steps:
        columns = [F.lit(None).cast(t).alias(c) for c, t in (("caller", "string"), ("callee", "string"), ("level", "int"), ("line", "int"),
                                                              ("sites", "long"), ("cyclic", "boolean"), ("truncated", "boolean"))]
        return frontier.select(*by, *columns).limit(0)
    dag = reduce(DataFrame.unionByName, steps)
    more = table.around(frontier, "IN", buckets).select(*by, F.col("node").alias("src"), F.lit(True).alias("more")).distinct()
    parts = strong_components(dag, by)
    end = lambda name: parts.select(*by, F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
    told = dag.join(end("src"), [*by, "src"], "left").join(end("dst"), [*by, "dst"], "left").join(more, [*by, "src"], "left")
    cyclic = F.coalesce(F.col("src_part") == F.col("dst_part"), F.lit(False)) | (F.col("src") == F.col("dst"))
    return told.select(
        *by, F.col("src").alias("caller"), F.col("dst").alias("callee"), "level", "line", "sites", cyclic.alias("cyclic"),
        (F.col("cut") | F.col("more").isNotNull()).alias("truncated"),
    )


def recursive_callers(
    call_sites: DataFrame | Adjacency, roots: DataFrame, depth: int | None = 5, per_node: int | None = None
) -> DataFrame:
    """Caller trees of ``roots(archive_id, owner, name, desc)``: one row per tree node.

    ``(root, level, path, method_key, line, cyclic, truncated)``; a caller already on its path is shown once more with ``cyclic`` set
    and not expanded.  A method with several ways up appears under each of them, so a tree grows with the number of
    ways: ``depth`` ends it (None: only cycles do), ``per_node`` keeps the first callers by key, and ``truncated`` marks nodes that have
    callers which are not shown.  ``caller_dag`` has everything without limits.
    """
    table = stored_edges(call_sites, method_edges, METHOD_ENDS)
    key = S.method_key(F.col("owner"), F.col("name"), F.col("desc"))
    level = cut_lineage(roots.select(
        "archive_id", key.alias("root"), F.lit(0).alias("level"), F.array(key).alias("path"),
        key.alias("method_key"), F.lit(0).alias("line"), F.lit(False).alias("cyclic"),
    ).distinct())
    levels = []
    by = ["archive_id", "root", "path"]
    for i in count():
        frontier = level.filter(~F.col("cyclic")).select(*by, F.col("method_key").alias("node"))
        buckets = table.touched(frontier)
        last = not buckets or (depth is not None and i >= depth)
        edges = table.around(frontier, "IN", buckets)
        if last:
            cut = edges.select(*by).distinct().withColumn("cut", F.lit(True))
        else:
            edges = cut_lineage(_first_callers(edges, by, per_node))
            cut = edges.filter("cut").select(*by, "cut").distinct()
        levels.append(level.join(cut, by, "left").withColumn("truncated", F.coalesce("cut", F.lit(False))).drop("cut"))
        if last:
            break
        level = cut_lineage(
            edges.select(
                "archive_id", "root", F.lit(i + 1).alias("level"), F.array_append("path", F.col("src")).alias("path"),
                F.col("src").alias("method_key"), "line", F.array_contains("path", F.col("src")).alias("cyclic"),
            )
        )
    return reduce(DataFrame.unionByName, levels)


def degrees(call_sites: DataFrame) -> DataFrame:
    """Callers and callees of every method, counted in sites."""
    calls = method_calls(call_sites)
    outs = calls.groupBy(
        "archive_id", F.col("in_class").alias("owner"), F.col("in_method").alias("name"), F.col("in_desc").alias("desc")
    ).agg(F.count("*").alias("callees"))
    ins = calls.groupBy(
        "archive_id",
        F.col("target_owner").alias("owner"),
        F.col("target_name").alias("name"),
        F.col("target_desc").alias("desc"),
    ).agg(F.count("*").alias("callers"))
    key = ["archive_id", "owner", "name", "desc"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return outs.join(ins, key, "full").select(*key, zero("callers"), zero("callees"))


def call_tree_children(
    call_sites: DataFrame | Adjacency, methods: DataFrame, direction: str = "OUT", level: int = 0, max_depth: int | None = None
) -> DataFrame:
    """Children of ``methods(archive_id, owner, name, desc)`` in the call tree.

    Sites with the same other end merge into one row with their number and first line.  The callers and callees of the
    child itself are counted, from its own edges only, unless it ends the branch: where it is its own parent, or
    where the caller sets ``max_depth`` and ``level`` is the last one above it.
    """
    table = stored_edges(call_sites, method_edges, METHOD_ENDS)
    near, far = NEAR[direction], FAR[direction]
    key = S.method_key(F.col("owner"), F.col("name"), F.col("desc"))
    asked = cut_lineage(methods.select("archive_id", *MEMBER, key.alias("node")).distinct())
    merged = cut_lineage(
        table.around(asked, direction).select(
            "archive_id", *MEMBER, *[F.col(f"{far}_{k}").alias(f"child_{k}") for k in MEMBER], F.col("n").alias("sites"),
            F.col("line").alias("first_line"), F.col(far).alias("child"),
            (F.col(near) == F.col(far)).alias("own") if max_depth is None or level + 1 < max_depth else F.lit(True).alias("own"),
        )
    )
    children = cut_lineage(merged.filter("not own").select("archive_id", F.col("child").alias("node")).distinct())
    buckets = table.touched(children)
    total = lambda way, name: table.around(children, way, buckets).groupBy("archive_id", F.col("node").alias("child")).agg(F.sum("n").alias(name))
    shown = lambda c: F.when(F.col("own"), 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(f"child_{c}")
    return (
        merged.join(total("IN", "callers"), ["archive_id", "child"], "left")
        .join(total("OUT", "callees"), ["archive_id", "child"], "left")
        .select(
            "archive_id", *MEMBER, *[f"child_{k}" for k in MEMBER], "sites", "first_line", F.col("own").alias("terminal"),
            shown("callers"), shown("callees"),
        )
    )
