"""Stored adjacency, caller DAGs, strong components and superclass chains against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codelode.operators import graph as G
from codelode.operators import hierarchy as H
from codelode.operators import strong
from codelode.operators.adjacency import Adjacency
from codelode.operators.identity import definitions
from test_operators import calls

ROOT = "archive_id string, owner string, name string, desc string"


def reach(edges, start):
    seen, todo = {start}, [start]
    while todo:
        here = todo.pop()
        for a, b in edges:
            if a == here and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def plain_dag(edges, root):
    """(caller, callee) -> (level, cyclic) of everything that reaches root."""
    level, frontier, n = {root: 0}, [root], 0
    while frontier:
        n += 1
        found = {a for a, b in edges if b in frontier} - set(level)
        level.update(dict.fromkeys(found, n))
        frontier = found
    ahead = {v: reach(edges, v) for v in level}
    return {(a, b): (level[b] + 1, a == b or a in ahead[b]) for a, b in edges if b in level}


def table(spark, tmp_path, edges, **options):
    return Adjacency.build(G.method_edges(calls(spark, *edges)), str(tmp_path / "edges"), **options)


def test_stored_edges_are_read_in_part(spark, tmp_path, rows):
    edges = [(f"c{i}", f"c{i // 3}") for i in range(1, 300)]
    stored = table(spark, tmp_path, edges, bucket_edges=10)
    assert stored.buckets == 30
    again = Adjacency.open(spark, stored.path)
    assert again.buckets == 30 and again.edges.count() == 2 * len(edges)
    nodes = spark.createDataFrame([("a", "c5#m()V")], "archive_id string, node string")
    found = again.around(nodes, "IN")
    assert rows(found.select("src")) == [(f"c{i}#m()V",) for i in (15, 16, 17)]
    assert rows(again.around(nodes, "OUT").select("dst")) == [("c1#m()V",)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+", plan) or re.search(r"bucket#\d+ IN \(\d+\)", plan), plan
    assert "PartitionFilters" in plan and "HashAggregate" not in plan and "Checkpoint" not in plan


def test_edges_of_nothing(spark, tmp_path):
    stored = Adjacency.build(G.method_edges(calls(spark, ("a", "b")).limit(0)), str(tmp_path / "none"))
    root = spark.createDataFrame([("a", "t", "m", "()V")], ROOT)
    assert G.caller_dag(stored, root).count() == 0
    assert [r.truncated for r in G.recursive_callers(stored, root).collect()] == [False]


@pytest.mark.parametrize("seed,nodes,edges", [(1, 12, 20), (2, 30, 45), (3, 25, 25), (4, 9, 40)])
def test_strong_components(spark, rows, seed, nodes, edges):
    rnd = random.Random(seed)
    graphs = {g: sorted({(f"n{rnd.randrange(nodes)}", f"n{rnd.randrange(nodes)}") for _ in range(edges)}) for g in "xy"}
    df = spark.createDataFrame([(g, a, b) for g, pairs in graphs.items() for a, b in pairs], "g string, src string, dst string")
    got = {}
    for g, node, component in rows(strong.strong_components(df, ["g"])):
        got.setdefault((g, component), set()).add(node)
    want = set()
    for g, pairs in graphs.items():
        ahead = {v: reach(pairs, v) for e in pairs for v in e}
        want |= {(g, frozenset(w for w in ahead[v] if v in ahead[w])) for v in ahead}
    assert {(g, frozenset(v)) for (g, _), v in got.items()} == {(g, v) for g, v in want if len(v) > 1}


def test_caller_dag_without_limits(spark, tmp_path):
    rnd = random.Random(7)
    hub = [(f"h{i}", "t") for i in range(70)]
    chain = [(f"d{i + 1}", f"d{i}") for i in range(7)] + [("d0", "h3"), ("d3", "d5"), ("t", "h5"), ("h9", "h9")]
    loose = [(f"h{rnd.randrange(70)}", f"h{rnd.randrange(70)}") for _ in range(8)] + [("z1", "z2")]
    edges = sorted(set(hub + chain + loose))
    root = spark.createDataFrame([("a", "t", "m", "()V")], ROOT)
    dag = G.caller_dag(table(spark, tmp_path, edges, bucket_edges=40), root)
    name = lambda key: key.split("#")[0]
    got = {(name(r.caller), name(r.callee)): (r.level, r.cyclic) for r in dag.collect()}
    assert got == plain_dag(edges, "t")
    assert dag.where("truncated").count() == 0 and dag.where("level > 5").count() > 2


def test_a_deep_dag_takes_few_jobs(spark, tmp_path, monkeypatch):
    steps = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: steps.append(1) or cut(df))
    edges = [(f"d{i + 1}", f"d{i}") for i in range(25)] + [("d3", "d20"), ("d7", "d7"), ("out", "else")]
    root = spark.createDataFrame([("a", "d0", "m", "()V")], ROOT)
    dag = G.caller_dag(table(spark, tmp_path, edges), root)
    name = lambda key: key.split("#")[0]
    assert {(name(r.caller), name(r.callee)): (r.level, r.cyclic) for r in dag.collect()} == plain_dag(edges, "d0")
    assert len(steps) <= 2


def test_one_task_and_rounds_of_joins_find_the_same_dag(spark, rows, monkeypatch):
    rnd = random.Random(11)
    pairs = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(36)}
    sites = calls(spark, *sorted(pairs | {("n10", "n3"), ("n11", "n7"), ("n3", "n12")}))
    sites = sites.unionByName(sites.where("in_class < 'n2'").withColumn("archive_id", F.lit("b")))
    sites = sites.unionByName(sites.where("in_class < 'n15'").withColumn("archive_id", F.lit(None).cast("string")))
    named = [("a", "n3"), ("a", "n3"), ("a", "n7"), ("b", "n3"), ("b", "nowhere"), (None, "n3"), ("a", None)]
    root = spark.createDataFrame([(a, o, "m", "()V") for a, o in named], ROOT)
    one = G.caller_dag(sites, root)
    monkeypatch.setattr(G.walks, "TASK_EDGES", -1)
    many = G.caller_dag(sites, root)
    assert one.dtypes == many.dtypes and rows(one) == rows(many)
    assert {(r.archive_id, r.root[:2]) for r in one.collect()} == {("a", "n3"), ("a", "n7"), ("b", "n3")}


def test_ids_that_clash_are_salted_anew(spark, monkeypatch):
    real = G.walks.node_id
    clash = lambda *name, salt: F.lit(1).cast("long") if salt < 2 else real(*name, salt=salt)
    monkeypatch.setattr(G.walks, "node_id", clash)
    root = spark.createDataFrame([("a", "t", "m", "()V")], ROOT)
    dag = G.caller_dag(calls(spark, ("x", "t"), ("y", "x"), ("z", "w")), root)
    assert {(r.caller[0], r.callee[0]): (r.level, r.cyclic) for r in dag.collect()} == {("x", "t"): (1, False), ("y", "x"): (2, False)}


def test_caller_dag_says_where_it_was_cut(spark):
    root = spark.createDataFrame([("a", "t", "m", "()V")], ROOT)
    edges = [("a", "t"), ("b", "t"), ("c", "t"), ("d", "a"), ("e", "d"), ("f", "b")]
    cut = G.caller_dag(calls(spark, *edges), root, depth=2, per_node=2)
    told = {(r.caller[0], r.callee[0]): r.truncated for r in cut.collect()}
    assert told == {("a", "t"): True, ("b", "t"): True, ("d", "a"): True, ("f", "b"): False}
    tree = G.recursive_callers(calls(spark, *edges), root, depth=1, per_node=2)
    assert {(r.method_key[0], r.truncated) for r in tree.collect()} == {("t", True), ("a", True), ("b", True)}
    whole = G.recursive_callers(calls(spark, *edges), root, depth=None)
    assert whole.count() == 7 and whole.where("truncated").count() == 0


def test_superclass_chains_double(spark, rows, monkeypatch):
    rounds = []
    cut = H.cut_lineage
    monkeypatch.setattr(H, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    chain = [("a", f"k{i}", f"k{i + 1}", 0) for i in range(300)]
    circle = [("a", "x", "y", 0), ("a", "y", "z", 0), ("a", "z", "x", 0), ("a", "w", "x", 0), ("a", "self", "self", 0), ("b", "k0", None, 0)]
    classes = spark.createDataFrame(chain + circle, "archive_id string, internal_name string, super_name string, access int")
    seeds = classes.where("internal_name in ('k0', 'x', 'w', 'self', 'k299')").select("archive_id", "internal_name")
    got = rows(H.ancestor_chains(seeds, classes))
    want = [("a", "k0", 300 - i, f"k{i}") for i in range(301)] + [("a", "k299", 1, "k299"), ("a", "k299", 0, "k300"), ("b", "k0", 0, "k0")]
    want += [("a", "x", 2, "x"), ("a", "x", 1, "y"), ("a", "x", 0, "z"), ("a", "self", 0, "self")]
    want += [("a", "w", 3, "w"), ("a", "w", 2, "x"), ("a", "w", 1, "y"), ("a", "w", 0, "z")]
    assert got == sorted(want, key=repr)
    assert (len(rounds) - 2) / 2 <= 10


def test_names_with_several_classes_are_defined_once(spark, rows):
    classes = spark.createDataFrame(
        [("a", "K", "S", 9, "META-INF/versions/9/K.class", 1), ("a", "K", "T", 0, "x/K.class", 2), ("a", "K", "U", 0, "y/K.class", 4), ("b", "K", "V", 11, "v/K.class", 8)],
        "archive_id string, internal_name string, super_name string, runtime_version int, class_id string, access int",
    )
    assert rows(definitions(classes, "super_name", "access")) == [("a", "K", "T", 2), ("b", "K", "V", 8)]
    nodes = spark.createDataFrame([("a", "K"), ("b", "K"), ("a", "Out")], "archive_id string, internal_name string")
    assert H.with_class_kind(nodes, classes).count() == 3
    assert rows(H.ancestor_chains(nodes, classes).select("archive_id", "start", "node").where(F.col("node") != F.col("start"))) == [("a", "K", "T"), ("b", "K", "V")]


def test_ids_of_ends_are_not_stored_but_made(spark, tmp_path):
    edges = [("a/A", "b/B"), ("a/A", "b/B"), ("b/B", "c/C"), ("c/C", "a/A")]
    for kind, made in ((lambda s: G.call_edges(s, "CLASS"), G.call_ends("CLASS")), (lambda s: G.call_edges(s, "METHOD"), G.call_ends("METHOD")), (G.method_edges, G.METHOD_ENDS)):
        plain = kind(calls(spark, *edges))
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        lean = Adjacency.build(plain, path, made=made)
        assert not {"src", "dst"} & set(spark.read.parquet(f"{path}/buckets={lean.buckets}").columns)
        for table in (lean, Adjacency.open(spark, path, made)):
            for way, near in (("OUT", "src"), ("IN", "dst")):
                nodes = plain.select("archive_id", F.col(near).alias("node")).distinct()
                got = table.around(nodes, way).select(plain.columns)
                assert sorted(got.collect()) == sorted(plain.collect())
