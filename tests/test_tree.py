"""Archive trees in their order, archives without classes, and snapshots parsed by section."""

from pyspark.sql import functions as F

from codelode.operators import detect, rollups
from codelode.streaming import jvmstate


def test_tree_in_order(spark):
    classes = spark.createDataFrame(
        [("a", "b.c", "Zed", 0), ("a", "b.c", "alpha", 0), ("a", "", "Main", 0), ("a", "b", "Bee", 0), ("a", "b.c", "Zed", 9), ("a", "b.c", "Zed", 11), ("b", "", "Only", 0)],
        "archive_id string, package_name string, simple_name string, runtime_version int",
    )
    resources = spark.createDataFrame([("a", "META-INF/x/y.txt"), ("a", "top.txt"), ("c", "z.bin")], "archive_id string, path string")
    tree = rollups.archive_tree(classes, resources).orderBy("archive_id", "position").collect()
    shown = {}
    for r in tree:
        shown.setdefault(r.archive_id, []).append("  " * r.depth + r.label)
    assert shown == {
        "a": [
            "b", "  c", "    alpha", "    Zed", "  Bee", "resources", "  META-INF", "    x", "      y.txt", "  top.txt", "Main",
            "[Multi-Release]", "  Java 11", "    b", "      c", "        Zed", "  Java 9", "    b", "      c", "        Zed",
        ],
        "b": ["Only"], "c": ["resources", "  z.bin"],
    }
    assert [r.position for r in tree if r.archive_id == "a"] == list(range(20))
    assert {r.kind for r in tree if r.label == "Java 9"} == {"MULTI_RELEASE_VERSION"}


def test_archives_without_classes_are_told_apart(spark, rows):
    found = spark.createDataFrame(
        [("a", 0, "X", 0.4, "MEDIUM", [("why", 1.0)]), ("a", 1, "Y", 0.0, "NONE", []), ("b", 0, "X", 0.0, "NONE", []), ("c", 0, "X", 0.9, "HIGH", [("files", 1.0)])],
        "archive_id string, position int, name string, confidence double, level string, evidence array<struct<description:string,weight:double>>",
    )
    features = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "archive_id string, class_count long")
    assert rows(detect.top_detection(found, features).select("archive_id", "name", "confidence")) == [("a", "X", 0.4), ("b", "None / Unknown", 0.0), ("c", "None", 0.0)]
    assert rows(detect.undetected(found)) == [("a", 1, "Y"), ("b", 0, "X")]


def test_snapshots_are_parsed_by_section(spark, rows):
    docs = ['{"memory": {"heap": {"used": 3145728}}, "threads": {"threadCount": 4, "list": "odd"}, "gc": [{"name": "G1"}]}', '{"memory": ', "[1]"]
    polls = spark.createDataFrame([(1, i, d) for i, d in enumerate(docs)], "pid long, tick long, json string")
    part = jvmstate.parse_snapshots(polls, jvmstate.SAMPLED)
    assert rows(jvmstate.samples(jvmstate.valid_snapshots(part))) == [(1, 0, "heap_mb", 3.0), (1, 0, "threads", 4.0)]
    assert jvmstate.corrupt_snapshots(part).count() == 2
    assert jvmstate.valid_snapshots(jvmstate.parse_snapshots(polls)).count() == 0  # the list is no list
    names = jvmstate.parse_snapshots(polls, ["gc"]).schema["s"].dataType.names
    assert names == ["gc"]
    assert "threadCount" not in jvmstate.parse_snapshots(polls, ["gc"]).select(F.col("s"))._jdf.queryExecution().toString()
