from pyspark.sql import functions as F

from codelode.operators import diffs as D
from codelode.operators import graph as G
from codelode.operators import hierarchy as H
from codelode.operators import mappings as M
from codelode.operators import patterns as P
from codelode.operators import rewrite as Z
from codelode.operators import search as X
from codelode.operators import usage as U
from codelode.operators.ordered import carry_forward, number_rows

SITE = "archive_id string, in_class string, in_method string, in_desc string, kind string, target_owner string, target_name string, target_desc string, line int, site_idx bigint"
INSN = "archive_id string, owner string, method string, desc string, idx int, opcode int, pseudo_kind string, line int, label int, jump_targets array<int>, ref_owner string, ref_name string, ref_desc string, const_kind string, const_str string, const_long bigint, const_double double, bsm_strings array<string>, mnemonic string"
CLASS = "archive_id string, internal_name string, super_name string, interfaces array<string>, access int"


def calls(spark, *edges):
    return spark.createDataFrame(
        [("a", s, "m", "()V", "INVOKE_VIRTUAL", d, "m", "()V", i, i) for i, (s, d) in enumerate(edges)], SITE
    )


def code(spark, *rows, owner="A", method="m"):
    """Rows of one method: dictionaries over the instruction columns."""
    names = [c.split()[0] for c in INSN.split(", ")]
    base = dict.fromkeys(names)
    full = [{**base, "archive_id": "a", "owner": owner, "method": method, "desc": "()V", "idx": i, "jump_targets": [], **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], INSN)


def test_call_sites_and_usages(spark, rows):
    insns = code(
        spark,
        {"opcode": -1, "pseudo_kind": "LINE", "line": 7},
        {"opcode": 182, "ref_owner": "com/x/Callee", "ref_name": "bark", "ref_desc": "()V"},
        {"opcode": 178, "ref_owner": "com/x/Config", "ref_name": "DEBUG", "ref_desc": "Z"},
        {"opcode": 187, "ref_owner": "com/x/Target"},
        {"opcode": 186, "ref_name": "dyn", "ref_desc": "()V"},
    )
    classes = spark.createDataFrame([("a", "A", "S", ["I"], 1)], CLASS)
    sites = U.build_call_sites(insns, classes)
    assert sites.count() == 5
    found = U.usages_of_member(sites, "com/x/Callee", "bark", "()V").first()
    assert (found["in_class"], found["line"]) == ("A", 7)
    assert U.usages_of_member(sites, "com/x/Config", "DEBUG", "Z").first()["kind"] == "GETSTATIC"
    assert U.usages_of_class(sites, "com/x/Target").first()["kind"] == "NEW"
    assert rows(sites.filter("in_method = '<class>'").select("target_owner", "line")) == [("I", 0), ("S", 0)]


def test_recursive_callers(spark, rows):
    root = spark.createDataFrame([("a", "t", "m", "()V")], "archive_id string, owner string, name string, desc string")
    chain = calls(spark, ("a", "b"), ("b", "t"))
    tree = G.recursive_callers(chain, root)
    assert rows(tree.select("level", "method_key")) == [(0, "t#m()V"), (1, "b#m()V"), (2, "a#m()V")]
    cycle = G.recursive_callers(calls(spark, ("b", "t"), ("t", "b")), root)
    assert rows(cycle.select("level", "method_key", "cyclic")) == [(0, "t#m()V", False), (1, "b#m()V", False), (2, "t#m()V", True)]
    capped = G.recursive_callers(calls(spark, ("a", "b"), ("b", "t"), ("c", "a"), ("d", "t")), root, depth=2, per_node=1)
    assert rows(capped.select("level", "method_key")) == [(0, "t#m()V"), (1, "b#m()V"), (2, "a#m()V")]


def test_graph_weights(spark, rows):
    sites = calls(spark, ("A", "B"), ("A", "B"), ("B", "C"), ("C", "D"), ("A", "A"))
    root = spark.createDataFrame([("a", "C:A")], "archive_id string, node string")
    edges = lambda way, depth: rows(G.call_graph(sites, root, "CLASS", way, depth)[1].drop("archive_id"))
    assert edges("OUT", 1) == [("C:A", "C:B", 2)]
    assert edges("OUT", 3) == [("C:A", "C:B", 2), ("C:B", "C:C", 1), ("C:C", "C:D", 1)]
    # Both ends of A-B are expanded: its two sites count from either side.
    assert edges("BOTH", 2) == [("C:A", "C:B", 4), ("C:B", "C:C", 1)]


def test_hierarchy(spark, rows):
    classes = spark.createDataFrame(
        [("a", "B", "A", [], 1), ("a", "A", "java/lang/Object", ["I"], 1), ("a", "C", "B", ["I"], 1), ("a", "L", "L2", [], 1), ("a", "L2", "L", [], 1)], CLASS
    )
    seeds = classes.select("archive_id", "internal_name")
    chains = H.ancestor_chains(seeds, classes)
    assert rows(chains.filter("start = 'C'").select("level", "node")) == [(0, "java/lang/Object"), (1, "A"), (2, "B"), (3, "C")]
    assert rows(chains.filter("start = 'L'").select("level", "node")) == [(0, "L2"), (1, "L")]
    edges = H.hierarchy_edges(classes)
    root = spark.createDataFrame([("a", "I")], "archive_id string, internal_name string")
    tree = H.subtype_tree(root, edges).select("parent", "node", F.concat_ws(">", "path"), "expanded")
    assert rows(tree) == sorted(
        [(None, "I", "I", True), ("I", "A", "I>A", True), ("A", "B", "I>A>B", True), ("B", "C", "I>A>B>C", True), ("I", "C", "I>C", False)], key=repr
    )
    methods = spark.createDataFrame(
        [("a", "B", "run", "()V", 1), ("a", "C", "run", "()V", 8), ("a", "A", "run", "()V", 1)], "archive_id string, owner string, name string, desc string, access int"
    )
    target = spark.createDataFrame([("a", "I", "run", "()V"), ("a", "I", "<init>", "()V")], "archive_id string, declaring string, name string, desc string")
    assert rows(H.overriders(target, edges, methods).select("internal_name")) == [("A",), ("B",)]


MAP = "kind string, owner string, name string, desc string, target string"


def test_mapping_algebra(spark, rows):
    base = spark.createDataFrame([("class", "a", "", "", "Foo"), ("field", "a", "x", "I", "x1"), ("method", "a", "m", "()V", "go")], MAP)
    upd = spark.createDataFrame([("class", "a", "", "", "Foo"), ("field", "a", "x", "I", "x2"), ("field", "a", "y", "I", "y1")], MAP)
    counts = M.mapping_diff_counts(M.mapping_diff(base, upd)).first()
    assert (counts["field_renamed"], counts["field_added"], counts["method_removed"], counts["total_changes"]) == (1, 1, 1, 3)
    first = spark.createDataFrame([("class", "a", "", "", "Foo"), ("field", "a", "x", "I", "renamedX")], MAP)
    second = spark.createDataFrame(
        [("class", "Foo", "", "", "CleanFoo"), ("field", "Foo", "renamedX", "I", "finalX"), ("class", "z", "", "", "Z"), ("class", "a", "", "", "No")], MAP
    )
    assert rows(M.compose(first, second)) == [("class", "a", "", "", "CleanFoo"), ("class", "z", "", "", "Z"), ("field", "a", "x", "I", "finalX")]
    double = spark.createDataFrame([("class", "a", "", "", "Foo"), ("class", "b", "", "", "Foo"), ("class", "c", "", "", "Bar"), ("field", "c", "p", "I", "pub")], MAP)
    assert rows(M.invert(double)) == [("class", "Bar", "", "", "c"), ("field", "c", "pub", "I", "p")]


def test_diffs(spark, rows):
    schema = "archive_id string, name string, runtime_version int, access int, super_name string, interfaces array<string>, major int, bytes binary, ordinal bigint"
    cls = lambda n, b, acc=1, o=0: ("a", n, 0, acc, "S", ["I"], 52, b, o)
    left = spark.createDataFrame([cls("Gone", b"1"), cls("Same", b"1"), cls("Mod", b"1"), cls("Dup", b"old", o=0), cls("Dup", b"new", o=1)], schema)
    right = spark.createDataFrame([cls("New", b"1"), cls("Same", b"1"), cls("Mod", b"2", 17), cls("Dup", b"new")], schema)
    got = rows(D.class_diff(left, right).select("name", "change", F.concat_ws(";", "header_changes")))
    assert got == [("Dup", "UNCHANGED", ""), ("Gone", "REMOVED", ""), ("Mod", "MODIFIED", "access: 1 -> 17"), ("New", "ADDED", ""), ("Same", "UNCHANGED", "")]
    # An edit of operands alone leaves the method unchanged inside its modified class.
    methods = spark.createDataFrame([("a", "A", "m", "()V", 1)], "archive_id string, owner string, name string, desc string, access int")
    one, two = ({"opcode": 16, "const_long": v} for v in (1, 2))
    modified = spark.createDataFrame([("a", "A")], "archive_id string, owner string")
    change = lambda a, b: D.method_diff((methods, code(spark, a)), (methods, code(spark, b)), modified).first()["change"]
    assert change(one, two) == "UNCHANGED" and change({"opcode": 4}, {"opcode": 5}) == "MODIFIED"


def corpus(spark):
    insns = code(
        spark, {"opcode": 18, "const_kind": "string", "const_str": "secret"}, {"opcode": 184, "ref_owner": "java/lang/System", "ref_name": "exit", "ref_desc": "(I)V"}
    )
    classes = spark.createDataFrame([("a", "A", "S", ["I"], 1, 1, 0), ("a", "Empty", "S", [], 1, 0, 0)], CLASS + ", method_count int, field_count int")
    methods = spark.createDataFrame([("a", "A", "m", "()V", 9, 2, 0)], "archive_id string, owner string, name string, desc string, access int, real_count int, jump_label_count int")
    fields = spark.createDataFrame([], "archive_id string, owner string, name string, desc string, access int")
    return P.Corpus(classes, methods, fields, insns)


def test_patterns(spark):
    c = corpus(spark)
    names = lambda target, *preds: sorted(r["class_name"] for r in P.evaluate(c, target, *preds).collect())
    assert names("method", P.contains(P.ldc("secret"))) == ["A"]
    assert names("method", P.contains(P.invoke("java.lang.System", "exit")) | P.name("nothing")) == ["A"]
    assert names("class", P.any_of("method", P.access("static"))) == ["A"]
    assert names("class", P.all_of("method", P.access("static"))) == ["A"]
    assert names("class", P.none_of("method", P.access("static"))) == ["Empty"]
    assert names("class", P.contains(P.ldc("secret"))) == [] and names("class", ~P.contains(P.ldc("x"))) == ["A", "Empty"]
    assert names("method", P.count("instructions", ">", 1), P.access("nonsense")) == []


def test_searches(spark, rows):
    strings = spark.createDataFrame([("a", "p.A", 1, "Hello"), ("a", "q.B", 2, "hello x")], "archive_id string, class_name string, ordinal int, value string")
    lines = spark.createDataFrame([("a", "r.txt", 3, "say hello")], "archive_id string, path string, line_no int, text string")
    hits = lambda q, fn=X.search_strings: [(r["path"], r["start"]) for r in sorted(fn(strings, lines, q).collect(), key=lambda r: r["path"])]
    assert hits(X.Search("hello", excluded=["q"])) == [("p.A", 0), ("r.txt", 4)]
    assert hits(X.Search("  ")) == []
    assert hits(X.Search("h(", case_sensitive=True), X.search_regex) == []
    assert hits(X.Search("h.l+o x"), X.search_regex) == [("q.B", 0)]
    numbers = code(spark, {"opcode": 4, "const_kind": "int", "const_long": 1}, {"opcode": 18, "const_kind": "double", "const_double": 1.0})
    assert X.search_numbers(numbers, X.Search("0x100000001")).count() == 1
    assert X.search_numbers(numbers, X.Search("1")).count() == 2 and X.search_numbers(numbers, X.Search("1x")).count() == 0


def test_opaque_predicate_cascade(spark):
    """A dropped pair brings a literal before the next jump; a label between literal and jump is what goes."""
    insns = code(spark, {"opcode": 4}, {"opcode": 3}, {"opcode": 154}, {"opcode": 154}, {"opcode": 177})
    out, counts = Z.simplify_opaque_predicates(insns)
    assert [r["opcode"] for r in out.orderBy("idx").collect()] == [167, 177]
    assert {r["counter"]: r["n"] for r in counts.collect()} == {"branches-forced-taken": 1, "branches-dropped": 1}
    labelled = code(spark, {"opcode": 3}, {"opcode": -1, "pseudo_kind": "LABEL", "label": 1}, {"opcode": 154}, {"opcode": 153}, {"opcode": 177})
    out, _ = Z.simplify_opaque_predicates(labelled)
    assert [r["opcode"] for r in out.orderBy("idx").collect()] == [167, 177]
    same, none = Z.simplify_opaque_predicates(code(spark, {"opcode": 177}))
    assert same.count() == 1 and none.count() == 0


def test_dead_code(spark):
    handlers = spark.createDataFrame([], "archive_id string, owner string, method string, desc string, start_label int, end_label int, handler_label int")
    label = lambda n: {"opcode": -1, "pseudo_kind": "LABEL", "label": n}
    insns = code(spark, {"opcode": 167, "jump_targets": [9]}, {"opcode": 0}, {"opcode": 0}, label(9), {"opcode": 177})
    out, counts = Z.remove_dead_code(insns, handlers)
    assert [r["idx"] for r in out.orderBy("idx").collect()] == [0, 3, 4] and counts.first()["n"] == 2
    falls_off = code(spark, {"opcode": 167, "jump_targets": [9]}, {"opcode": 0}, label(9), {"opcode": 0})
    assert Z.remove_dead_code(falls_off, handlers)[0].count() == 4


def test_dead_code_behind_back_jumps_takes_no_rounds(spark):
    """Thirty runs that are entered last to first, one that nothing enters, and handlers within the code they cover."""
    label = lambda n: {"opcode": -1, "pseudo_kind": "LABEL", "label": n}
    jump = lambda n: {"opcode": 167, "jump_targets": [n]}
    rows = [jump(29), {"opcode": 0}, label(0), {"opcode": 177}]
    for n in range(1, 30):
        rows += [label(n), jump(n - 1)]
    kind = "archive_id string, owner string, method string, desc string, start_label int, end_label int, handler_label int"
    handlers = lambda *spans: spark.createDataFrame([("a", "A", "m", "()V", *s) for s in spans], kind)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("dead", "dead")
    out, counts = Z.remove_dead_code(code(spark, *rows), handlers())
    assert sorted(r["idx"] for r in out.collect()) == [i for i in range(len(rows)) if i != 1]
    assert len(tracker.getJobIdsForGroup("dead")) < 15
    spark.sparkContext.setJobGroup("rest", "rest")
    assert counts.first()["n"] == 1
    caught = code(spark, label(1), {"opcode": 177}, label(2), {"opcode": 0}, {"opcode": 177}, {"opcode": 1})
    left = lambda *spans: sorted(r["idx"] for r in Z.remove_dead_code(caught, handlers(*spans))[0].collect())
    assert left((1, 2, 2)) == [0, 1, 2, 3, 4] and left((2, None, 2)) == [0, 1, 2] and left((1, 1, 2)) == [0, 1, 2]
    assert left((1, 2, 9)) == left((9, 2, 2)) == [0, 1, 2, 3, 4, 5] and left((2, 2, 1), (1, None, 2)) == [0, 1, 2, 3, 4]


def test_methods_are_dealt_by_rows(spark, monkeypatch):
    """Tasks grow in number with the rows; a method stays whole."""
    from codelode import session

    monkeypatch.setattr(session, "TASK_ROWS", 50)
    rows = session.dealt(spark.range(2000).selectExpr("id % 400 AS method", "id"), "method")
    assert rows.rdd.getNumPartitions() == 40
    homes = rows.select("method", F.spark_partition_id().alias("p")).distinct()
    assert homes.count() == 400
    insns = code(spark, {"opcode": 4}, {"opcode": 153}, {"opcode": 177})
    for _ in range(6):
        insns = insns.unionByName(insns.withColumn("method", F.concat("method", F.lit("x"))))
    out, counts = Z.simplify_opaque_predicates(insns.withColumn("method", F.concat("method", F.length("method").cast("string"))).distinct())
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString() and counts.first()["counter"] == "branches-dropped"


def test_ordered_helpers(spark):
    data = [("k", i, "v%d" % i if i % 7 == 0 else None) for i in range(100)]
    frame = spark.createDataFrame(data, "k string, i bigint, v string")
    got = carry_forward(frame, ["k"], "i", {"c": F.col("v")}, block=10).orderBy("i").collect()
    assert [r["c"] for r in got] == ["v%d" % (i // 7 * 7) for i in range(100)]
    strict = carry_forward(frame, ["k"], "i", {"c": F.col("v")}, block=10, inclusive=False).orderBy("i").collect()
    assert [r["c"] for r in strict] == [None] + ["v%d" % ((i - 1) // 7 * 7) for i in range(1, 100)]
    numbered = number_rows(frame.withColumn("g", F.lit("x")), ["g"], ["i"], "n").orderBy("i").collect()
    assert [r["n"] for r in numbered] == list(range(100))


def test_a_self_typed_companion_field_ends_as_instance(spark):
    from codelode.operators import rewrite as Z

    owner = "X$Companion"
    marks = spark.createDataFrame([("a", owner, "class", Z.KOTLIN, True)], "archive_id string, owner string, target_kind string, desc string, visible boolean")
    fields = spark.createDataFrame([("a", owner, 0, "q", f"L{owner};", 0x18)], "archive_id string, owner string, ordinal int, name string, desc string, access int")
    renames, counts = Z.kotlin_singletons(marks, fields)
    assert [(r.old_name, r.new_name) for r in renames.collect()] == [("q", "INSTANCE")]
    assert {r["counter"]: r.n for r in counts.collect()} == {
        "kotlin-classes-seen": 1, "companion-fields-restored": 1, "instance-fields-restored": 1
    }


def test_files_reach_python_in_batches_bounded_by_bytes(spark):
    from codelode.operators import bytestats
    from codelode.sources.archives import scan_archive_files

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    import pyarrow as pa

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    files = spark.range(0, 1000, 1, 1).select(F.encode(F.repeat(F.lit("x"), 20_000), "UTF-8").alias("content"))
    pairs = files.select(F.col("content").alias("left"), F.col("content").alias("right"))
    uses = [lambda: bytestats.entropy("content"), lambda: bytestats.byte_diff(pairs), lambda: bytestats.windowed_entropy(files),
            lambda: bytestats.find_bytes(files, b"x"), lambda: scan_archive_files(files.withColumn("archive_id", F.lit("a")))]
    try:
        for use in uses:
            spark.conf.set(name, "64m")
            use()
            assert files.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 300
        spark.conf.set(name, "1m")
        bytestats.entropy("content")
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)


def test_large_mappings_are_dealt_to_tasks_not_sent_to_each(spark, rows, monkeypatch):
    mapping = spark.createDataFrame(
        [("class", "A", "", "", "x/A"), ("class", "B", "", "", "x/B"), ("method", "B", "m", "()V", "run"), ("method", "A", "m", "()V", "go"), ("field", "B", "f", "", "g")],
        "kind string, owner string, name string, desc string, target string",
    )
    sites = calls(spark, ("A", "B"), ("B", "C"), ("C", "A"))
    names = lambda out: rows(out.select("in_class", "in_method", "target_owner", "target_name"))
    joins = lambda out: out._jdf.queryExecution().executedPlan().toString()
    small = M.Renamer(mapping).apply_call_sites(sites)
    monkeypatch.setattr(M, "TASK_ROWS", 2, raising=False)
    large = M.Renamer(mapping).apply_call_sites(sites)
    assert names(large) == names(small) == [("C", "m", "x/A", "go"), ("x/A", "go", "x/B", "run"), ("x/B", "run", "C", "m")]
    assert "ShuffledHashJoin" not in joins(small) and "ShuffledHashJoin" in joins(large) and "BroadcastHashJoin" not in joins(large)
