"""Archives that hold a class name several times, and tables of several mappings."""

from pyspark.sql import functions as F

from codelode.operators import decrypt, mappings, rewrite, search, usage
from test_operators import code

TWINS = {"one": "x/A.class", "two": "META-INF/versions/9/A.class"}


def two(spark, first, second):
    """One method of two classes with the same name."""
    bodies = [code(spark, *rows).withColumn("class_id", F.lit(i)) for rows, i in ((first, TWINS["one"]), (second, TWINS["two"]))]
    return bodies[0].unionByName(bodies[1])


def members(spark, name, access=8, **values):
    rows = [("a", "A", i, name, "()I", access, *values.get(k, values.get("all", ()))) for k, i in TWINS.items()]
    extra = ", const_kind string, const_str string, const_long bigint, const_double double" if values else ""
    return spark.createDataFrame(rows, "archive_id string, owner string, class_id string, name string, desc string, access int" + extra)


def test_lines_of_twins_do_not_mix(spark, rows):
    call = {"opcode": 184, "ref_owner": "B", "ref_name": "f", "ref_desc": "()V"}
    insns = two(spark, [{"opcode": -1, "pseudo_kind": "LINE", "line": 7}, {"opcode": 0}, call], [{"opcode": 0}, {"opcode": 0}, call])
    classes = spark.createDataFrame([("a", i, "A", "S") for i in TWINS.values()], "archive_id string, class_id string, internal_name string, super_name string")
    sites = usage.build_call_sites(insns, classes.withColumn("interfaces", F.array().cast("array<string>")))
    assert rows(sites.where("target_owner = 'B'").select("class_id", "line")) == [(TWINS["two"], 0), (TWINS["one"], 7)]


def test_inlining_keeps_each_row_once(spark, rows):
    read = {"opcode": 178, "ref_owner": "A", "ref_name": "F", "ref_desc": "()I"}
    insns = two(spark, [read], [read, {"opcode": 0}])
    fields = members(spark, "F", 24, one=("int", None, 1, None), two=("int", None, 2, None))
    out, counts = rewrite.inline_static_values(insns, fields)
    assert out.count() == 3 and counts.first()["n"] == 2
    assert {r.const_long for r in out.where("opcode >= 2").collect()} == {2}  # first by path
    classes = spark.createDataFrame([("a", "A", TWINS["one"], 0), ("a", "A", TWINS["two"], 9)], "archive_id string, internal_name string, class_id string, runtime_version int")
    out, _ = rewrite.inline_static_values(insns, fields, classes)
    assert {r.const_long for r in out.where("opcode >= 2").collect()} == {1}  # the one for every version


def test_constant_methods_belong_to_their_class(spark, rows):
    get = lambda n: code(spark, {"opcode": 16, "const_kind": "int", "const_long": n}, {"opcode": 172}, method="g").withColumn("desc", F.lit("()I"))
    call = code(spark, {"opcode": 184, "ref_owner": "A", "ref_name": "g", "ref_desc": "()I"})
    insns = None
    for n, i in enumerate(TWINS.values()):
        part = get(n + 20).unionByName(call).withColumn("class_id", F.lit(i))
        insns = part if insns is None else insns.unionByName(part)
    out, counts = rewrite.inline_call_results(insns, members(spark, "g"))
    assert counts.first()["n"] == 2 and out.count() == 6
    assert rows(out.where("method = 'm'").select("class_id", "const_long")) == [(TWINS["two"], 21), (TWINS["one"], 20)]


def test_dead_code_and_opaque_branches_of_twins(spark):
    dead = [{"opcode": 3}, {"opcode": 177}, {"opcode": 0}]
    insns = two(spark, dead, dead[:2])
    none = spark.createDataFrame([], "archive_id string, class_id string, owner string, method string, desc string, start_label int, end_label int, handler_label int")
    assert rewrite.remove_dead_code(insns, none)[1].first()["n"] == 1
    assert rewrite.strip_after_terminators(insns, none)[0].where("opcode = 0").count() == 0
    jump = [{"opcode": 3}, {"opcode": 153, "jump_targets": [5]}, {"opcode": -1, "pseudo_kind": "LABEL", "label": 5}]
    out, counts = rewrite.simplify_opaque_predicates(two(spark, jump, [{"opcode": 21}, *jump[1:]]))
    assert counts.first()["n"] == 1 and out.where("opcode = 153").count() == 1


def test_enrichment_counts_the_defining_class(spark, rows):
    classes = spark.createDataFrame([("a", "A", TWINS["one"], 0, 1), ("a", "A", TWINS["two"], 9, 2)], "archive_id string, internal_name string, class_id string, runtime_version int, access int")
    nodes = spark.createDataFrame([("a", "A"), ("a", "Out")], "archive_id string, internal_name string")
    methods = members(spark, "g").unionByName(members(spark, "h").where(F.col("class_id") == TWINS["two"]))
    assert rows(usage.enrich_classes(nodes, classes, methods, methods.limit(0))) == [("a", "A", 1, 1, 0), ("a", "Out", 0, 0, 0)]


def test_names_are_found_once(spark):
    classes = spark.createDataFrame([("a", "A", "pack.Alpha", TWINS["one"], 0), ("a", "A", "pack.Alpha", TWINS["two"], 9)], "archive_id string, internal_name string, name string, class_id string, runtime_version int")
    found = members(spark, "lphaget").withColumn("ordinal", F.lit(0))
    hits = search.search_names(classes, found, found.limit(0), search.Search("lpha"))
    assert sorted(r.kind for r in hits.collect()) == ["CLASS_METHOD", "CLASS_NAME"]


def test_illegal_names_are_numbered_alike_on_every_run(spark, rows):
    classes = spark.createDataFrame([("a", "p/1x", i, 1) for i in TWINS.values()] + [("a", "p/2y", "p/2y.class", 1)], "archive_id string, internal_name string, class_id string, access int")
    none = members(spark, "fine").withColumn("ordinal", F.lit(0))
    mapping, _ = rewrite.illegal_name_mapping(classes, none, none.limit(0))
    assert rows(mapping.select("owner", "target")) == [("p/1x", "p/C_1"), ("p/2y", "p/C_2")] or rows(mapping.select("owner", "target")) == [("p/1x", "p/C_0"), ("p/2y", "p/C_1")]


def test_mappings_of_one_table_do_not_meet(spark, rows):
    schema = "mapping_id string, kind string, owner string, name string, desc string, target string"
    first = spark.createDataFrame([("1", "class", "a", "", "", "B"), ("2", "class", "a", "", "", "C"), ("1", "field", "a", "f", "I", "g")], schema)
    second = spark.createDataFrame([("1", "class", "B", "", "", "X"), ("2", "class", "B", "", "", "Y"), ("1", "field", "B", "g", "I", "h")], schema)
    got = rows(mappings.compose(first, second, by=("mapping_id",)).select("mapping_id", "kind", "owner", "target"))
    assert got == [("1", "class", "a", "X"), ("1", "field", "a", "h"), ("2", "class", "B", "Y"), ("2", "class", "a", "C")]
    changes = mappings.mapping_diff(first, second.withColumn("owner", F.lit("a")), by=("mapping_id",))
    assert rows(changes.select("mapping_id", "kind", "change")) == [("1", "class", "RENAMED"), ("1", "field", "REMOVED"), ("1", "field", "ADDED")] or changes.count() == 4


def test_interfaces_keep_to_their_row(spark, rows):
    mapping = spark.createDataFrame([("class", "i/A", "", "", "n/A")], "kind string, owner string, name string, desc string, target string")
    classes = spark.createDataFrame([("a", "K", ["i/A", "i/B"]), ("a", "K", ["i/B", "i/A"]), ("a", "K", []), ("a", "K", None)], "archive_id string, internal_name string, interfaces array<string>")
    out = mappings.Renamer(mapping).class_array(classes, "interfaces", ["archive_id", "internal_name"])
    assert sorted(map(str, (r.interfaces for r in out.collect()))) == sorted(map(str, [["n/A", "i/B"], ["i/B", "n/A"], [], None]))
