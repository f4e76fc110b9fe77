"""Mapping files in pieces: large files by several tasks, many mappings in one job."""

import glob

import pytest
from pyspark.sql import functions as F

from codelode.sources import mapping_files as MF

SCHEMA = "mapping_id string, kind string, owner string, name string, desc string, target string"


def test_large_files_are_read_by_several_tasks(spark, tmp_path):
    texts = {
        "big.txt": "".join(f"line {i} of the big file\n" for i in range(5000)),
        "ends.txt": "a\r\nb\rc\n\n\nd", "empty.txt": "", "one.txt": "only",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        lines = MF.read_mapping_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 4
        got = {}
        for r in sorted(lines.collect(), key=lambda r: (r.mapping_id, r.line_no)):
            got.setdefault(r.mapping_id.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {name: list(enumerate(text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n"))) for name, text in texts.items() if text}
    assert got == want


@pytest.mark.parametrize("fmt", ["PROGUARD", "TINY_V2", "TSRG", "ENIGMA", "SRG"])
def test_many_mappings_keep_their_lines_in_order(spark, tmp_path, fmt):
    rows = []
    for m in ("one", "two", "three"):
        for i in range(40):
            rows += [(m, "class", f"a{i}", "", "", f"com/{m}/K{i}"), (m, "field", f"a{i}", "f", "I", f"x{i}"), (m, "method", f"a{i}", "g", "(I)V", f"y{i}")]
    mappings = spark.createDataFrame(rows, SCHEMA).repartition(7)
    MF.write_mappings(mappings, fmt, str(tmp_path / "out"))
    for m in ("one", "two", "three"):
        parts = sorted(glob.glob(str(tmp_path / "out" / f"mapping_id={m}" / "part-*")))
        got = "".join(open(p).read() for p in parts).splitlines()
        want = MF.mapping_lines(mappings.where(F.col("mapping_id") == m), fmt).orderBy(*MF.ORDER)
        assert got == [r.line for r in want.collect()]
        assert len(got) >= 120
        (tmp_path / f"{m}.txt").write_text("\n".join(got) + "\n")
    back = MF.read_mapping(spark, str(tmp_path / "*.txt"), fmt)
    assert back.count() == len(rows)


@pytest.mark.parametrize(
    "line,want",
    [
        ("com.Foo -> a:", ("class", "a", "", "", "com/Foo")),
        ("com.Foo$Bar->a.b:", ("class", "a/b", "", "", "com/Foo$Bar")),
        ("    int count -> f", ("field", "c", "f", "I", "count")),
        ("\tint[] xs->g", ("field", "c", "g", "[I", "xs")),
        ("    1:5:void run() -> r", ("method", "c", "r", "()V", "run")),
        ("    1:5:java.lang.String get(int,long[]):7:9 -> s", ("method", "c", "s", "(I[J)Ljava/lang/String;", "get")),
        ("    void <init>() -> <init>", ("method", "c", "<init>", "()V", "<init>")),
        ("com.Foo -> a", None), ("    int count - f", None), ("    count -> f", None), ("    int a b -> f", None), ("    int f( -> g", None),
    ],
)
def test_arrow_lines(spark, line, want):
    lines = spark.createDataFrame([("m", "PROGUARD", 0, "com.Cur -> c:"), ("m", "PROGUARD", 1, line)], "mapping_id string, format string, line_no long, line string")
    found = MF.parse_mapping_lines(lines, ["PROGUARD"]).where("target <> 'com/Cur'").collect()
    assert [(r.kind, r.owner, r.name, r.desc, r.target) for r in found] == ([want] if want else [])


def test_first_lines_are_found_without_sorting_lines(spark, rows, monkeypatch):
    lines = [("a", 0, " # note"), ("a", 1, "// x"), ("a", 2, "CL: a b"), ("a", 3, "FD: a/f I b/g I"), ("b", 5, "tiny\t2\t0\ta\tb"), ("b", 9, "c\ta\tb"),
             ("c", 0, "  "), ("c", 1, "# only notes")]
    plans, keep = [], MF.written
    monkeypatch.setattr(MF, "written", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, *a))
    found = MF.detect_formats(spark.createDataFrame(lines, "mapping_id string, line_no long, line string"))
    assert rows(found) == [("a", "XSRG"), ("b", "TINY_V2"), ("c", None)]
    assert len(plans) == 1 and "HashAggregate" in plans[0] and "SortAggregate" not in plans[0]


def test_lines_are_read_once_and_by_format(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def line(i):
        made.add(1)
        return f"p/C{i} q/N{i}"

    lines = spark.range(40).select(F.lit("x").alias("mapping_id"), F.when(F.col("id") < 20, "TSRG").otherwise("CSRG").alias("format"),
                                   F.col("id").alias("line_no"), line.asNondeterministic()("id").alias("line"))
    assert MF.parse_mapping_lines(lines, ["TSRG", "CSRG"]).count() == 40
    assert made.value == 40
