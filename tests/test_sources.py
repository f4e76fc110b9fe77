import glob
import io
import json
import os
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from codelode.sources import archives as A
from codelode.sources import mapping_files as MF
from codelode.streaming import jvmstate as V

FILES = {
    "PROGUARD": "# c\ncom.Foo -> a:\n    int x -> b\n    12:15:void m(int,java.lang.String[]) -> c\n",
    "TINY_V1": "v1\tofficial\tnamed\nCLASS\ta\tcom/Foo\nFIELD\ta\tI\tb\tx\nMETHOD\ta\t(I[Ljava/lang/String;)V\tc\tm\n",
    "TINY_V2": "tiny\t2\t0\tofficial\tnamed\nc\ta\tcom/Foo\n\tf\tI\tb\tx\n\tm\t(I[Ljava/lang/String;)V\tc\tm\n\t\tp\t1\t\tz\n",
    "XSRG": "PK: . x\nCL: a com/Foo\nFD: a/b I com/Foo/x I\nMD: a/c (I[Ljava/lang/String;)V com/Foo/m (I[Ljava/lang/String;)V\n",
    "ENIGMA": "CLASS a com/Foo\n\tFIELD b x I\n\tMETHOD c m (I[Ljava/lang/String;)V\n\t\tARG 1 q\n\tCLASS in Inner\n\t\tCLASS deep Deeper\n\t\t\tFIELD p q J\nCLASS z\n\tFIELD r s I\n",
    "SRG": "CL: a com/Foo\nFD: a/b com/Foo/x\nMD: a/c (I[Ljava/lang/String;)V com/Foo/m (I)V\n",
    "TSRG": "a com/Foo\n\tb x\n\tc (I[Ljava/lang/String;)V m\n",
    "TSRG_V2": "tsrg2 obf named\na com/Foo\n\tb x\n\tc (I[Ljava/lang/String;)V m\n\t\t0 p q\n",
    "JOBF": ".class_map a com.Foo\n.field_map a.b x\n.method_map a.c(I[Ljava/lang/String;)V m\n",
    "RECAF": "a.b x\na com/Foo\na.c(I[Ljava/lang/String;)V m\n",
}
CORE = [("class", "a", "", "com/Foo"), ("field", "a", "b", "x"), ("method", "a", "c", "m")]


def test_read_detects_every_format(spark, tmp_path):
    for fmt, text in FILES.items():
        (tmp_path / f"{fmt}.txt").write_text(text)
    got = MF.read_mapping(spark, str(tmp_path)).withColumn("f", F.regexp_extract("mapping_id", r"([A-Z0-9_]+)\.txt", 1))
    by_format = {}
    for r in got.collect():
        by_format.setdefault(r["f"], []).append((r["kind"], r["owner"], r["name"], r["target"]))
        assert r["kind"] != "method" or r["desc"] == "(I[Ljava/lang/String;)V"
    nested = [("class", "a$in", "", "com/Foo$Inner"), ("class", "a$in$deep", "", "com/Foo$Inner$Deeper"), ("field", "a$in$deep", "p", "q"), ("field", "z", "r", "s")]
    for fmt in FILES:
        assert sorted(by_format[fmt]) == sorted(CORE + (nested if fmt == "ENIGMA" else [])), fmt


def test_csrg_must_be_asked_for(spark, tmp_path):
    (tmp_path / "m.csrg").write_text("a com/Foo\na b x\na c (I)V m\n")
    assert MF.detect_formats(MF.read_mapping_lines(spark, str(tmp_path))).first()["format"] == "TSRG"
    rows = MF.read_mapping(spark, str(tmp_path), "CSRG").collect()
    assert sorted((r["kind"], r["owner"], r["name"], r["target"]) for r in rows) == CORE


@pytest.mark.parametrize("fmt", MF.FORMATS)
def test_write_then_read(spark, tmp_path, fmt):
    schema = "mapping_id string, kind string, owner string, name string, desc string, target string"
    mapping = spark.createDataFrame(
        [("m", "class", "a", "", "", "com/Foo"), ("m", "class", "b", "", "", "com/Bar"), ("m", "field", "a", "f", "I", "x"), ("m", "method", "b", "g", "(I)[La;", "y")], schema
    )
    MF.write_mapping(mapping, fmt, str(tmp_path / "out"))
    text = "".join(open(p).read() for p in sorted(glob.glob(str(tmp_path / "out" / "part-*"))))
    (tmp_path / "one.txt").write_text(text)
    back = MF.read_mapping(spark, str(tmp_path / "one.txt"), fmt)
    lossy = fmt in ("SRG", "TSRG", "TSRG_V2", "CSRG", "JOBF", "RECAF")
    want = sorted((k, o, n, "" if lossy and k == "field" else d, t) for _, k, o, n, d, t in [tuple(r) for r in mapping.collect()])
    assert sorted(tuple(r)[1:] for r in back.collect()) == want


def _zip(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries:
            z.writestr(name, body)
    return buffer.getvalue()


def test_ingest_of_bundled_archives(spark, tmp_path):
    jars = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*.jar")), key=os.path.getsize)
    picked = [j for j in jars if 20_000 < os.path.getsize(j) < 40_000][:3]
    tables = A.ingest(spark, picked, str(tmp_path / "facts"))
    expected = sum(n.endswith(".class") for j in picked for n in zipfile.ZipFile(j).namelist())
    assert tables["classes"].count() == expected
    assert tables["call_sites"].filter("kind like 'INVOKE%'").count() == tables["instructions"].filter("opcode between 182 and 185").count()
    counted = tables["methods"].agg(F.sum("real_count")).first()[0]
    assert counted == tables["instructions"].filter("opcode >= 0").count()
    assert tables["archives"].count() == 3


def test_damaged_archive_and_class(spark):
    whole = _zip([("A.class", b"\xca\xfe"), ("x.txt", b"hi"), ("d/", b"")])
    cut = whole[: whole.find(b"PK\x01\x02")]
    files = spark.createDataFrame([("whole", whole), ("cut", cut), ("one.class", b"junk")], "archive_id string, content binary")
    entries = A.scan_archive_files(files)
    assert sorted((r["archive_id"], r["path"]) for r in entries.collect()) == [
        ("cut", "A.class"), ("cut", "x.txt"), ("one.class", "one.class"), ("whole", "A.class"), ("whole", "x.txt"),
    ]
    facts = A.ClassFacts(A.decode_classes(entries))
    assert facts.failures().count() == 3 and facts.classes().count() == 0


def _polls(n):
    return [json.dumps({"runtime": {"pid": 5}, "memory": {"heap": {"used": i << 20}}, "threads": {"threadCount": i, "deadlocked": [], "list": []}}) for i in range(n)]


def test_snapshot_defaults(spark):
    polls = spark.createDataFrame([(5, 0, '{"os": {"cpuLoad": 0.5}}'), (5, 1, "[]"), (5, 2, "{broken"), (5, 3, "{}")], "pid bigint, tick bigint, json string")
    parsed = V.parse_snapshots(polls)
    assert sorted(r["tick"] for r in V.corrupt_snapshots(parsed).collect()) == [1, 2]
    row = V.runtime_summary(V.valid_snapshots(parsed)).filter("tick = 0").first()
    assert (row["cpuLoad"], row["processCpuLoad"], row["uptime"], dict(row["properties"])) == (0.5, -1.0, 0, {})
    assert V.samples(V.valid_snapshots(parsed)).count() == 1


def test_stream_history_over_batches(spark, tmp_path):
    """Several micro-batches end in the same history as one batch over everything."""
    (tmp_path / "in").mkdir()
    docs = _polls(150)
    for part in range(3):
        lines = [json.dumps({"tick": i, "doc": docs[i]}) for i in range(part * 50, part * 50 + 50)]
        (tmp_path / "in" / f"p{part}.txt").write_text("\n".join(lines))
    flat = lambda df: df.select(F.lit(5).cast("long").alias("pid"), F.get_json_object("json", "$.tick").cast("long").alias("tick"), F.get_json_object("json", "$.doc").alias("json"))
    stream = V.samples(V.valid_snapshots(V.parse_snapshots(flat(V.read_snapshots(spark, str(tmp_path / "in"), 1)))))
    table = V.run_to_table(V.rolling_history(stream), str(tmp_path / "out"), "update")
    assert table.select("batch_id").distinct().count() == 3
    batch = V.samples(V.valid_snapshots(V.parse_snapshots(flat(spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "json")))))
    key = lambda df: sorted((r["series"], r["tick"], r["value"]) for r in df.collect())
    want = key(V.last_samples(batch))
    assert len(want) == 120 and key(V.latest_per_series(table)) == want


def test_status_change_stream_with_many_rows(spark, tmp_path):
    """One key over many Arrow batches."""
    updates = spark.range(30_000).select(F.lit("k").alias("key"), F.col("id").alias("attempt_no"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("status"))
    updates.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(updates.schema).parquet(str(tmp_path / "in"))
    got = V.run_to_table(V.status_change_stream(stream), str(tmp_path / "out"))
    assert got.count() == V.status_changes(updates).count() == 20_000
