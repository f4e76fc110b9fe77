import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from codelode.functions import access as A
from codelode.functions import scalars as S
from codelode.operators import bytestats as B
from codelode.operators.search import parse_number


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'binary' if isinstance(v, (bytes, bytearray)) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "symbol, want",
    [
        ("Java_com_foo_Bar_send__Ljava_lang_String_2", ("com.foo.Bar", "send", "Ljava/lang/String;")),
        ("Java_com_foo_Bar_my_1method", ("com.foo.Bar", "my_method", None)),
        ("Java_com_foo_Bar_pre_0007Apost", ("com.foo.Bar", "prezpost", None)),
        ("Java_onlyclass", None),
        ("JNI_OnLoad", None),
    ],
)
def test_native_symbols(spark, symbol, want):
    got = one(spark, S.jni_parse, symbol)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "path, kind",
    [
        ("a/B.class", "JAVA_CLASS"), ("module-info.class", "JAVA_CLASS"), ("META-INF/MANIFEST.MF", "MANIFEST"),
        ("META-INF/services/x.Y", "SERVICE"), ("x.XSLT", "XML"), ("lib/z.jnilib", "NATIVE_DYLIB"), ("noext", "OTHER"),
    ],
)
def test_kind_by_name(spark, path, kind):
    assert one(spark, S.resource_kind, path) == kind


@pytest.mark.parametrize(
    "content, kind",
    [
        (b"\xca\xfe\xba\xbe\0", "JAVA_CLASS"), (b"PK\x03\x04..", "NESTED_JAR"), (b"BMxx", "IMAGE"), (b"  <?XML v", "XML"),
        (b"[1, 2]", "JSON"), (b"#!/bin/sh", "SCRIPT"), (b"plain text", "TEXT"), (b"\x80\x81\x82\x83\x84", None), (b"ab", None),
    ],
)
def test_kind_by_content(spark, content, kind):
    assert one(spark, S.resource_kind_by_content, content) == kind


def test_match_offsets_count_utf16_units(spark):
    text = "a\U0001f600bc needle\U0001f600x"
    hit = one(spark, lambda c: S.first_match(c, S.literal_regex("NEEDLE\U0001f600")), text)
    assert (hit["start"], hit["end"]) == (6, 14)
    assert one(spark, lambda c: S.first_match(c, S.literal_regex("a.c")), "abc a.c")["start"] == 4


def test_fuzzy(spark):
    score = lambda h, n: one(spark, lambda a, b: S.fuzzy_score(a, b), h, n)
    assert score("abc", "abc") == 1
    assert score("axxb", "ab") == 4
    assert score("abc", "cb") == -1
    assert score("abc", " ") == 0


def test_snippets(spark):
    assert one(spark, lambda c: S.source_snippet(c, F.lit(2)), "a\n\t x y \r\nz") == "x y"
    assert one(spark, lambda c: S.source_snippet(c, F.lit(9)), "a") is None
    assert one(spark, lambda c: S.source_snippet(c, F.lit(1)), "q" * 130) == "q" * 119 + "…"


def test_entropy_and_controls(spark):
    assert one(spark, S.shannon_entropy, "") == 0.0
    assert one(spark, S.shannon_entropy, "abcd") == 2.0
    assert one(spark, S.control_char_heavy, "\x01\x02\x03ab") is True
    assert one(spark, S.control_char_heavy, "\x01\x02\x03" + "a" * 40) is False


def test_checksums(spark):
    for data in (b"", b"abc"):
        got = {k: one(spark, lambda c, k=k: S.checksums(c)[k], data) for k in ("crc32", "md5", "sha1", "sha256", "sha512")}
        assert got["crc32"] == f"{zlib.crc32(data):08X}"
        for k in ("md5", "sha1", "sha256", "sha512"):
            assert got[k] == hashlib.new(k, data).hexdigest()


def test_identifiers(spark):
    legal = lambda s: one(spark, S.is_legal_identifier, s)
    assert legal("größe$1") and not legal("1a") and not legal("a b") and not legal("a\x7f") and not legal("")


def test_descriptors(spark):
    assert one(spark, S.type_to_descriptor, "a.B[][]") == "[[La/B;"
    assert one(spark, S.method_parameter_types, "(I[La/B;[[J)V") == "(int,a.B[],long[][])"
    assert one(spark, S.parameters_to_descriptor, "") == ""


def test_comment_keys(spark):
    got = one(spark, S.decode_comment_key, "METHOD:a.b.C:m:(I)V")
    assert tuple(got) == ("method", "a.b.C", "m", "(I)V")
    assert one(spark, S.decode_comment_key, "NOTE:x") is None


def test_packages(spark):
    inside = lambda fqn, f: one(spark, lambda c: S.included_by_prefix(c, f), fqn)
    out = lambda fqn, ps: one(spark, lambda c: S.excluded_by_packages(c, ps), fqn)
    assert inside("com.foobar.X", "com.foo*") and inside("x", None)
    assert out("com.foo.X", ["com.foo.*"]) and out("com.foo", ["com.foo"]) and not out("com.foobar", ["com.foo"])


def test_numbers():
    assert parse_number("0xDEADBEEF") == (0xDEADBEEF, False)
    # The F suffix means single precision, as float constants are stored.
    assert parse_number("3.14f") == (3.140000104904175, True) and parse_number("1_000") is None and parse_number("1L") == (1, False) and parse_number("abc") is None


def test_snippets_count_utf16_units(spark):
    text = "\U0001f600" * 10 + " alpha needle omega"
    cut = lambda before, after: lambda c: S.match_snippet(c, S.first_match(c, "needle")["start"], S.first_match(c, "needle")["end"], before, after)
    assert one(spark, cut(3, 3), text) == "…ha needle om…"
    assert one(spark, cut(8, 99), text) == "… alpha needle omega"
    assert one(spark, lambda c: S.source_snippet(c, F.lit(1), 6), text) == "\U0001f600" * 2 + "…"


def test_flags_and_versions(spark):
    assert one(spark, lambda c: A.flag_list(c, "method"), 0x0109) == ["public", "static", "native"]
    assert one(spark, A.java_version, 52) == "Java 8" and one(spark, A.java_version, 48) == "Java 1.4"
    assert one(spark, A.java_version, 99) == "Unknown (99)"


def test_needles_and_overlaps(spark, rows):
    assert B.parse_needle("0x41 42") == b"AB" and B.parse_needle("xyz") == b"xyz" and B.parse_needle("A", "UTF-16") == b"A\0"
    files = spark.createDataFrame([("f", b"aaaa")], "id string, content binary")
    assert rows(B.find_bytes(files, b"aa")) == [("f", 0, 2), ("f", 1, 3), ("f", 2, 4)]


def test_byte_diff(spark, rows):
    pairs = spark.createDataFrame([("p", b"abcX", b"abdXYZ"), ("e", b"", b"")], "id string, left binary, right binary")
    assert rows(B.byte_diff(pairs)) == [("p", 0, 2, "SAME"), ("p", 2, 1, "CHANGED"), ("p", 3, 1, "SAME"), ("p", 4, 2, "ONLY_RIGHT")]
