"""Archive and class-file queries over archives built from the test tables."""

from __future__ import annotations

import io
import struct
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from codelode.functions import scalars as S
from codelode.operators.search import resource_lines
from codelode.plans.registry import query
from codelode.plans.sqlviews import with_views
from codelode.sources import archives as A
from codelode.sources import tables as T


@F.pandas_udf(PT.BinaryType())
def _pack(kind: pd.Series, names: pd.Series, bodies: pd.Series) -> pd.Series:
    """A small archive per row: plain, cut off, with a module header, behind a prefix, or with a repeated name."""
    out = []
    for k, entry_names, body in zip(kind, names, bodies):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("dir/", b"")
            for n in entry_names:
                z.writestr(zipfile.ZipInfo(("classes/" if k == 2 else "") + n), body, zipfile.ZIP_DEFLATED)
        data = buffer.getvalue()
        if k == 1:
            data = data[: data.find(b"PK\x01\x02")]
        elif k == 2:
            data = b"JM\x01\x00" + data
        elif k == 3:
            data = b"#!/bin/sh\n" + data
        out.append(data)
    return pd.Series(out)


def _archives(spark, sf):
    k = F.col("page_id")
    name = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    names = F.array(
        name("p/A", k, ".class"), name("META-INF/versions/", k % 30, "/p/A.class"), name("META-INF/versions/99999999999/p/A.class"),
        name("res/r", k, ".json"), name("data", k),
    )
    return T.read(spark, sf, "pages").select(
        name("arc", k).alias("archive_id"), _pack(k % 4, names, F.encode("html", "UTF-8")).alias("content")
    )


_ENTRIES = """WITH p AS (SELECT 'arc'||page_id AS archive_id, page_id AS k, html FROM pages),
  e AS (SELECT archive_id, k, html, 'p/A'||k||'.class' AS path, true AS is_class, 0 AS runtime_version, 0 AS n FROM p UNION ALL SELECT archive_id, k, html, 'META-INF/versions/'||(k%30)||'/p/A.class', true, k%30, 1 FROM p
   UNION ALL SELECT archive_id, k, html, 'META-INF/versions/99999999999/p/A.class', false, 0, 2 FROM p UNION ALL SELECT archive_id, k, html, 'res/r'||k||'.json', false, 0, 3 FROM p UNION ALL SELECT archive_id, k, html, 'data'||k, false, 0, 4 FROM p)"""


@query(_ENTRIES + """ SELECT archive_id, CAST(n AS INT) AS entry_no, path, sha256(html) AS digest, is_class, CAST(runtime_version AS INT) AS runtime_version, CASE WHEN k%4=1 THEN 2 WHEN k%4=3 THEN 1 ELSE 0 END AS notes FROM e""")
def archive_scan(spark, sf):
    found = A.scan_archive_files(_archives(spark, sf))
    return found.select(
        "archive_id", "entry_no", "path", F.sha2("content", 256).alias("digest"), "is_class", "runtime_version",
        F.size("diagnostics").alias("notes"),
    )


@query(_ENTRIES + """ SELECT archive_id, path, split_part(path,'/',-1) AS simple_name, CAST(strlen(html) AS BIGINT) AS size, CASE n WHEN 2 THEN 'JAVA_CLASS' WHEN 3 THEN 'JSON' ELSE 'TEXT' END AS kind FROM e
  WHERE NOT is_class AND (n<>4 OR len([x for x in regexp_extract_all(substr(hex(encode(html)),1,512),'..') if regexp_matches(x,'^(09|0A|0D|[2-6].|7[0-9A-E]|[C-F].)$')])*10 > least(strlen(html),256)*9)
  UNION ALL SELECT archive_id, path, path, CAST(strlen(html) AS BIGINT), 'OTHER' FROM e WHERE n=4 AND NOT len([x for x in regexp_extract_all(substr(hex(encode(html)),1,512),'..') if regexp_matches(x,'^(09|0A|0D|[2-6].|7[0-9A-E]|[C-F].)$')])*10 > least(strlen(html),256)*9""")
def archive_resources(spark, sf):
    return A.resources(A.scan_archive_files(_archives(spark, sf))).drop("content")


@query(with_views("resource_lines", "SELECT path, line_no, text FROM resource_lines"))
def text_resource_lines(spark, sf):
    named = T.resources(spark, sf).withColumn("kind", S.resource_kind(F.col("path")))
    return resource_lines(named).drop("archive_id")


@F.pandas_udf(PT.BinaryType())
def _assemble(name: pd.Series, parent: pd.Series, text: pd.Series, number: pd.Series) -> pd.Series:
    """A class file per row: one constant field and one method calling back into the class."""
    out = []
    for cls, sup, literal, value in zip(name, parent, text, number):
        pool: list[bytes] = []

        def add(raw: bytes) -> int:
            pool.append(raw)
            return len(pool)

        utf = lambda s: add(b"\x01" + struct.pack(">H", len(s.encode())) + s.encode())
        this = add(b"\x07" + struct.pack(">H", utf(cls)))
        base = add(b"\x07" + struct.pack(">H", utf(sup)))
        constant = add(b"\x03" + struct.pack(">i", int(value)))
        string = add(b"\x08" + struct.pack(">H", utf(literal)))
        pair = add(b"\x0c" + struct.pack(">HH", utf("m"), utf("()V")))
        method = add(b"\x0a" + struct.pack(">HH", this, pair))
        names = {s: utf(s) for s in ("F", "I", "ConstantValue", "Code", "LineNumberTable", "m", "()V")}
        # ldc text; pop; goto +3; invokestatic m; iconst_2; ifeq -4; tableswitch 0..1; return
        code = b"\x12" + bytes([string]) + b"\x57\xa7\x00\x03\xb8" + struct.pack(">H", method) + b"\x05\x99\xff\xfc"
        code += b"\xaa" + b"\x00" * (-(len(code) + 1) % 4)
        at = code.rindex(b"\xaa")
        code += struct.pack(">iiiii", 0, 0, 1, 0, 0)
        code = code[: len(code) - 20] + struct.pack(">iiiii", len(code) - at, 0, 1, len(code) - at, len(code) - at) + b"\xb1"
        lines = struct.pack(">HI", names["LineNumberTable"], 6) + struct.pack(">HHH", 1, 0, 7)
        body = struct.pack(">HHI", 1, 0, len(code)) + code + struct.pack(">H", 0) + struct.pack(">H", 1) + lines
        data = struct.pack(">IHHH", 0xCAFEBABE, 0, 52, len(pool) + 1) + b"".join(pool)
        data += struct.pack(">HHHH", 0x21, this, base, 0)
        data += struct.pack(">HHHHH", 1, 0x19, names["F"], names["I"], 1) + struct.pack(">HIH", names["ConstantValue"], 2, constant)
        data += struct.pack(">HHHHH", 1, 9, names["m"], names["()V"], 1) + struct.pack(">HI", names["Code"], len(body)) + body
        out.append(data + struct.pack(">H", 0))
    return pd.Series(out)


def _decoded(spark, sf):
    k = F.col("p_partkey")
    name, parent = T.class_name(k), T.class_name(F.floor(k / 4).cast("long"))
    data = _assemble(name, parent, F.col("p_name"), F.col("p_size") * 1000 - 9000)
    broken = F.when(k % 9 == 0, F.encode("p_name", "UTF-8")).otherwise(data)
    entries = T.read(spark, sf, "part").select(
        F.lit("app").alias("archive_id"), F.concat(name, F.lit(".class")).alias("path"), F.lit(0).alias("runtime_version"),
        F.lit(True).alias("is_class"), broken.alias("content"),
    )
    return A.ClassFacts(A.decode_classes(entries))


_OWN = "('k'||(p_partkey%20)||'/C'||p_partkey)"


@query(f"""SELECT {_OWN} AS internal_name, 'k'||((p_partkey//4)%20)||'/C'||(p_partkey//4) AS super_name, 33 AS access, 52 AS major, 1 AS method_count, 1 AS field_count, 19 AS cp_size FROM part WHERE p_partkey%9<>0""")
def decoded_classes(spark, sf):
    return _decoded(spark, sf).classes().select("internal_name", "super_name", "access", "major", "method_count", "field_count", "cp_size")


@query(f"""SELECT {_OWN} AS owner, 'method' AS kind, 'm' AS name, 9 AS access, CAST(NULL AS BIGINT) AS const_long, 8 AS real_count, 2 AS jump_label_count, 3 AS label_count, 1 AS line_count FROM part WHERE p_partkey%9<>0
  UNION ALL SELECT {_OWN}, 'field', 'F', 25, p_size*1000-9000, NULL, NULL, NULL, NULL FROM part WHERE p_partkey%9<>0""")
def decoded_members(spark, sf):
    facts = _decoded(spark, sf)
    none = F.lit(None)
    methods = facts.methods().select(
        "owner", F.lit("method").alias("kind"), "name", "access", none.cast("long").alias("const_long"),
        "real_count", "jump_label_count", "label_count", "line_count",
    )
    counts = [none.cast("int").alias(c) for c in ("real_count", "jump_label_count", "label_count", "line_count")]
    fields = facts.fields().select("owner", F.lit("field").alias("kind"), "name", "access", "const_long", *counts)
    return methods.unionByName(fields)


@query(f"""WITH c AS (SELECT {_OWN} AS owner, p_name FROM part WHERE p_partkey%9<>0),
  r AS (SELECT * FROM (VALUES (0,-1,'LABEL',NULL,''),(1,-1,'LINE',NULL,''),(2,18,'LDC','string',''),(3,87,'POP',NULL,''),(4,167,'GOTO',NULL,'6'),(5,-1,'LABEL',NULL,''),(6,184,'INVOKESTATIC',NULL,''),
    (7,5,'ICONST_2','int',''),(8,153,'IFEQ',NULL,'6'),(9,170,'TABLESWITCH',NULL,'x'),(10,-1,'LABEL',NULL,''),(11,177,'RETURN',NULL,'')) t(idx, opcode, mnemonic, const_kind, jumps))
  SELECT owner, idx, opcode, mnemonic, const_kind, CASE WHEN opcode=18 THEN p_name END AS const_str, CASE WHEN opcode=184 THEN owner END AS ref_owner, CASE WHEN opcode=170 THEN 2 END AS switch_cases FROM c, r""")
def decoded_code(spark, sf):
    return _decoded(spark, sf).instructions().select("owner", "idx", "opcode", "mnemonic", "const_kind", "const_str", "ref_owner", "switch_cases")


@query("SELECT 'k'||(p_partkey%20)||'/C'||p_partkey||'.class' AS path FROM part WHERE p_partkey%9=0")
def decode_failures(spark, sf):
    return _decoded(spark, sf).failures().select("path")


@query(f"""SELECT {_OWN} AS owner, 'Integer' AS type, CAST(p_size*1000-9000 AS VARCHAR) AS value FROM part WHERE p_partkey%9<>0 UNION ALL SELECT {_OWN}, 'Class', '#1 -> '||{_OWN} FROM part WHERE p_partkey%9<>0
  UNION ALL SELECT {_OWN}, 'Class', '#3 -> k'||((p_partkey//4)%20)||'/C'||(p_partkey//4) FROM part WHERE p_partkey%9<>0 UNION ALL SELECT {_OWN}, 'String', '#6 -> '||p_name FROM part WHERE p_partkey%9<>0
  UNION ALL SELECT {_OWN}, 'Methodref', '#2, #10' FROM part WHERE p_partkey%9<>0""")
def constant_pool_rows(spark, sf):
    pool = _decoded(spark, sf).constant_pool()
    return pool.filter(F.col("type").isin("Integer", "Class", "String", "Methodref")).select("owner", "type", "value")
