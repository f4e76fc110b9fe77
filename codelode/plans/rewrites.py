"""Rewrite-pass queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import rewrite as Z
from codelode.operators.rollups import pass_counters
from codelode.plans.registry import query
from codelode.plans.sqlviews import cls, with_views
from codelode.sources import tables as T

CODE = ["archive_id", "owner", "method", "desc", "idx", "opcode", "mnemonic", "const_kind", "const_str", "const_long", "ref_owner", "ref_name"]
SITE = ["archive_id", "owner", "method", "desc", "idx"]
_K = 'archive_id, owner, method, "desc"'
_CODE = f"{_K}, idx, opcode, mnemonic, const_kind, const_str, const_long, ref_owner, ref_name"


def _push_sql(kind: str, v: str) -> tuple[str, str]:
    op = f"""CASE WHEN {kind}='int' THEN (CASE WHEN {v} BETWEEN -1 AND 5 THEN {v}+3 WHEN {v} BETWEEN -128 AND 127 THEN 16 WHEN {v} BETWEEN -32768 AND 32767 THEN 17 ELSE 18 END)
      WHEN {kind}='long' AND {v} IN (0,1) THEN {v}+9 ELSE 18 END"""
    name = f"""CASE WHEN {kind}='int' THEN (CASE WHEN {v}=-1 THEN 'ICONST_M1' WHEN {v} BETWEEN 0 AND 5 THEN 'ICONST_'||{v} WHEN {v} BETWEEN -128 AND 127 THEN 'BIPUSH' WHEN {v} BETWEEN -32768 AND 32767 THEN 'SIPUSH' ELSE 'LDC' END)
      WHEN {kind}='long' AND {v} IN (0,1) THEN 'LCONST_'||{v} ELSE 'LDC' END"""
    return op, name


_OP, _NAME = _push_sql("f.const_kind", "f.const_long")


# --- names -------------------------------------------------------------------------------------


def _odd_members(spark, sf):
    """Classes, methods and fields some of whose names no source file could hold."""
    c = T.classes(spark, sf)
    k = F.substring("simple_name", 2, 20).cast("long")
    package = F.concat("package_name", F.lit("/"))
    classes = c.withColumn("internal_name", F.when(k % 7 == 0, F.concat(package, F.lit("1x"), k.cast("string"))).when(k % 7 == 1, F.concat(package, F.lit("class"))).otherwise(F.col("internal_name")))
    m = T.call_methods(spark, sf)
    methods = m.withColumn("name", F.when(F.col("ordinal") == 2, "for").when(F.col("ordinal") == 4, "a b").when(F.col("ordinal") == 6, "<init>").otherwise(F.col("name")))
    fields = T.version_fields(spark, sf, "A").withColumn("ordinal", F.lit(0)).withColumn("name", F.concat(F.lit("-"), "name"))
    return classes, methods, fields


_ODD = """WITH n AS (SELECT 'class' AS kind, CASE WHEN k%7=0 THEN package_name||'/1x'||k ELSE package_name||'/class' END AS owner, 0 AS ordinal, '' AS name, '' AS "desc", package_name||'/C_' AS stem
    FROM (SELECT *, CAST(substr(simple_name,2) AS BIGINT) AS k FROM classes) WHERE k%7 IN (0,1)
   UNION ALL SELECT 'method', owner, ordinal, CASE ordinal WHEN 2 THEN 'for' ELSE 'a b' END, "desc", 'm_' FROM call_methods WHERE ordinal IN (2,4)
   UNION ALL SELECT 'field', owner, 0, '-'||name, "desc", 'f_' FROM fields_a)"""


@query(with_views("classes call_methods fields_a", _ODD + """ SELECT kind, owner, name, "desc", CASE WHEN kind='class' AND owner LIKE '%/class' THEN 'C' ELSE stem||(row_number() OVER (PARTITION BY kind ORDER BY owner, ordinal, name, "desc")-1) END AS target FROM n"""))
def illegal_names(spark, sf):
    mapping, _ = Z.illegal_name_mapping(*_odd_members(spark, sf))
    # Several classes share the name "class" here, so which of them gets which number is open.
    same = (F.col("kind") == "class") & F.col("owner").endswith("/class")
    return mapping.select("kind", "owner", "name", "desc", F.when(same, "C").otherwise(F.col("target")).alias("target"))


@query(with_views("classes call_methods fields_a", _ODD + " SELECT 'illegal-name-mapping' AS pass, CASE WHEN kind='class' THEN 'classes' ELSE kind||'s' END||'-renamed' AS counter, count(*) AS n FROM n GROUP BY 1,2"))
def illegal_name_counters(spark, sf):
    return Z.illegal_name_mapping(*_odd_members(spark, sf))[1]


def _enum_code(spark, sf):
    """An enum class per five parts; each part is one constant set up in the class initialiser."""
    k = F.col("p_partkey")
    s = k.cast("string")
    own = F.concat(F.lit("e/E"), F.floor(k / 5).cast("string"))
    literal = F.when(k % 2 == 0, F.translate("p_name", " ", "_")).otherwise(F.col("p_name"))
    none = F.lit(None).cast("string")

    def row(at, op, owner=none, name=none, text=none):
        return F.struct(
            (k % 5 * 10 + at).cast("int").alias("idx"), F.lit(op).alias("opcode"), owner.alias("ref_owner"), name.alias("ref_name"),
            F.when(text.isNotNull(), "string").alias("const_kind"), text.alias("const_str"),
        )

    odd = F.when(k % 7 == 0, row(4, 187, F.lit("java/lang/Object"))).otherwise(row(4, 16))
    rows = F.array(
        row(0, 187, own), row(1, 89), row(2, 18, text=literal), row(3, -1), odd,
        row(5, 183, own, F.lit("<init>")), row(6, 179, own, F.concat(F.lit("f"), s)),
    )
    part = T.read(spark, sf, "part")
    base = [F.lit("app").alias("archive_id"), own.alias("owner")]
    code = part.select(*base, F.lit("<clinit>").alias("method"), F.lit("()V").alias("desc"), F.explode(rows).alias("r")).select(
        "archive_id", "owner", "method", "desc", "r.*"
    )
    classes = part.select(F.lit("app").alias("archive_id"), own.alias("internal_name"), F.lit(0x4000).alias("access")).distinct()
    fields = part.filter(k % 11 != 0).select(*base, F.concat(F.lit("f"), s).alias("name"))
    return classes, fields, code


_ENUM = """WITH c AS (SELECT 'e/E'||(p_partkey//5) AS owner, p_partkey%5 AS pos, 'f'||p_partkey AS old_name, CASE WHEN p_partkey%2=0 THEN replace(p_name,' ','_') ELSE p_name END AS new_name FROM part WHERE p_partkey%7<>0 AND p_partkey%11<>0),
  r AS (SELECT owner, new_name, arg_min(old_name, pos) AS old_name FROM c WHERE NOT contains(new_name,' ') GROUP BY 1,2)"""


@query(_ENUM + " SELECT owner, old_name, new_name FROM r")
def enum_names(spark, sf):
    return Z.enum_constant_names(*_enum_code(spark, sf))[0].drop("archive_id")


@query(_ENUM + """ SELECT 'field' AS what, 'e/E'||(p_partkey//5) AS owner, coalesce(r.new_name, 'f'||p_partkey) AS name FROM part LEFT JOIN r ON r.owner='e/E'||(p_partkey//5) AND r.old_name='f'||p_partkey WHERE p_partkey%11<>0
  UNION ALL SELECT 'ref', 'e/E'||(p_partkey//5), coalesce(r.new_name, 'f'||p_partkey) FROM part LEFT JOIN r ON r.owner='e/E'||(p_partkey//5) AND r.old_name='f'||p_partkey""")
def enum_rename_applied(spark, sf):
    classes, fields, code = _enum_code(spark, sf)
    new_fields, new_code = Z.rename_in_class(fields, code, Z.enum_constant_names(classes, fields, code)[0])
    refs = new_code.filter(F.col("opcode") == 179).select(F.lit("ref").alias("what"), "owner", F.col("ref_name").alias("name"))
    return new_fields.select(F.lit("field").alias("what"), "owner", "name").unionByName(refs)


@query(with_views("code_annotations", """SELECT 'kotlin-name-restoration' AS pass, 'kotlin-classes-detected' AS counter, count(DISTINCT archive_id||owner) AS n FROM code_annotations WHERE target_kind='class' AND "desc"='Lkotlin/Metadata;' AND visible"""))
def kotlin_marker_count(spark, sf):
    return Z.kotlin_marker_count(T.code_annotations(spark, sf))


def _kotlin_fields(spark, sf):
    k = F.col("p_partkey")
    own = T.class_name(k)
    companion = F.concat(F.lit("L"), own, F.lit("$Companion;"))
    self_type = F.concat(F.lit("L"), own, F.lit(";"))
    field = lambda i, name, desc, access: F.struct(F.lit(i).alias("ordinal"), name.alias("name"), desc.alias("desc"), access.cast("int").alias("access"))
    lit = F.lit
    rows = F.array(
        field(0, F.when(k % 4 == 0, "Companion").otherwise("x"), companion, lit(24)),
        field(1, lit("c"), companion, lit(25)),
        field(2, F.when(k % 5 == 0, "INSTANCE").otherwise("i"), self_type, F.when(k % 3 == 0, 8).otherwise(24)),
        field(3, lit("j"), self_type, lit(25)),
    )
    return T.read(spark, sf, "part").select(T.class_archive(k).alias("archive_id"), own.alias("owner"), F.explode(rows).alias("f")).select("archive_id", "owner", "f.*")


@query(with_views("code_annotations", f"""WITH kt AS (SELECT DISTINCT owner FROM code_annotations WHERE target_kind='class' AND "desc"='Lkotlin/Metadata;' AND visible),
   p AS (SELECT p_partkey AS k, {cls('p_partkey')} AS owner FROM part WHERE {cls('p_partkey')} IN (SELECT owner FROM kt))
  SELECT owner, 'x' AS old_name, 'Companion' AS new_name FROM p WHERE k%4<>0 UNION ALL SELECT owner, CASE WHEN k%3=0 THEN 'j' ELSE 'i' END, 'INSTANCE' FROM p WHERE k%5<>0"""))
def kotlin_singletons(spark, sf):
    return Z.kotlin_singletons(T.code_annotations(spark, sf), _kotlin_fields(spark, sf))[0].drop("archive_id")


@query(with_views("code_annotations", f"""WITH kt AS (SELECT DISTINCT owner FROM code_annotations WHERE target_kind='class' AND "desc"='Lkotlin/Metadata;' AND visible)
  SELECT {cls('p_partkey')} AS owner, CAST(p_partkey%3+1 AS INT) AS component, 'f'||p_partkey AS field FROM part WHERE {cls('p_partkey')} IN (SELECT owner FROM kt) AND p_size%4<>0"""))
def component_accessors(spark, sf):
    k = F.col("p_partkey")
    own = T.class_name(k)
    none = F.lit(None)
    row = lambda i, op, owner=none, name=none, var=none: F.struct(
        F.lit(i).alias("idx"), F.lit(op).alias("opcode"), owner.cast("string").alias("ref_owner"), name.cast("string").alias("ref_name"), var.cast("long").alias("const_long")
    )
    body = F.array(
        row(1, -1), row(2, 25, var=F.when(F.col("p_size") % 4 == 0, 1).otherwise(0)), row(3, 180, own, F.concat(F.lit("f"), k.cast("string"))), row(4, 172)
    )
    code = T.read(spark, sf, "part").select(
        T.class_archive(k).alias("archive_id"), own.alias("owner"), F.concat(F.lit("component"), (k % 3 + 1).cast("string")).alias("method"),
        F.lit("()I").alias("desc"), F.explode(body).alias("r"),
    ).select("archive_id", "owner", "method", "desc", "r.*")
    return Z.component_accessors(T.code_annotations(spark, sf), code).drop("archive_id")


@query(with_views("classes", """SELECT internal_name, CASE WHEN source_file IS NULL OR source_file='x.bin' THEN simple_name||'.java' ELSE source_file END AS source_file FROM classes"""))
def source_files(spark, sf):
    return Z.source_files(T.classes(spark, sf))[0].select("internal_name", "source_file")


# --- attributes --------------------------------------------------------------------------------


@query(with_views("code_annotations", """SELECT * FROM code_annotations WHERE "desc" IN ('Lkotlin/Metadata;','La/Test;')"""))
def annotation_clean(spark, sf):
    return Z.clean_annotations(T.code_annotations(spark, sf))[0]


def _field_attrs(spark, sf):
    k = F.col("s_suppkey")
    attrs = F.when(k % 3 == 0, F.array(F.lit("Code"), F.lit("Signature"), F.lit("StackMapTable"))).when(k % 3 == 1, F.array(F.lit("Deprecated"))).otherwise(F.array().cast("array<string>"))
    return T.read(spark, sf, "supplier").select("s_suppkey", attrs.alias("attrs"))


@query("SELECT s_suppkey, CASE s_suppkey%3 WHEN 0 THEN 'Signature' WHEN 1 THEN 'Deprecated' ELSE '' END AS attrs FROM supplier")
def field_attribute_strip(spark, sf):
    return Z.strip_field_attributes(_field_attrs(spark, sf))[0].select("s_suppkey", F.concat_ws(",", "attrs").alias("attrs"))


def _framed(insns: DataFrame) -> DataFrame:
    return insns.withColumn("pseudo_kind", F.when((F.col("pseudo_kind") == "LINE") & (F.col("line") % 5 == 0), "FRAME").otherwise(F.col("pseudo_kind")))


@query(with_views("instructions", f"SELECT {_K}, idx, CASE WHEN line IS NOT NULL THEN 'LINE' ELSE pseudo_kind END AS pseudo_kind FROM instructions WHERE line IS NULL OR line%5<>0"))
def frame_removal(spark, sf):
    return Z.drop_frames(_framed(T.instructions(spark, sf)))[0].select(*SITE, "pseudo_kind")


# --- constants ---------------------------------------------------------------------------------

_STATIC = f"""WITH o AS (SELECT i.{_CODE.replace(', ', ', i.')}, f.owner AS hit, CAST({_OP} AS INT) AS nop, {_NAME} AS nname, f.const_kind AS nkind, f.const_str AS nstr, f.const_long AS nlong
  FROM instructions i LEFT JOIN code_fields f ON i.opcode=178 AND f.archive_id=i.archive_id AND f.owner=i.ref_owner AND f.name=i.ref_name AND f."desc"=i.ref_desc AND f.access=25 AND f.const_kind IS NOT NULL)"""


@query(with_views("instructions code_fields", _STATIC + f""" SELECT {_K}, idx, coalesce(nop, opcode) AS opcode, CASE WHEN hit IS NULL THEN mnemonic ELSE nname END AS mnemonic, CASE WHEN hit IS NULL THEN const_kind ELSE nkind END AS const_kind,
  CASE WHEN hit IS NULL THEN const_str ELSE nstr END AS const_str, CASE WHEN hit IS NULL THEN const_long ELSE nlong END AS const_long, CASE WHEN hit IS NULL THEN ref_owner END AS ref_owner, CASE WHEN hit IS NULL THEN ref_name END AS ref_name FROM (SELECT *, CASE WHEN hit IS NULL THEN NULL ELSE nop END AS x FROM (SELECT * REPLACE (CASE WHEN hit IS NULL THEN NULL ELSE nop END AS nop) FROM o))"""))
def static_inlining(spark, sf):
    return Z.inline_static_values(T.instructions(spark, sf), T.code_fields(spark, sf))[0].select(*CODE)


def _getters(spark, sf):
    """Constant-returning methods, one per part, and calls of them, two per line item supplier parity."""
    k = F.col("p_partkey")
    own = T.class_name(F.floor(k / 4).cast("long"))
    none = F.lit(None)
    row = lambda i, op, mn, kind=none, text=none, num=none, owner=none, name=none, desc=none: F.struct(
        F.lit(i).alias("idx"), op.cast("int").alias("opcode"), mn.alias("mnemonic"), F.when(op < 0, "LINE").alias("pseudo_kind"),
        kind.cast("string").alias("const_kind"), text.cast("string").alias("const_str"), num.cast("long").alias("const_long"), none.cast("double").alias("const_double"),
        owner.cast("string").alias("ref_owner"), name.cast("string").alias("ref_name"), desc.cast("string").alias("ref_desc"),
    )
    lit = F.lit
    num = F.col("p_size") * 11 - 100
    push = F.when(k % 3 == 0, row(2, lit(18), lit("LDC"), lit("string"), F.col("p_name"))).otherwise(row(2, lit(17), lit("SIPUSH"), lit("int"), num=num))
    ret = F.when((k % 3 == 0) | (k % 5 == 0), row(3, lit(176), lit("ARETURN"))).otherwise(row(3, lit(172), lit("IRETURN")))
    name = F.concat(F.lit("g"), k.cast("string"))
    part = T.read(spark, sf, "part")
    bodies = part.select(F.lit("app").alias("archive_id"), own.alias("owner"), name.alias("method"), F.lit("()I").alias("desc"), F.explode(F.array(row(1, lit(-1), lit("LINE")), push, ret)).alias("r"))
    lk, s = F.col("l_partkey"), F.col("l_suppkey")
    here = T.class_name(F.floor(lk / 4).cast("long"))
    call = row(1, lit(184), lit("INVOKESTATIC"), owner=F.when(s % 2 == 0, here).otherwise("z/Other"), name=F.concat(F.lit("g"), lk.cast("string")), desc=lit("()I"))
    # One caller method per line item.
    key = F.concat_ws("_", F.lit("c"), "l_orderkey", "l_linenumber", lk, s, "l_extendedprice")
    calls = T.read(spark, sf, "lineitem").select(F.lit("app").alias("archive_id"), here.alias("owner"), key.alias("method"), F.lit("()V").alias("desc"), call.alias("r"))
    code = bodies.unionByName(calls).select("archive_id", "owner", "method", "desc", "r.*")
    methods = part.select(F.lit("app").alias("archive_id"), own.alias("owner"), name.alias("name"), F.lit("()I").alias("desc"), F.when(k % 7 == 0, 1).otherwise(9).cast("int").alias("access"))
    return code, methods


_PN = "(p_size*11-100)"
_OPG, _NAMEG = _push_sql("'int'", _PN)


@query(f"""WITH g AS (SELECT p_partkey AS k, p_partkey%3=0 AS str, p_name, {_PN} AS num, CAST({_OPG} AS INT) AS op FROM part WHERE p_partkey%7<>0 AND (p_partkey%3=0 OR p_partkey%5<>0)),
  c AS (SELECT {cls('l_partkey//4')} AS owner, l_partkey, l_suppkey%2=0 AS own, g.k, g.str, g.p_name, g.num, g.op FROM lineitem LEFT JOIN g ON g.k=l_partkey AND l_suppkey%2=0)
  SELECT owner, CASE WHEN k IS NULL THEN 184 WHEN str THEN 18 ELSE op END AS opcode, CASE WHEN k IS NOT NULL THEN (CASE WHEN str THEN 'string' ELSE 'int' END) END AS const_kind, CASE WHEN k IS NOT NULL AND str THEN p_name END AS const_str,
   CASE WHEN k IS NOT NULL AND NOT str THEN num END AS const_long, CASE WHEN k IS NULL THEN 'g'||l_partkey END AS ref_name, count(*) AS n FROM c GROUP BY ALL""")
def call_inlining(spark, sf):
    code, methods = _getters(spark, sf)
    out = Z.inline_call_results(code, methods)[0].filter(F.col("method").startswith("c_"))
    return out.groupBy("owner", "opcode", "const_kind", "const_str", "const_long", "ref_name").agg(F.count("*").alias("n"))


# --- control flow ------------------------------------------------------------------------------


def _opaque_sql(rounds: int) -> str:
    """Window rounds of the pass; the last round must find nothing, which the counters then show."""
    part = f"PARTITION BY {_K} ORDER BY idx"
    text = f"WITH w0 AS (SELECT {_K}, idx, opcode FROM instructions)"
    for r in range(1, rounds + 1):
        text += f""", a{r} AS (SELECT *, last_value(CASE WHEN opcode>=0 THEN opcode END IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM w{r-1}),
          b{r} AS (SELECT *, CASE WHEN opcode IN (153,154) AND p IN (3,4) THEN (opcode=153)=(p=3) END AS taken FROM a{r}),
          c{r} AS (SELECT *, lead(taken) OVER ({part}) IS NOT NULL AS eaten FROM b{r}),
          w{r} AS (SELECT {_K}, idx, CASE WHEN taken THEN 167 ELSE opcode END AS opcode FROM c{r} WHERE coalesce(taken,true) AND NOT (taken IS NULL AND eaten))"""
    return text


_ROUNDS = 5


@query(with_views("instructions", _opaque_sql(_ROUNDS) + f" SELECT * FROM w{_ROUNDS}"))
def opaque_predicates(spark, sf):
    return Z.simplify_opaque_predicates(T.instructions(spark, sf))[0].select(*SITE, "opcode")


@query(with_views("instructions", _opaque_sql(_ROUNDS) + " SELECT 'opaque-predicate-simplification' AS pass, CASE WHEN taken THEN 'branches-forced-taken' ELSE 'branches-dropped' END AS counter, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT taken FROM c{r}" for r in range(1, _ROUNDS + 1)) + ") WHERE taken IS NOT NULL GROUP BY 1,2"))
def opaque_counters(spark, sf):
    return Z.simplify_opaque_predicates(T.instructions(spark, sf))[1]


_REFERENCED = f"""refs AS (SELECT {_K}, CAST(unnest(jump_targets) AS INT) AS label FROM instructions UNION SELECT {_K}, start_label FROM try_catch UNION SELECT {_K}, end_label FROM try_catch
   UNION SELECT {_K}, min(label) FROM instructions WHERE label IS NOT NULL GROUP BY ALL)"""


@query(with_views("instructions try_catch", f"""WITH {_REFERENCED}, u AS (SELECT i.*, i.label IS NOT NULL AND (archive_id, owner, method, "desc", label) IN (SELECT * FROM refs) AS used FROM instructions i),
  e AS (SELECT *, last_value(CASE WHEN opcode IN (172,167,170) THEN 'd' WHEN used THEN 'l' END IGNORE NULLS) OVER (PARTITION BY {_K} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ev FROM u)
  SELECT {_K}, idx, opcode FROM e WHERE NOT (coalesce(ev,'l')='d' AND NOT used AND coalesce(pseudo_kind,'')<>'LINE')"""))
def unreachable_code(spark, sf):
    insns = T.instructions(spark, sf)
    return Z.strip_after_terminators(insns, T.code_try_catch(spark, sf, insns))[0].select(*SITE, "opcode")


@query(with_views("instructions try_catch", f"""WITH RECURSIVE base AS (SELECT {_K}, idx, opcode, pseudo_kind, label, jump_targets, max(idx) OVER (PARTITION BY {_K}) AS size FROM instructions),
  flow AS (SELECT {_K}, idx AS a, idx+1 AS b FROM base WHERE opcode NOT IN (172,167,170)
    UNION ALL SELECT {_K}, idx, CAST(unnest(jump_targets) AS INT) FROM base
    UNION ALL SELECT base.archive_id, base.owner, base.method, base."desc", base.idx, t.handler_label FROM base JOIN try_catch t ON t.archive_id=base.archive_id AND t.owner=base.owner AND t.method=base.method AND t."desc"=base."desc" AND base.idx>=t.start_label AND base.idx<t.end_label),
  live AS (SELECT DISTINCT {_K}, 1 AS a FROM base UNION SELECT l.archive_id, l.owner, l.method, l."desc", f.b FROM live l JOIN flow f ON f.archive_id=l.archive_id AND f.owner=l.owner AND f.method=l.method AND f."desc"=l."desc" AND f.a=l.a),
  bad AS (SELECT DISTINCT l.archive_id, l.owner, l.method, l."desc" FROM live l JOIN (SELECT DISTINCT {_K}, size FROM base) s ON s.archive_id=l.archive_id AND s.owner=l.owner AND s.method=l.method AND s."desc"=l."desc" WHERE l.a>s.size)
  SELECT {_K}, idx, opcode FROM base WHERE pseudo_kind IS NOT NULL OR (archive_id, owner, method, "desc") IN (SELECT * FROM bad) OR (archive_id, owner, method, "desc", idx) IN (SELECT * FROM live)""", recursive=True))
def dead_code(spark, sf):
    insns = T.instructions(spark, sf)
    return Z.remove_dead_code(insns, T.code_try_catch(spark, sf, insns))[0].select(*SITE, "opcode")


@query(with_views("instructions code_fields code_annotations", _STATIC + """ SELECT 'static-value-inlining' AS pass, 'constants-inlined' AS counter, count(*) AS n FROM o WHERE hit IS NOT NULL
  UNION ALL SELECT 'stack-frame-removal', 'frames-removed', count(*) FROM instructions WHERE line%5=0
  UNION ALL SELECT 'remove-illegal-annotations', 'annotations-removed', count(*) FROM code_annotations WHERE "desc" NOT IN ('Lkotlin/Metadata;','La/Test;')"""))
def pass_chain(spark, sf):
    """Three passes in a row over one set of facts, and their counters."""
    facts = {"instructions": _framed(T.instructions(spark, sf)), "fields": T.code_fields(spark, sf), "annotations": T.code_annotations(spark, sf)}

    def inline(f):
        code, counts = Z.inline_static_values(f["instructions"], f["fields"])
        return {"instructions": code}, counts

    def frames(f):
        code, counts = Z.drop_frames(f["instructions"])
        return {"instructions": code}, counts

    def annotations(f):
        kept, counts = Z.clean_annotations(f["annotations"])
        return {"annotations": kept}, counts

    return pass_counters(Z.run_passes(facts, [inline, frames, annotations])[1])
