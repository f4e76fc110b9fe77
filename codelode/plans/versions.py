"""Diff and mapping queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import diffs as D
from codelode.operators import mappings as M
from codelode.plans.registry import query
from codelode.plans.sqlviews import cls, with_views
from codelode.sources import mapping_files as MF
from codelode.sources import tables as T

# --- diffs -------------------------------------------------------------------------------------

_CLASS_DIFF = """SELECT coalesce(a.name,b.name) AS name,
  CASE WHEN a.name IS NULL THEN 'ADDED' WHEN b.name IS NULL THEN 'REMOVED' WHEN a.bytes=b.bytes THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change,
  CASE WHEN a.name IS NULL OR b.name IS NULL OR a.bytes=b.bytes THEN '' ELSE concat_ws('; ',
    CASE WHEN a.access<>b.access THEN 'access: '||a.access||' -> '||b.access END, CASE WHEN a.super_name<>b.super_name THEN 'super: '||a.super_name||' -> '||b.super_name END,
    CASE WHEN a.interfaces<>b.interfaces THEN 'interfaces: ['||array_to_string(a.interfaces,', ')||'] -> ['||array_to_string(b.interfaces,', ')||']' END,
    CASE WHEN a.major<>b.major THEN 'version: '||a.major||' -> '||b.major END) END AS header_changes
  FROM ver_a a FULL JOIN ver_b b ON a.name=b.name"""


def _class_diff(spark, sf):
    return D.class_diff(T.versions(spark, sf, "A"), T.versions(spark, sf, "B"))


@query(with_views("ver_a ver_b", _CLASS_DIFF))
def class_diff(spark, sf):
    return _class_diff(spark, sf).select("name", "change", F.concat_ws("; ", "header_changes").alias("header_changes"))


def _edit_methods(methods: DataFrame) -> DataFrame:
    edited = F.substring("owner", -1, 1).isin("3", "7")
    access = F.when(edited & (F.col("ordinal") == 1), F.col("access") + 16).otherwise(F.col("access"))
    name = F.when(edited & (F.col("ordinal") == 3), "added").otherwise(F.col("name"))
    return methods.withColumn("access", access).withColumn("name", name)


def _edit_code(insns: DataFrame) -> DataFrame:
    """Opcode edits in methods q0, operand edits (which must not show) in q2, a rename in q3."""
    edited = F.substring("owner", -1, 1).isin("3", "7")
    op = F.when(edited & (F.col("method") == "q0") & (F.col("opcode") == 3), 4).otherwise(F.col("opcode"))
    operand = F.when(edited & (F.col("method") == "q2"), F.col("const_long") + 1).otherwise(F.col("const_long"))
    name = F.when(edited & (F.col("method") == "q3"), "added").otherwise(F.col("method"))
    return insns.withColumn("opcode", op).withColumn("const_long", operand).withColumn("method", name)


@query(with_views("instructions code_methods", """WITH mod AS (SELECT DISTINCT archive_id, owner FROM code_methods WHERE owner LIKE '%3' OR owner LIKE '%5'),
  ops AS (SELECT owner, method AS name, "desc", string_agg(opcode, ';' ORDER BY idx) AS a,
    string_agg(CASE WHEN owner[-1] IN ('3','7') AND method='q0' AND opcode=3 THEN 4 ELSE opcode END, ';' ORDER BY idx) AS b FROM instructions GROUP BY ALL),
  l AS (SELECT m.owner, m.name, m."desc", access, coalesce(a,'') AS body FROM code_methods m LEFT JOIN ops USING (owner, name, "desc") WHERE (archive_id, m.owner) IN (SELECT archive_id, owner FROM mod)),
  r AS (SELECT m.owner, CASE WHEN m.owner[-1] IN ('3','7') AND ordinal=3 THEN 'added' ELSE m.name END AS name, m."desc", CAST(CASE WHEN m.owner[-1] IN ('3','7') AND ordinal=1 THEN access+16 ELSE access END AS INT) AS access, coalesce(b,'') AS body
    FROM code_methods m LEFT JOIN ops USING (owner, name, "desc") WHERE (archive_id, m.owner) IN (SELECT archive_id, owner FROM mod))
  SELECT owner, 'METHOD' AS kind, CASE WHEN l.access IS NULL THEN 'ADDED' WHEN r.access IS NULL THEN 'REMOVED' WHEN l.access=r.access AND l.body=r.body THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change,
   name, "desc", coalesce(l.access,0) AS old_access, coalesce(r.access,0) AS new_access,
   CASE WHEN l.access IS NULL OR r.access IS NULL THEN '' WHEN l.access<>r.access THEN 'access '||l.access||' -> '||r.access WHEN l.body<>r.body THEN 'bytecode changed' ELSE '' END AS detail
  FROM l FULL JOIN r USING (owner, name, "desc")"""))
def method_diff(spark, sf):
    methods, insns = T.code_methods(spark, sf), T.instructions(spark, sf)
    modified = methods.filter(F.substring("owner", -1, 1).isin("3", "5")).select("archive_id", "owner").distinct()
    return D.method_diff((methods, insns), (_edit_methods(methods), _edit_code(insns)), modified).drop("archive_id")


@query(with_views("ver_a ver_b fields_a fields_b", f"""WITH cd AS ({_CLASS_DIFF}), mod AS (SELECT replace(name,'.','/') AS owner FROM cd WHERE change='MODIFIED'),
  a AS (SELECT * FROM fields_a WHERE owner IN (SELECT owner FROM mod)), b AS (SELECT * FROM fields_b WHERE owner IN (SELECT owner FROM mod))
  SELECT owner, 'FIELD' AS kind, CASE WHEN a.access IS NULL THEN 'ADDED' WHEN b.access IS NULL THEN 'REMOVED' WHEN a.access=b.access AND a.const_value=b.const_value THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change,
   name, "desc", coalesce(a.access,0) AS old_access, coalesce(b.access,0) AS new_access,
   CASE WHEN a.access IS NULL OR b.access IS NULL THEN '' WHEN a.access<>b.access THEN 'access '||a.access||' -> '||b.access WHEN a.const_value<>b.const_value THEN 'value '||a.const_value||' -> '||b.const_value ELSE '' END AS detail
  FROM a FULL JOIN b USING (owner, name, "desc")"""))
def field_diff(spark, sf):
    modified = _class_diff(spark, sf).filter(F.col("change") == "MODIFIED").select(
        "archive_id", F.translate("name", ".", "/").alias("owner")
    )
    return D.field_diff(T.version_fields(spark, sf, "A"), T.version_fields(spark, sf, "B"), modified).drop("archive_id")


_RES = """WITH p AS (SELECT 'r'||page_id AS path, page_id AS k, html FROM pages), a AS (SELECT path, html AS c, strlen(html) AS size FROM p WHERE k%6<>0),
  b AS (SELECT path, CASE WHEN k%5=0 THEN html||'x' ELSE html END AS c, strlen(CASE WHEN k%5=0 THEN html||'x' ELSE html END) AS size FROM p WHERE k%6<>1),
  rd AS (SELECT path, CASE WHEN a.c IS NULL THEN 'ADDED' WHEN b.c IS NULL THEN 'REMOVED' WHEN a.c=b.c THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change,
   CAST(coalesce(a.size,0) AS BIGINT) AS old_size, CAST(coalesce(b.size,0) AS BIGINT) AS new_size FROM a FULL JOIN b USING (path))"""


def _resource_diff(spark, sf):
    k = F.col("page_id")

    def side(drop, edit):
        html = F.when(k % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")) if edit else F.col("html")
        content = F.encode(html, "UTF-8")
        return T.read(spark, sf, "pages").filter(k % 6 != drop).select(
            F.lit("app").alias("archive_id"), F.concat(F.lit("r"), k.cast("string")).alias("path"),
            content.alias("content"), F.length(content).cast("long").alias("size"),
        )

    return D.resource_diff(side(0, False), side(1, True))


@query(_RES + " SELECT * FROM rd")
def resource_diff(spark, sf):
    return _resource_diff(spark, sf).drop("archive_id")


@query(with_views("ver_a ver_b", _RES + f""", cd AS ({_CLASS_DIFF}) SELECT
  (SELECT count(*) FROM cd WHERE change='ADDED') AS classes_added, (SELECT count(*) FROM cd WHERE change='REMOVED') AS classes_removed,
  (SELECT count(*) FROM cd WHERE change='MODIFIED') AS classes_modified, (SELECT count(*) FROM cd WHERE change='UNCHANGED') AS classes_unchanged,
  (SELECT count(*) FROM rd WHERE change='ADDED') AS resources_added, (SELECT count(*) FROM rd WHERE change='REMOVED') AS resources_removed,
  (SELECT count(*) FROM rd WHERE change='MODIFIED') AS resources_modified, (SELECT count(*) FROM rd WHERE change='UNCHANGED') AS resources_unchanged"""))
def diff_stats(spark, sf):
    return D.diff_stats(_class_diff(spark, sf), _resource_diff(spark, sf)).drop("archive_id")


@query(with_views("ver_a ver_b", f"""WITH cd AS ({_CLASS_DIFF}) SELECT change, name AS label, count(*) OVER (PARTITION BY change) AS in_group FROM cd WHERE change<>'UNCHANGED'"""))
def diff_tree(spark, sf):
    return D.diff_tree(_class_diff(spark, sf), "name").drop("archive_id")


# --- mapping algebra ---------------------------------------------------------------------------

_MAP_DIFF = """WITH d AS (SELECT kind, owner, name, "desc", a.target AS old_target, b.target AS new_target,
  CASE WHEN a.target IS NULL THEN 'ADDED' WHEN b.target IS NULL THEN 'REMOVED' WHEN a.target<>b.target THEN 'RENAMED' END AS change
  FROM map1 a FULL JOIN map1_v2 b USING (kind, owner, name, "desc"))"""


@query(with_views("map1 map1_v2", _MAP_DIFF + " SELECT * FROM d WHERE change IS NOT NULL"))
def mapping_diff(spark, sf):
    return M.mapping_diff(T.mapping_first(spark, sf), T.mapping_updated(spark, sf))


@query(with_views("map1 map1_v2", _MAP_DIFF + " SELECT " + ", ".join(
    f"count(*) FILTER (WHERE kind='{k}' AND change='{c}') AS {k}_{c.lower()}" for k in ("class", "field", "method") for c in ("ADDED", "REMOVED", "RENAMED")
) + ", count(*) AS total_changes FROM d WHERE change IS NOT NULL"))
def mapping_diff_counts(spark, sf):
    return M.mapping_diff_counts(M.mapping_diff(T.mapping_first(spark, sf), T.mapping_updated(spark, sf)))


@query(with_views("map1 map2", """WITH c1 AS (SELECT owner, target FROM map1 WHERE kind='class'), c2 AS (SELECT owner, target FROM map2 WHERE kind='class')
  SELECT 'class' AS kind, c1.owner, '' AS name, '' AS "desc", coalesce(c2.target, c1.target) AS target FROM c1 LEFT JOIN c2 ON c2.owner=c1.target
  UNION ALL SELECT 'class', owner, '', '', target FROM c2 WHERE owner NOT IN (SELECT owner FROM c1) AND owner NOT IN (SELECT target FROM c1)
  UNION ALL SELECT m.kind, m.owner, m.name, m."desc", coalesce(s.target, m.target) FROM map1 m LEFT JOIN c1 ON c1.owner=m.owner
   LEFT JOIN map2 s ON s.kind=m.kind AND s.owner=coalesce(c1.target,m.owner) AND s.name=m.target AND s."desc"=m."desc" WHERE m.kind<>'class'"""))
def mapping_compose(spark, sf):
    return M.compose(T.mapping_first(spark, sf), T.mapping_second(spark, sf))


@query(with_views("map1", """WITH c AS (SELECT owner, target FROM map1 WHERE kind='class'), rev AS (SELECT target AS t, min(owner) AS back FROM c GROUP BY 1 HAVING count(*)=1)
  SELECT 'class' AS kind, t AS owner, '' AS name, '' AS "desc", back AS target FROM rev
  UNION ALL SELECT m.kind, coalesce(rev.back, m.owner), m.target, m."desc", min(m.name) FROM map1 m LEFT JOIN c ON c.owner=m.owner LEFT JOIN rev ON rev.t=coalesce(c.target,m.owner)
  WHERE m.kind<>'class' GROUP BY 1,2,3,4"""))
def mapping_invert(spark, sf):
    return M.invert(T.mapping_first(spark, sf))


@query(with_views("map1", "SELECT kind, count(*) AS n FROM map1 GROUP BY 1"))
def mapping_counts(spark, sf):
    return M.mapping_counts(T.mapping_first(spark, sf))


@query(with_views("map1 map2", """SELECT a.kind, a.owner, a.name, a."desc", coalesce(b.target, CASE WHEN a.kind='class' THEN a.owner ELSE a.name END) AS target
  FROM map1 a LEFT JOIN map2 b USING (kind, owner, name, "desc")"""))
def mapping_lookup(spark, sf):
    items = T.mapping_first(spark, sf).select(*M.ITEM)
    return M.lookup(items, T.mapping_second(spark, sf))


def _corpus_mapping(spark, sf):
    """Renames for the corpus' own classes and members."""
    k = F.col("p_partkey")
    c = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    blank = F.lit("")
    name = T.class_name(k)
    rows = T._mapping_rows(
        T.read(spark, sf, "part"),
        [
            ("class", F.when(k % 2 == 0, name).otherwise(c("none/", k)), blank, blank, c("x/N", k)),
            ("method", name, c("m", k % 7 + 1), F.lit("()V"), c("r", k)),
            ("field", name, c("f", k % 7 + 1), F.when(k % 3 == 0, "I").otherwise(""), c("g", k)),
        ],
    )
    interface = T._mapping_rows(
        T.read(spark, sf, "region"), [("class", F.concat(F.lit("i/Brand#"), F.col("r_regionkey").cast("string")), blank, blank, c("y/I", F.col("r_regionkey")))]
    )
    return rows.unionByName(interface)


_CM = f"""cm AS (SELECT {cls('p_partkey')} AS owner, 'x/N'||p_partkey AS target FROM part WHERE p_partkey%2=0 UNION ALL SELECT 'i/Brand#'||r_regionkey, 'y/I'||r_regionkey FROM region),
  mm AS (SELECT {cls('p_partkey')} AS owner, 'm'||(p_partkey%7+1) AS name, 'r'||p_partkey AS target FROM part),
  fm AS (SELECT {cls('p_partkey')} AS owner, 'f'||(p_partkey%7+1) AS name, 'g'||p_partkey AS target FROM part)"""


@query(with_views("classes", f"""WITH {_CM} SELECT coalesce(c1.target, internal_name) AS internal_name, coalesce(c2.target, super_name) AS super_name, coalesce(c3.target, interface) AS interfaces
  FROM classes LEFT JOIN cm c1 ON c1.owner=internal_name LEFT JOIN cm c2 ON c2.owner=super_name LEFT JOIN cm c3 ON c3.owner=interface"""))
def mapping_apply_classes(spark, sf):
    out = M.Renamer(_corpus_mapping(spark, sf)).apply_classes(T.classes(spark, sf))
    return out.select("internal_name", "super_name", F.concat_ws(",", "interfaces").alias("interfaces"))


@query(with_views("call_sites", f"""WITH {_CM} SELECT coalesce(c1.target, in_class) AS in_class, coalesce(m1.target, in_method) AS in_method, kind, coalesce(c2.target, target_owner) AS target_owner,
   coalesce(m2.target, f2.target, target_name) AS target_name, target_desc, line
  FROM call_sites LEFT JOIN cm c1 ON c1.owner=in_class LEFT JOIN mm m1 ON m1.owner=in_class AND m1.name=in_method LEFT JOIN cm c2 ON c2.owner=target_owner
   LEFT JOIN mm m2 ON m2.owner=target_owner AND m2.name=target_name LEFT JOIN fm f2 ON f2.owner=target_owner AND f2.name=target_name"""))
def mapping_apply_sites(spark, sf):
    out = M.Renamer(_corpus_mapping(spark, sf)).apply_call_sites(T.call_sites(spark, sf))
    return out.select("in_class", "in_method", "kind", "target_owner", "target_name", "target_desc", "line")


@query(with_views("classes", f"""WITH {_CM} SELECT internal_name, '(L'||coalesce(c1.target, internal_name)||';I[L'||coalesce(c2.target, super_name)||';)V' AS "desc"
  FROM classes LEFT JOIN cm c1 ON c1.owner=internal_name LEFT JOIN cm c2 ON c2.owner=super_name"""))
def descriptor_remap(spark, sf):
    desc = F.concat(F.lit("(L"), "internal_name", F.lit(";I[L"), "super_name", F.lit(";)V"))
    rows = T.classes(spark, sf).select("internal_name", desc.alias("desc"))
    return M.Renamer(_corpus_mapping(spark, sf)).descriptor_column(rows, "desc")


@query(with_views("classes call_methods fields_a", r"""SELECT 'class' AS kind, internal_name AS owner, '' AS name, '' AS "desc", package_name||'/'||regexp_replace(simple_name,'([0-9])9','x\1','g') AS target FROM classes WHERE regexp_matches(simple_name,'[0-9]9')
  UNION ALL SELECT 'method', owner, name, "desc", regexp_replace(name,'([0-9])9','x\1','g') FROM call_methods WHERE regexp_matches(name,'[0-9]9')
  UNION ALL SELECT 'field', owner, name, "desc", regexp_replace(name,'([0-9])9','x\1','g') FROM fields_a WHERE regexp_matches(name,'[0-9]9')"""))
def mass_rename(spark, sf):
    out = M.mass_rename(T.classes(spark, sf), T.call_methods(spark, sf), T.version_fields(spark, sf, "A"), "([0-9])9", "x$1")
    return out.drop("archive_id")


# --- mapping files -----------------------------------------------------------------------------

_DESC = "(La/B;I)V"


def _format_lines(spark, sf):
    """Lines of a mapping file per format, three per part; odd parts nest in the nested format."""
    k = F.col("p_partkey")
    s = k.cast("string")
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    obf, named, new_f, new_m = c("p/C", s), c("q/N", s), c("g", s), c("n", s)
    dot_obf, dot_named = c("p.C", s), c("q.N", s)
    ind = F.when(k % 2 == 1, "\t").otherwise("")
    texts = {
        "PROGUARD": [c(dot_named, " -> ", dot_obf, ":"), c("    int ", new_f, " -> f"), c("    12:15:void ", new_m, "(a.B,int) -> m")],
        "TINY_V1": [c("CLASS\t", obf, "\t", named), c("FIELD\t", obf, "\tI\tf\t", new_f), c("METHOD\t", obf, f"\t{_DESC}\tm\t", new_m)],
        "TINY_V2": [c("c\t", obf, "\t", named), c("\tf\tI\tf\t", new_f), c(f"\tm\t{_DESC}\tm\t", new_m)],
        "SRG": [c("CL: ", obf, " ", named), c("FD: ", obf, "/f ", named, "/", new_f), c("MD: ", obf, f"/m {_DESC} ", named, "/", new_m, f" {_DESC}")],
        "XSRG": [c("CL: ", obf, " ", named), c("FD: ", obf, "/f I ", named, "/", new_f, " I"), c("MD: ", obf, f"/m {_DESC} ", named, "/", new_m, f" {_DESC}")],
        "TSRG": [c(obf, " ", named), c("\tf ", new_f), c(f"\tm {_DESC} ", new_m)],
        "TSRG_V2": [c(obf, " ", named), c("\tf ", new_f), c(f"\tm {_DESC} ", new_m)],
        "CSRG": [c(obf, " ", named), c(obf, " f ", new_f), c(obf, f" m {_DESC} ", new_m)],
        "JOBF": [c(".class_map ", dot_obf, " ", dot_named), c(".field_map ", dot_obf, ".f ", new_f), c(".method_map ", dot_obf, f".m{_DESC} ", new_m)],
        "ENIGMA": [
            F.when(k % 2 == 1, c("\tCLASS C", s, " N", s)).otherwise(c("CLASS ", obf, " ", named)),
            c(ind, "\tFIELD f ", new_f, " I"), c(ind, "\tMETHOD m ", new_m, f" {_DESC}"),
        ],
        "RECAF": [c(obf, ".f ", new_f), c(obf, " ", named), c(obf, f".m{_DESC} ", new_m)],
    }
    line = lambda fmt, i, text: F.struct(
        F.lit(fmt).alias("mapping_id"), F.lit(fmt).alias("format"), (k * 3 + i).cast("long").alias("line_no"), text.alias("line")
    )
    rows = F.array(*[line(fmt, i, t) for fmt, ts in texts.items() for i, t in enumerate(ts)])
    # Keys are few bytes, the lines of a key many: keys are spread before their lines are made.
    tasks = max(spark.sparkContext.defaultParallelism, T.part_count(spark, sf) // 20_000)
    keys = T.read(spark, sf, "part").select("p_partkey").repartition(tasks, "p_partkey")
    body = keys.select(F.explode(rows).alias("r")).select("r.*")
    heads = F.array(*[line(fmt, -1, F.lit(text)) for fmt, text in MF.HEADERS.items()])
    head = T.read(spark, sf, "part").filter(k == 0).select(F.explode(heads).alias("r")).select("r.*")
    return body.unionByName(head)


_FMT = "(VALUES " + ",".join(f"('{f}')" for f in MF.FORMATS) + ") t(fmt)"
_OWN = "CASE WHEN fmt='ENIGMA' AND p_partkey%2=1 THEN 'p/C'||(p_partkey-1)||'$C'||p_partkey ELSE 'p/C'||p_partkey END"
_NAMED = "CASE WHEN fmt='ENIGMA' AND p_partkey%2=1 THEN 'q/N'||(p_partkey-1)||'$N'||p_partkey ELSE 'q/N'||p_partkey END"


@query(f"""WITH x AS (SELECT fmt AS mapping_id, {_OWN} AS owner, {_NAMED} AS named, p_partkey AS k, fmt FROM part, {_FMT})
  SELECT mapping_id, 'class' AS kind, owner, '' AS name, '' AS "desc", named AS target FROM x
  UNION ALL SELECT mapping_id, 'field', owner, 'f', CASE WHEN fmt IN ('PROGUARD','TINY_V1','TINY_V2','XSRG','ENIGMA') THEN 'I' ELSE '' END, 'g'||k FROM x
  UNION ALL SELECT mapping_id, 'method', owner, 'm', '{_DESC}', 'n'||k FROM x""")
def mapping_parse(spark, sf):
    return MF.parse_mapping_lines(_format_lines(spark, sf))


@query("SELECT fmt AS mapping_id, CASE WHEN fmt='CSRG' THEN 'TSRG' ELSE fmt END AS format FROM " + _FMT)
def mapping_detect(spark, sf):
    return MF.detect_formats(_format_lines(spark, sf).drop("format"))


def _write_sql() -> str:
    cls_ = "kind='class'"
    fld = "kind='field'"
    t = "chr(9)"
    own = "coalesce(n, owner)"
    expr = {
        "TINY_V1": f"CASE WHEN {cls_} THEN 'CLASS'||{t}||owner||{t}||target ELSE CASE WHEN {fld} THEN 'FIELD' ELSE 'METHOD' END||{t}||owner||{t}||\"desc\"||{t}||name||{t}||target END",
        "TINY_V2": f"CASE WHEN {cls_} THEN 'c'||{t}||owner||{t}||target ELSE {t}||CASE WHEN {fld} THEN 'f' ELSE 'm' END||{t}||\"desc\"||{t}||name||{t}||target END",
        "SRG": f"CASE WHEN {cls_} THEN 'CL: '||owner||' '||target WHEN {fld} THEN 'FD: '||owner||'/'||name||' '||{own}||'/'||target ELSE 'MD: '||owner||'/'||name||' '||\"desc\"||' '||{own}||'/'||target||' '||\"desc\" END",
        "XSRG": f"CASE WHEN {cls_} THEN 'CL: '||owner||' '||target WHEN {fld} THEN 'FD: '||owner||'/'||name||' '||\"desc\"||' '||{own}||'/'||target||' '||\"desc\" ELSE 'MD: '||owner||'/'||name||' '||\"desc\"||' '||{own}||'/'||target||' '||\"desc\" END",
        "TSRG": f"CASE WHEN {cls_} THEN owner||' '||target WHEN {fld} THEN {t}||name||' '||target ELSE {t}||name||' '||\"desc\"||' '||target END",
        "CSRG": f"CASE WHEN {cls_} THEN owner||' '||target WHEN {fld} THEN owner||' '||name||' '||target ELSE owner||' '||name||' '||\"desc\"||' '||target END",
        "JOBF": f"CASE WHEN {cls_} THEN '.class_map '||owner||' '||target WHEN {fld} THEN '.field_map '||owner||'.'||name||' '||target ELSE '.method_map '||owner||'.'||name||\"desc\"||' '||target END",
        "ENIGMA": f"CASE WHEN {cls_} THEN 'CLASS '||owner||' '||target ELSE {t}||CASE WHEN {fld} THEN 'FIELD ' ELSE 'METHOD ' END||name||' '||target||' '||\"desc\" END",
        "RECAF": f"CASE WHEN {cls_} THEN owner||' '||target WHEN {fld} THEN owner||'.'||name||' '||target ELSE owner||'.'||name||\"desc\"||' '||target END",
        "PROGUARD": f"CASE WHEN {cls_} THEN target||' -> '||owner||':' WHEN {fld} THEN '    int '||target||' -> '||name ELSE '    void '||target||'() -> '||name END",
    }
    expr["TSRG_V2"] = expr["TSRG"]
    parts = []
    for fmt, e in expr.items():
        src = "m"
        if fmt in ("TINY_V2", "TSRG", "TSRG_V2", "ENIGMA"):
            src = "(SELECT * FROM m UNION ALL SELECT DISTINCT 'class', owner, '', '', owner, NULL FROM m WHERE n IS NULL)"
        cond = "n IS NOT NULL" if fmt == "PROGUARD" else "true"
        parts.append(f"SELECT '{fmt}' AS format, {e} AS line FROM {src} WHERE {cond}")
    for fmt, text in MF.HEADERS.items():
        parts.append(f"SELECT '{fmt}', '" + text.replace("\t", "'||chr(9)||'") + "'")
    return with_views("map1", """WITH r AS (SELECT * FROM map1 WHERE kind<>'class' OR CAST(substr(owner,2) AS BIGINT)%5<>0), m AS (SELECT r.*, c.target AS n FROM r LEFT JOIN r c ON c.kind='class' AND c.owner=r.owner) """ + " UNION ALL ".join(parts))


@query(_write_sql())
def mapping_write(spark, sf):
    key = F.substring("owner", 2, 20).cast("long")
    mapping = T.mapping_first(spark, sf).filter((F.col("kind") != "class") | (key % 5 != 0))
    each = [MF.mapping_lines(mapping, f).select(F.lit(f).alias("format"), "line") for f in MF.FORMATS]
    return reduce(DataFrame.unionByName, each)
