"""Pattern, detector and decryptor queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.operators import decrypt as C
from codelode.operators import detect as K
from codelode.operators import patterns as P
from codelode.plans.registry import query
from codelode.plans.sqlviews import with_views
from codelode.sources import tables as T

KEY = ["archive_id", "owner", "name", "desc"]


def _counted_methods(spark, sf) -> DataFrame:
    insns = T.instructions(spark, sf)
    counts = P.method_counts(insns, T.code_try_catch(spark, sf, insns))
    return T.code_methods(spark, sf).join(counts, KEY, "left")


def _corpus(spark, sf) -> P.Corpus:
    methods = _counted_methods(spark, sf)
    fields = T.code_fields(spark, sf).withColumn(
        "name", F.when(F.col("access") == 9, F.concat(F.lit("apiToken_"), "name")).otherwise(F.col("name"))
    )
    counted = lambda m, alias: m.groupBy("archive_id", F.col("owner").alias("internal_name")).agg(F.count("*").alias(alias))
    key = ["archive_id", "internal_name"]
    classes = (
        T.code_headers(spark, sf)
        .join(counted(T.code_methods(spark, sf), "method_count"), key, "left")
        .join(counted(fields, "field_count"), key, "left")
    )
    return P.Corpus(classes, methods, fields, T.instructions(spark, sf), T.code_annotations(spark, sf))


@query(with_views("method_counts", 'SELECT * FROM method_counts'))
def method_counts(spark, sf):
    insns = T.instructions(spark, sf)
    return P.method_counts(insns, T.code_try_catch(spark, sf, insns))


_VIEWS = "instructions code_methods method_counts code_fields code_headers code_annotations"
_PRE = """WITH f AS (SELECT * REPLACE (CASE WHEN access=9 THEN 'apiToken_'||name ELSE name END AS name) FROM code_fields),
  m AS (SELECT c.*, coalesce(real_count,0)+coalesce(jump_label_count,0) AS insns FROM code_methods c LEFT JOIN method_counts USING (archive_id, owner, name, "desc")),
  cl AS (SELECT h.*, (SELECT count(*) FROM code_methods x WHERE x.archive_id=h.archive_id AND x.owner=h.internal_name) AS nm, (SELECT count(*) FROM f WHERE f.archive_id=h.archive_id AND f.owner=h.internal_name) AS nf FROM code_headers h),
  i AS (SELECT archive_id, owner, method AS name, "desc", * EXCLUDE (archive_id, owner, method, "desc") FROM instructions)"""
_M = """SELECT DISTINCT '{n}' AS pattern, archive_id, 'METHOD' AS kind, replace(owner,'/','.') AS class_name, name AS member, "desc" FROM m WHERE EXISTS (SELECT 1 FROM i WHERE i.archive_id=m.archive_id AND i.owner=m.owner AND i.name=m.name AND i."desc"=m."desc" AND {c}) {more}"""
_call = lambda *xs: "(opcode BETWEEN 182 AND 185 AND ref_owner||'.'||ref_name IN (" + ",".join(f"'{x}'" for x in xs) + "))"


@query(with_views(_VIEWS, _PRE + " " + " UNION ALL ".join([
    _M.format(n="println callers", c=_call("java/io/PrintStream.println"), more=""),
    """SELECT DISTINCT 'secret-named fields', c.archive_id, 'CLASS', replace(internal_name,'/','.'), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM cl c JOIN f ON f.archive_id=c.archive_id AND f.owner=c.internal_name WHERE f.name LIKE 'apiToken%'""",
    _M.format(n="native loaders", c=_call("java/lang/Runtime.loadLibrary", "java/lang/System.loadLibrary", "java/lang/System.load"), more=""),
    _M.format(n="big switch", c="opcode=170", more="AND insns>200"),
    _M.format(n="hardcoded urls", c="opcode=18 AND const_str LIKE 'https://%'", more=""),
    _M.format(n="crypto", c=_call("java/security/MessageDigest.getInstance"), more=""),
    _M.format(n="process start", c=_call("java/lang/Runtime.exec"), more=""),
    _M.format(n="exit callers", c=_call("java/lang/System.exit"), more=""),
])))
def pattern_library(spark, sf):
    return P.evaluate_all(_corpus(spark, sf), P.library())


def _nested(q: str) -> str:
    hit = "(access&8<>0 OR insns>=40)"
    cond = {"any": "h>0", "all": "t>0 AND h=t", "none": "h=0"}[q]
    return with_views(_VIEWS, _PRE + f""", g AS (SELECT cl.archive_id, cl.internal_name, cl.access, count(m.owner) AS t, count(*) FILTER (WHERE m.owner IS NOT NULL AND {hit.replace('access', 'm.access')}) AS h
      FROM cl LEFT JOIN m ON m.archive_id=cl.archive_id AND m.owner=cl.internal_name GROUP BY ALL)
      SELECT archive_id, replace(internal_name,'/','.') AS class_name FROM g WHERE access&1<>0 AND {cond}""")


def _nested_plan(spark, sf, quantifier):
    inner = P.access("static") | P.count("instructions", ">=", 40)
    found = P.evaluate(_corpus(spark, sf), "class", P.access("public"), P.Nested(quantifier, "method", [inner]))
    return found.select("archive_id", "class_name")


@query(_nested("any"))
def pattern_nested_any(spark, sf):
    return _nested_plan(spark, sf, "any")


@query(_nested("all"))
def pattern_nested_all(spark, sf):
    return _nested_plan(spark, sf, "all")


@query(_nested("none"))
def pattern_nested_none(spark, sf):
    return _nested_plan(spark, sf, "none")


@query(with_views(_VIEWS, _PRE + """, c AS (SELECT archive_id, owner, name, "desc", bool_or(opcode=178 AND ref_name LIKE 'f1%') AS a, bool_or(opcode=187 AND ref_owner='java/lang/Thread') AS b,
    bool_or(opcode=18 AND (const_long=7 OR const_str='lit7')) AS d, bool_or(opcode=167) AS e, bool_or(opcode=18) AS g FROM i GROUP BY ALL)
  SELECT m.archive_id, replace(m.owner,'/','.') AS class_name, m.name AS member, m."desc" FROM m JOIN c USING (archive_id, owner, name, "desc") WHERE a AND (b OR d) AND NOT e AND g AND "desc" LIKE '%String%' AND name<>'q3'"""))
def pattern_contains_many(spark, sf):
    found = P.evaluate(
        _corpus(spark, sf), "method",
        P.contains(P.field_access("getstatic", P.ANY, P.regex("^f1"))),
        P.contains(P.new("java.lang.Thread")) | P.contains(P.ldc(P.regex("^(7|lit7)$"))),
        ~P.contains(P.opcode("GOTO")), P.contains(P.opcode("opcode_18")), P.desc(P.regex("String")), ~P.name("q3"),
    )
    return found.select("archive_id", "class_name", "member", "desc")


@query(with_views(_VIEWS, _PRE + """SELECT 'class' AS what, replace(internal_name,'/','.') AS class_name, CAST(NULL AS VARCHAR) AS member FROM cl
   WHERE (nm>=4 OR nf<>0) AND (super_name LIKE 'k1/%' OR interface LIKE 'i/Brand#1%') AND internal_name IN (SELECT owner FROM code_annotations a WHERE target_kind='class' AND "desc" LIKE '%kotlin%')
  UNION ALL SELECT 'method', replace(owner,'/','.'), name FROM m WHERE (archive_id, owner, name, "desc") IN (SELECT archive_id, owner, member, member_desc FROM code_annotations WHERE target_kind='method' AND "desc"='La/Test;')
  UNION ALL SELECT 'field', replace(owner,'/','.'), name FROM f WHERE access&16<>0 AND NOT contains(name,'9')""".replace("SELECT 'class'", " SELECT 'class'", 1)))
def pattern_headers(spark, sf):
    corpus = _corpus(spark, sf)
    classes = P.evaluate(
        corpus, "class", P.count("methods", ">=", 4) | P.count("fields", "!=", 0),
        P.extends(P.regex("^k1/")) | P.implements(P.regex("^i/Brand#1")), P.annotated(P.regex("kotlin")),
    )
    methods = P.evaluate(corpus, "method", P.annotated("La/Test;"))
    # A predicate that does not apply is false, so its negation holds.
    fields = P.evaluate(corpus, "field", P.access("final"), ~P.name(P.regex("9")), ~P.count("methods", ">", 0))
    tag = lambda df, what: df.select(F.lit(what).alias("what"), "class_name", "member")
    return tag(classes, "class").unionByName(tag(methods, "method")).unionByName(tag(fields, "field"))


# --- detectors ---------------------------------------------------------------------------------

_FEATURES = r"""WITH cf AS (SELECT archive_id, count(*) AS class_count, count(*) FILTER (WHERE length(simple_name)<=2 AND regexp_matches(simple_name,'^[a-zA-Z]+$')) AS short_named,
    count(*) FILTER (WHERE regexp_matches(simple_name,'^[IlL1]{4,}$')) AS lookalike_named, count(*) FILTER (WHERE length(simple_name)>20 AND regexp_matches(simple_name,'^[IlO01]+$')) AS long_confusable_named,
    count(*) FILTER (WHERE regexp_matches(simple_name,'[^\x00-\x7F]')) AS unicode_named, count(DISTINCT CASE WHEN contains(internal_name,'StringerHelper') THEN internal_name END) AS stringer_classes FROM code_classes GROUP BY 1),
  bodies AS (SELECT archive_id, owner, method AS name, "desc", count(*) AS nodes, bool_or(opcode=130) AS mixes, bool_or(opcode=183) AS mk, coalesce(max(switch_cases),0) AS cases FROM instructions GROUP BY ALL),
  mf0 AS (SELECT m.archive_id, m.owner, access&256<>0 AS nat, access&8<>0 AND "desc"<>'()V' AND coalesce(nodes,0) BETWEEN 8 AND 400 AND coalesce(mixes AND mk,false) AS dec, coalesce(cases,0)>50 AS big FROM code_methods m LEFT JOIN bodies USING (archive_id, owner, name, "desc")),
  mf AS (SELECT archive_id, count(DISTINCT CASE WHEN nat THEN owner END) AS native_classes, count(*) FILTER (WHERE dec) AS decryptors, count(*) FILTER (WHERE big) AS big_switches FROM mf0 GROUP BY 1),
  lit AS (SELECT archive_id, const_str AS s, count(*) AS n FROM instructions WHERE const_kind='string' GROUP BY 1,2),
  ch AS (SELECT s, unicode(c)&255 AS b, count(*) AS k FROM (SELECT s, unnest(string_split(s,'')) AS c FROM (SELECT DISTINCT s FROM lit)) GROUP BY 1,2),
  en AS (SELECT s, sum(-(k/length(s))*log2(k/length(s)) ORDER BY b) AS e FROM ch GROUP BY 1),
  lf AS (SELECT archive_id, CAST(sum(n) AS BIGINT) AS literals, CAST(sum(CASE WHEN e>=4.5 AND length(s)>=8 THEN n ELSE 0 END) AS BIGINT) AS encrypted_literals, sum(floor(e*1000)*n)/sum(n)/1000.0 AS average_entropy FROM lit JOIN en USING (s) GROUP BY 1),
  df AS (SELECT archive_id, count(*) AS dynamic_sites, count(DISTINCT CASE WHEN contains(bsm_owner,'stringer') OR contains(bsm_owner,'licel') THEN bsm_owner END) AS stringer_bootstraps FROM instructions WHERE opcode=186 GROUP BY 1),
  rf AS (SELECT archive_id, bool_or(contains(path,'META-INF/proguard')) AS proguard_config, bool_or(contains(path,'mapping.txt')) AS mapping_file, bool_or(contains(path,'ALLATORI')) AS allatori_file,
    bool_or(contains(path,'yguard')) AS yguard_file, bool_or(contains(path,'natives/')) AS natives_layout, count(*) FILTER (WHERE path LIKE '%.dll') AS dlls, count(*) FILTER (WHERE path LIKE '%.so') AS sos FROM code_resources GROUP BY 1),
  vf AS (SELECT archive_id, count(*) AS variables, count(*) FILTER (WHERE name LIKE 'arg%') AS arg_n_variables FROM code_local_vars GROUP BY 1),
  ft AS (SELECT * FROM cf JOIN mf USING (archive_id) JOIN lf USING (archive_id) JOIN df USING (archive_id) JOIN rf USING (archive_id) JOIN vf USING (archive_id))"""
_FCOLS = (
    "class_count short_named lookalike_named long_confusable_named unicode_named stringer_classes native_classes decryptors big_switches "
    "literals encrypted_literals dynamic_sites stringer_bootstraps proguard_config mapping_file allatori_file yguard_file natives_layout dlls sos variables arg_n_variables"
).split()
_DV = "code_classes code_methods instructions code_resources code_local_vars"


def _features(spark, sf):
    insns = T.instructions(spark, sf)
    return K.archive_features(
        T.code_classes(spark, sf), T.code_methods(spark, sf), insns, T.code_try_catch(spark, sf, insns),
        T.code_resources(spark, sf), T.code_local_vars(spark, sf),
    )


@query(with_views(_DV, _FEATURES + " SELECT archive_id, round(average_entropy,6) AS average_entropy, " + ", ".join(_FCOLS) + " FROM ft"))
def detector_features(spark, sf):
    return _features(spark, sf).select("archive_id", F.round("average_entropy", 6).alias("average_entropy"), *_FCOLS)


_SCORES = _FEATURES + """, r AS (SELECT *, short_named/class_count AS rs, lookalike_named/class_count AS rl, long_confusable_named/class_count AS rc, unicode_named/class_count AS ru, dlls+sos AS libs, arg_n_variables/variables AS av FROM ft),
  s AS (SELECT archive_id, unnest([
    {'p': 0, 'name': 'ProGuard / R8', 'c': (CASE WHEN rs>0.25e0 THEN least(0.6e0,rs) ELSE 0 END + CASE WHEN proguard_config THEN 0.35e0 ELSE 0 END + CASE WHEN mapping_file THEN 0.2e0 ELSE 0 END)::DOUBLE, 'e': CAST(rs>0.25e0 AS INT)+CAST(proguard_config AS INT)+CAST(mapping_file AS INT)},
    {'p': 1, 'name': 'ZKM (Zelix KlassMaster)', 'c': (CASE WHEN rl>0.15e0 THEN least(0.55e0,rl*1.3e0) ELSE 0 END + CASE WHEN decryptors>=5 THEN least(0.35e0,decryptors/80.0) ELSE 0 END + CASE WHEN big_switches>0 THEN least(0.25e0,big_switches/40.0) ELSE 0 END + CASE WHEN average_entropy>5.5 AND literals>50 THEN 0.15e0 ELSE 0 END)::DOUBLE,
      'e': CAST(rl>0.15e0 AS INT)+CAST(decryptors>=5 AS INT)+CAST(big_switches>0 AS INT)+CAST(average_entropy>5.5 AND literals>50 AS INT)},
    {'p': 2, 'name': 'Allatori', 'c': (CASE WHEN rc>0.1e0 THEN least(0.6e0,rc*1.5e0) ELSE 0 END + CASE WHEN allatori_file THEN 0.4e0 ELSE 0 END + CASE WHEN ru>0.15e0 AND ru<0.9e0 THEN 0.2e0 ELSE 0 END)::DOUBLE, 'e': CAST(rc>0.1e0 AS INT)+CAST(allatori_file AS INT)+CAST(ru>0.15e0 AND ru<0.9e0 AS INT)},
    {'p': 3, 'name': 'native-obfuscator (radioegor146)', 'c': (CASE WHEN natives_layout THEN 1.0e0 ELSE NULL END * (CASE WHEN libs>0 THEN least(0.25e0,libs/12.0) ELSE 0 END + 0.5e0 + CASE WHEN native_classes>0 THEN least(0.15e0,native_classes/60.0) ELSE 0 END))::DOUBLE,
      'e': CAST(libs>0 AS INT)+CAST(natives_layout AS INT)+CAST(native_classes>0 AS INT)},
    {'p': 4, 'name': 'Stringer (Licel)', 'c': (CASE WHEN stringer_classes>0 THEN 0.6e0 ELSE 0 END + CASE WHEN stringer_bootstraps>0 THEN 0.4e0 ELSE 0 END + CASE WHEN dynamic_sites>50 AND encrypted_literals>20 THEN 0.2e0 ELSE 0 END)::DOUBLE,
      'e': CAST(stringer_classes>0 AS INT)+CAST(stringer_bootstraps>0 AS INT)+CAST(dynamic_sites>50 AND encrypted_literals>20 AS INT)},
    {'p': 5, 'name': 'Skidfuscator', 'c': (CASE WHEN big_switches>10 AND dynamic_sites>30 THEN 0.15e0 ELSE 0 END)::DOUBLE, 'e': CAST(big_switches>10 AND dynamic_sites>30 AS INT)},
    {'p': 6, 'name': 'Paramorphism', 'c': (CASE WHEN variables>50 AND av>0.4e0 THEN least(0.7e0,av) ELSE 0 END)::DOUBLE, 'e': CAST(variables>50 AND av>0.4e0 AS INT)},
    {'p': 7, 'name': 'Binscure', 'c': 0::DOUBLE, 'e': 0}, {'p': 8, 'name': 'Caesium', 'c': 0::DOUBLE, 'e': 0}, {'p': 9, 'name': 'QProtect', 'c': 0::DOUBLE, 'e': 0}, {'p': 10, 'name': 'DashO', 'c': 0::DOUBLE, 'e': 0},
    {'p': 11, 'name': 'yGuard', 'c': (CASE WHEN yguard_file THEN 0.7e0 ELSE 0 END)::DOUBLE, 'e': CAST(yguard_file AS INT)}]) AS d,
    (CASE WHEN libs>0 THEN least(0.25e0,libs/12.0) ELSE 0 END + CASE WHEN native_classes>0 THEN least(0.15e0,native_classes/60.0) ELSE 0 END)::DOUBLE AS soft FROM r),
  o AS (SELECT archive_id, d.p AS position, d.name AS name, d.e AS evidence_count, greatest(0,least(1,coalesce(d.c, least(0.4e0,soft)))) AS confidence FROM s)"""


@query(with_views(_DV, _SCORES + """ SELECT archive_id, CAST(position AS INT) AS position, name, CAST(evidence_count AS INT) AS evidence_count, round(confidence,6) AS confidence,
  CASE WHEN confidence>=0.7 THEN 'HIGH' WHEN confidence>=0.3 THEN 'MEDIUM' WHEN confidence>0 THEN 'LOW' ELSE 'NONE' END AS level FROM o"""))
def detector_scores(spark, sf):
    d = K.detect(_features(spark, sf))
    return d.select("archive_id", "position", "name", F.size("evidence").alias("evidence_count"), F.round("confidence", 6).alias("confidence"), "level")


@query(with_views(_DV, _SCORES + """ SELECT archive_id, name, round(confidence,6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY confidence DESC, position) AS k FROM o WHERE confidence>0) WHERE k=1"""))
def detector_top(spark, sf):
    return K.top_detection(K.detect(_features(spark, sf))).select("archive_id", "name", F.round("confidence", 6).alias("confidence"))


@query(with_views(_DV, _SCORES + """ SELECT archive_id, name, round(confidence,6) AS confidence, CASE WHEN confidence>=0.7 THEN 'HIGH' WHEN confidence>=0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM o WHERE confidence>0"""))
def detector_report(spark, sf):
    return K.ranked(K.detect(_features(spark, sf))).select("archive_id", "name", F.round("confidence", 6).alias("confidence"), "level")


# --- decryptors --------------------------------------------------------------------------------

_CAND = """WITH pts AS (SELECT archive_id, owner, method AS name, "desc", CAST(sum(CASE WHEN opcode BETWEEN 182 AND 185 THEN (CASE WHEN ref_owner='java/lang/String' THEN 1 WHEN ref_owner='java/lang/StringBuilder' THEN 0 WHEN ref_owner LIKE 'java/%' THEN -1 ELSE -2 END) ELSE 0 END) AS INT) AS p,
   bool_or(opcode=130) AS ar, bool_or(opcode=183) AS mk, bool_or(opcode BETWEEN 182 AND 185 AND (ref_owner LIKE 'java/io/%' OR ref_owner='java/lang/Runtime')) AS bad FROM instructions GROUP BY ALL),
  cand AS (SELECT m.archive_id, m.owner, m.name, m."desc", real_count+jump_label_count AS nodes, p + CASE WHEN ar THEN 3 ELSE 0 END + CASE WHEN mk THEN 2 ELSE 0 END AS score
   FROM code_methods m JOIN method_counts USING (archive_id, owner, name, "desc") JOIN pts USING (archive_id, owner, name, "desc")
   WHERE access&8<>0 AND "desc"<>'()V' AND real_count+jump_label_count BETWEEN 5 AND 600 AND NOT bad AND p + CASE WHEN ar THEN 3 ELSE 0 END + CASE WHEN mk THEN 2 ELSE 0 END > 0)"""


@query(with_views("instructions code_methods method_counts", _CAND + " SELECT * FROM cand"))
def decrypt_candidates(spark, sf):
    return C.decrypt_candidates(_counted_methods(spark, sf), T.instructions(spark, sf))


@query(with_views("instructions code_methods method_counts", """WITH wanted AS (SELECT 'a'||(n%5) AS archive_id, owner, name, "desc" FROM (SELECT DISTINCT owner, name, "desc" FROM code_methods WHERE "desc"<>'()V' AND name<>'q3'), range(5) t(n)),
  i AS (SELECT *, row_number() OVER () AS rid, coalesce(last_value(line IGNORE NULLS) OVER (PARTITION BY archive_id, owner, method, "desc" ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0) AS cur,
    CASE WHEN opcode<0 THEN 's' WHEN const_kind='string' THEN 't' WHEN opcode IN (3,4,16,17) THEN 'p' WHEN opcode=18 THEN 'i' ELSE 'o' END AS k FROM instructions),
  c AS (SELECT i.* FROM i WHERE opcode=184 AND (archive_id, ref_owner, ref_name, ref_desc) IN (SELECT archive_id, owner, name, "desc" FROM wanted)),
  w AS (SELECT c.rid, c.idx AS pos, b.idx, b.k, b.const_str, b.const_long FROM c JOIN i b ON b.archive_id=c.archive_id AND b.owner=c.owner AND b.method=c.method AND b."desc"=c."desc" AND b.idx BETWEEN c.idx-11 AND c.idx-1),
  t7 AS (SELECT rid, arg_max(CASE WHEN k='t' THEN const_str END, idx) AS enc, max(idx) AS tidx FROM (SELECT * FROM w WHERE idx>=pos-7 AND k NOT IN ('s','p')) GROUP BY rid),
  nb AS (SELECT w.rid, arg_max(CASE WHEN w.k IN ('p','i') THEN w.const_long END, w.idx) AS num, max(w.idx) AS mi FROM w JOIN t7 USING (rid) WHERE w.idx<t7.tidx AND w.k<>'s' GROUP BY w.rid),
  firstk AS (SELECT rid, arg_max(k, idx) AS fk FROM (SELECT * FROM t7 JOIN w USING (rid) WHERE w.idx=t7.tidx) GROUP BY rid)
  SELECT c.archive_id, c.owner AS in_class, c.method AS in_method, c."desc" AS in_desc, c.ref_owner AS target_owner, c.ref_name AS target_name, c.ref_desc AS target_desc, CAST(c.cur AS INT) AS line, c.idx, t7.enc AS encrypted,
    CASE WHEN c.ref_desc LIKE '(I%' THEN CAST((SELECT CASE WHEN w.k IN ('p','i') THEN w.const_long END FROM w JOIN nb ON nb.rid=w.rid AND nb.mi=w.idx WHERE w.rid=c.rid) AS INT) END AS int_arg
  FROM c JOIN t7 USING (rid) JOIN firstk USING (rid) WHERE fk='t'"""))
def encrypted_call_sites(spark, sf):
    """Calls of every decryptor-shaped method: here a fifth of real candidates would leave few rows."""
    shaped = T.code_methods(spark, sf).filter((F.col("desc") != "()V") & (F.col("name") != "q3")).select("owner", "name", "desc").distinct()
    wanted = shaped.select(F.explode(F.array(*[F.lit(f"a{i}") for i in range(5)])).alias("archive_id"), "owner", "name", "desc")
    return C.encrypted_call_sites(T.instructions(spark, sf), wanted)
