"""Usage, graph and hierarchy queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from codelode.operators import graph as G
from codelode.operators import hierarchy as H
from codelode.operators import usage as U
from codelode.operators.adjacency import Adjacency
from codelode.plans.registry import query
from codelode.plans.sqlviews import with_views
from codelode.session import shared_folder
from codelode.sources import tables as T

#: Edge tables of this session by what they were made from; a corpus is indexed once and asked often.
_TABLES: dict[tuple, Adjacency] = {}


def _table(spark, sf, kind: str, source: str, make, made=None) -> Adjacency:
    """The stored edge table ``kind`` of a corpus; written anew when files of its ``source`` table change."""
    jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{source}.parquet")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in system.listStatus(root)]
    key = (spark.sparkContext.applicationId, sf, kind, tuple(sorted(seen)))
    if key not in _TABLES:
        _TABLES[key] = Adjacency.build(make(), f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}", made=made)
    return _TABLES[key]


def _class_calls(spark, sf) -> Adjacency:
    return _table(spark, sf, "class_calls", "lineitem", lambda: G.call_edges(T.call_sites(spark, sf), "CLASS"), G.call_ends("CLASS"))


def _method_node_calls(spark, sf) -> Adjacency:
    return _table(spark, sf, "method_node_calls", "lineitem", lambda: G.call_edges(T.call_sites(spark, sf), "METHOD"), G.call_ends("METHOD"))


def _method_calls(spark, sf) -> Adjacency:
    return _table(spark, sf, "method_calls", "lineitem", lambda: G.method_edges(T.call_sites(spark, sf)), G.METHOD_ENDS)


def _types(spark, sf) -> Adjacency:
    return _table(spark, sf, "types", "part", lambda: H.type_edges(H.hierarchy_edges(T.classes(spark, sf))))


SITE_COLS = ["in_class", "in_method", "in_desc", "kind", "target_owner", "target_name", "target_desc", "line"]
SITES = ", ".join(SITE_COLS)
KEYS = "target_owner||'#'||target_name||target_desc"
CALLER = "in_class||'#'||in_method||in_desc"


@query(with_views("instructions classes", """WITH seen AS (
  SELECT *, coalesce(last_value(line IGNORE NULLS) OVER (PARTITION BY archive_id, owner, method, "desc" ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cur
  FROM instructions)
  SELECT archive_id, owner AS in_class, method AS in_method, "desc" AS in_desc,
    CASE opcode WHEN 182 THEN 'INVOKE_VIRTUAL' WHEN 183 THEN 'INVOKE_SPECIAL' WHEN 184 THEN 'INVOKE_STATIC' WHEN 178 THEN 'GETSTATIC' ELSE 'NEW' END AS kind,
    ref_owner AS target_owner, coalesce(ref_name,'') AS target_name, coalesce(ref_desc,'') AS target_desc, CAST(cur AS INT) AS line, CAST(idx AS BIGINT) AS site_idx
  FROM seen WHERE opcode IN (182,183,184,178,187)
  UNION ALL SELECT 'app', internal_name, '<class>', '', 'TYPE_IN_SIGNATURE', super_name, '', '', 0, 0 FROM classes
  UNION ALL SELECT 'app', internal_name, '<class>', '', 'TYPE_IN_SIGNATURE', interface, '', '', 0, 1 FROM classes"""))
def call_site_build(spark, sf):
    return U.build_call_sites(T.instructions(spark, sf), T.classes(spark, sf))


_TWIN = "CAST(regexp_extract({0}, 'C([0-9]+)$', 1) AS BIGINT)%5=0"


@query(with_views("instructions classes", f"""WITH twins AS (
  SELECT archive_id, owner||'.class' AS class_id, owner, method, "desc", idx, opcode, line, ref_owner, ref_name, ref_desc FROM instructions UNION ALL
  SELECT archive_id, 'META-INF/versions/9/'||owner||'.class', owner, method, "desc", idx, opcode, line+1000, ref_owner, ref_name, ref_desc FROM instructions WHERE idx%2=0 AND {_TWIN.format('owner')}),
  seen AS (SELECT *, coalesce(last_value(line IGNORE NULLS) OVER (PARTITION BY archive_id, class_id, method, "desc" ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS cur FROM twins),
  heads AS (SELECT internal_name||'.class' AS class_id, * FROM classes UNION ALL SELECT 'META-INF/versions/9/'||internal_name||'.class', * FROM classes WHERE {_TWIN.format('internal_name')})
  SELECT archive_id, class_id, owner AS in_class, method AS in_method, "desc" AS in_desc,
    CASE opcode WHEN 182 THEN 'INVOKE_VIRTUAL' WHEN 183 THEN 'INVOKE_SPECIAL' WHEN 184 THEN 'INVOKE_STATIC' WHEN 178 THEN 'GETSTATIC' ELSE 'NEW' END AS kind,
    ref_owner AS target_owner, coalesce(ref_name,'') AS target_name, coalesce(ref_desc,'') AS target_desc, CAST(cur AS INT) AS line, CAST(idx AS BIGINT) AS site_idx
  FROM seen WHERE opcode IN (182,183,184,178,187)
  UNION ALL SELECT 'app', class_id, internal_name, '<class>', '', 'TYPE_IN_SIGNATURE', super_name, '', '', 0, 0 FROM heads
  UNION ALL SELECT 'app', class_id, internal_name, '<class>', '', 'TYPE_IN_SIGNATURE', interface, '', '', 0, 1 FROM heads"""))
def call_site_twins(spark, sf):
    return U.build_call_sites(T.twin_instructions(spark, sf), T.twin_classes(spark, sf))


@query(with_views("call_sites", f"SELECT {SITES} FROM call_sites WHERE target_owner='k7/C7' AND target_name='m3' AND target_desc='()V'"))
def usage_method(spark, sf):
    return U.usages_of_member(T.call_sites(spark, sf), "k7/C7", "m3", "()V").select(*SITE_COLS)


@query(with_views("call_sites", f"SELECT {SITES} FROM call_sites WHERE target_owner='k9/C9' AND target_name LIKE 'f%' AND target_desc='I'"))
def usage_field(spark, sf):
    sites = T.call_sites(spark, sf)
    names = [f"f{i}" for i in range(1, 8)]
    parts = [U.usages_of_member(sites, "k9/C9", n, "I").select(*SITE_COLS) for n in names]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(with_views("call_sites", f"SELECT {SITES} FROM call_sites WHERE target_owner='k5/C5'"))
def usage_class(spark, sf):
    return U.usages_of_class(T.call_sites(spark, sf), "k5/C5").select(*SITE_COLS)


@query(with_views("call_sites", f"""SELECT {SITES} FROM call_sites WHERE target_desc='()V' AND (target_owner, target_name) IN
  (SELECT 'k'||(s_suppkey%20)||'/C'||s_suppkey, 'm'||(s_suppkey%7+1) FROM supplier)"""))
def usage_batch(spark, sf):
    k = F.col("s_suppkey")
    targets = T.read(spark, sf, "supplier").select(
        T.class_name(k).alias("target_owner"),
        F.concat(F.lit("m"), (k % 7 + 1).cast("string")).alias("target_name"),
        F.lit("()V").alias("target_desc"),
    )
    return U.usages_of_members(T.call_sites(spark, sf), targets).select(*SITE_COLS)


@query(with_views("call_sites", """SELECT kind, CASE WHEN kind LIKE 'INVOKE%' THEN 'invoke' WHEN kind='GETFIELD' THEN 'read' WHEN kind='PUTSTATIC' THEN 'write' ELSE 'type' END AS family,
  count(*) AS n FROM call_sites GROUP BY 1,2"""))
def usage_kind_families(spark, sf):
    sites = T.call_sites(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))
    return sites.select("kind", U.kind_family(F.col("kind")).alias("family"), "n")


@query(with_views("call_sites", f"SELECT {SITES} FROM call_sites WHERE contains(lower(replace(in_class,'/','.')),'.c12') AND (kind LIKE 'INVOKE%' OR kind='PUTSTATIC')"))
def usage_filter_bar(spark, sf):
    return U.usage_filter(T.call_sites(spark, sf), ".C12", ["invoke", "write"]).select(*SITE_COLS)


@query(with_views("call_sites", """SELECT archive_id, in_class, in_method||in_desc AS in_member, count(*) AS sites,
  count(DISTINCT archive_id||'|'||in_class) AS classes FROM call_sites GROUP BY ROLLUP(archive_id, in_class, in_method||in_desc)"""))
def usage_rollup(spark, sf):
    return U.usage_rollup(T.call_sites(spark, sf))


@query(with_views("classes call_sites", """SELECT archive_id, target_owner, count(*) AS sites FROM call_sites
  WHERE target_owner NOT IN (SELECT internal_name FROM classes WHERE CAST(substr(simple_name,2) AS INT)%3<>0) GROUP BY 1,2"""))
def external_references(spark, sf):
    known = T.classes(spark, sf).filter(F.substring("simple_name", 2, 20).cast("int") % 3 != 0)
    return U.external_references(T.call_sites(spark, sf), known)


@query(with_views("call_sites call_methods classes fields_a", """SELECT DISTINCT archive_id, target_owner AS internal_name,
  coalesce((SELECT max(access) FROM classes c WHERE c.internal_name=s.target_owner AND CAST(substr(c.simple_name,2) AS INT)%3<>0),0) AS access,
  CAST(coalesce((SELECT count(*) FROM call_methods m WHERE m.owner=s.target_owner),0) AS INT) AS method_count,
  CAST(coalesce((SELECT count(*) FROM fields_a f WHERE f.owner=s.target_owner),0) AS INT) AS field_count FROM call_sites s"""))
def class_enrichment(spark, sf):
    nodes = T.call_sites(spark, sf).select("archive_id", F.col("target_owner").alias("internal_name")).distinct()
    known = T.classes(spark, sf).filter(F.substring("simple_name", 2, 20).cast("int") % 3 != 0)
    return U.enrich_classes(nodes, known, T.call_methods(spark, sf), T.version_fields(spark, sf, "A"))


@query(with_views("", r"""WITH sym AS (SELECT s_suppkey AS k, 'Java_k'||(s_suppkey%20)||'_C'||s_suppkey||'_m_1'||s_suppkey||CASE WHEN s_suppkey%2=0 THEN '__ILjava_lang_String_2' ELSE '' END AS symbol FROM supplier
   UNION ALL SELECT s_suppkey, 'Java_x_Y'||s_suppkey||'_pre_0007Apost' FROM supplier UNION ALL SELECT s_suppkey, 'other_'||s_suppkey FROM supplier)
  SELECT 'app' AS archive_id, symbol, CASE WHEN symbol LIKE 'Java\_k%' ESCAPE '\' THEN 'k'||(k%20)||'.C'||k ELSE 'x.Y'||k END AS class_fqn,
   CASE WHEN symbol LIKE 'Java\_k%' ESCAPE '\' THEN 'm_'||k ELSE 'prezpost' END AS method,
   CASE WHEN symbol LIKE 'Java\_k%' ESCAPE '\' AND k%2=0 THEN 'ILjava/lang/String;' END AS "desc",
   symbol LIKE 'Java\_k%' ESCAPE '\' AS matches_workspace_class FROM sym WHERE symbol LIKE 'Java%'"""))
def native_symbol_match(spark, sf):
    k = F.col("s_suppkey").cast("string")
    mangled = F.concat(F.lit("Java_k"), (F.col("s_suppkey") % 20).cast("string"), F.lit("_C"), k, F.lit("_m_1"), k,
                       F.when(F.col("s_suppkey") % 2 == 0, "__ILjava_lang_String_2").otherwise(""))
    symbols = T.read(spark, sf, "supplier").select(
        F.lit("app").alias("archive_id"),
        F.explode(F.array(mangled, F.concat(F.lit("Java_x_Y"), k, F.lit("_pre_0007Apost")), F.concat(F.lit("other_"), k))).alias("symbol"),
    )
    return U.match_native_symbols(symbols, T.classes(spark, sf))


# --- hierarchy ---------------------------------------------------------------------------------


def _seed(spark, sf, *names):
    """Seeds that must exist in the corpus as a class or an interface."""
    wanted = spark.createDataFrame([(T.APP, n) for n in names], "archive_id string, node string")
    return _types(spark, sf).around(wanted, "IN").select("archive_id", F.col("node").alias("internal_name")).distinct()


@query(with_views("edges_h", "SELECT child, parent, edge_kind FROM edges_h"))
def hierarchy_edges(spark, sf):
    return H.hierarchy_edges(T.classes(spark, sf)).drop("archive_id")


@query(with_views("classes", """WITH RECURSIVE up AS (
  SELECT internal_name AS start, internal_name AS node, 0 AS dist FROM classes UNION ALL
  SELECT u.start, c.super_name, u.dist+1 FROM up u JOIN classes c ON c.internal_name=u.node WHERE c.super_name<>c.internal_name)
  SELECT u.start, CAST(max(dist) OVER (PARTITION BY u.start) - dist AS INT) AS level, node,
   CASE WHEN c.access IS NULL THEN 'EXTERNAL' WHEN c.access&8192<>0 THEN 'ANNOTATION' WHEN c.access&512<>0 THEN 'INTERFACE' WHEN c.access&16384<>0 THEN 'ENUM'
    WHEN c.access&65536<>0 THEN 'RECORD' WHEN c.access&1024<>0 THEN 'ABSTRACT_CLASS' ELSE 'CLASS' END AS kind
  FROM up u LEFT JOIN classes c ON c.internal_name=u.node"""))
def ancestors(spark, sf):
    classes = T.classes(spark, sf)
    chains = H.ancestor_chains(classes.select("archive_id", "internal_name"), classes)
    return H.with_class_kind(chains.withColumnRenamed("node", "internal_name"), classes).select(
        "start", "level", F.col("internal_name").alias("node"), "kind"
    )


@query(with_views("edges_h", """WITH RECURSIVE down AS (
  SELECT r AS root, r AS node FROM (VALUES ('i/Brand#2'),('k1/C1'),('k2/C2')) t(r) WHERE r IN (SELECT parent FROM edges_h)
  UNION SELECT d.root, e.child FROM down d JOIN edges_h e ON e.parent=d.node) SELECT root, node FROM down"""))
def subtypes(spark, sf):
    return H.subtype_closure(_seed(spark, sf, "i/Brand#2", "k1/C1", "k2/C2"), _types(spark, sf)).select("root", "node")


@query(with_views("edges_h", """WITH RECURSIVE paths AS (
  SELECT r AS root, r AS node, [r] AS path FROM (VALUES ('i/Brand#2'),('k1/C1')) t(r) WHERE r IN (SELECT parent FROM edges_h)
  UNION ALL SELECT p.root, e.child, list_append(p.path, e.child) FROM paths p JOIN (SELECT DISTINCT child, parent FROM edges_h) e ON e.parent=p.node WHERE NOT list_contains(p.path, e.child)),
  best AS (SELECT root, node, min(path) AS path FROM paths GROUP BY 1,2),
  kids AS (SELECT b.root, b.node AS parent, e.child AS node, list_append(b.path, e.child) AS path FROM best b JOIN (SELECT DISTINCT child, parent FROM edges_h) e ON e.parent=b.node)
  SELECT k.root, k.parent, k.node, array_to_string(k.path,' > ') AS path, coalesce(k.path=b.path,false) AS expanded FROM kids k LEFT JOIN best b ON b.root=k.root AND b.node=k.node
  UNION ALL SELECT DISTINCT root, NULL, root, root, true FROM best"""))
def subtype_tree(spark, sf):
    tree = H.subtype_tree(_seed(spark, sf, "i/Brand#2", "k1/C1"), _types(spark, sf))
    return tree.select("root", "parent", "node", F.concat_ws(" > ", "path").alias("path"), "expanded")


@query(with_views("edges_h call_methods", """WITH RECURSIVE down AS (
  SELECT 'k1/C1' AS root, 'k1/C1' AS node UNION SELECT d.root, e.child FROM down d JOIN edges_h e ON e.parent=d.node)
  SELECT d.root AS declaring, m.name, m."desc", m.owner AS internal_name, m.access FROM down d JOIN call_methods m ON m.owner=d.node
  WHERE d.node<>d.root AND m.name='m2' AND m.access&8=0 AND m.access&2=0"""))
def overriders(spark, sf):
    targets = _seed(spark, sf, "k1/C1").select(
        "archive_id", F.col("internal_name").alias("declaring"), F.lit("m2").alias("name"), F.lit("()V").alias("desc")
    )
    found = H.overriders(targets, _types(spark, sf), T.call_methods(spark, sf))
    return found.drop("archive_id")


@query(with_views("edges_h call_methods call_sites", f"""WITH RECURSIVE down AS (
  SELECT 'k1/C1' AS root, 'k1/C1' AS node UNION SELECT d.root, e.child FROM down d JOIN edges_h e ON e.parent=d.node)
  SELECT {SITES} FROM call_sites WHERE target_owner='k1/C1' AND target_name='m2' AND target_desc='()V' UNION ALL
  SELECT m.owner, '(override)', m."desc", 'INVOKE_SPECIAL', 'k1/C1', m.name, m."desc", 0 FROM down d JOIN call_methods m ON m.owner=d.node
  WHERE d.node<>d.root AND m.name='m2' AND m.access&8=0 AND m.access&2=0"""))
def usage_with_overriders(spark, sf):
    targets = _seed(spark, sf, "k1/C1").select(
        "archive_id", F.col("internal_name").alias("declaring"), F.lit("m2").alias("name"), F.lit("()V").alias("desc")
    )
    found = H.overriders(targets, _types(spark, sf), T.call_methods(spark, sf))
    direct = U.usages_of_member(T.call_sites(spark, sf), "k1/C1", "m2", "()V")
    return U.with_overriders(direct, found).select(*SITE_COLS)


@query(with_views("edges_h", """WITH RECURSIVE down AS (
  SELECT 'i/Brand#3' AS root, 'i/Brand#3' AS node UNION SELECT d.root, e.child FROM down d JOIN edges_h e ON e.parent=d.node)
  SELECT root, node FROM down WHERE root<>node"""))
def implementers(spark, sf):
    return H.implementers(_seed(spark, sf, "i/Brand#3"), _types(spark, sf)).select("root", "node")


@query(with_views("edges_h", """SELECT 'implementer' AS what, child AS name FROM edges_h WHERE edge_kind='IMPLEMENTS' AND parent='i/Brand#2'
  UNION ALL SELECT 'interface', parent FROM edges_h WHERE edge_kind='IMPLEMENTS' AND child='k3/C3'"""))
def direct_relations(spark, sf):
    classes = T.classes(spark, sf)
    down = H.direct_implementers(H.hierarchy_edges(classes), "i/Brand#2").select(F.lit("implementer").alias("what"), F.col("child").alias("name"))
    up = H.direct_interfaces(classes, "k3/C3").select(F.lit("interface").alias("what"), F.col("interface").alias("name"))
    return down.unionByName(up)


# --- call graph --------------------------------------------------------------------------------


def _bfs_sql(direction: str, mode: str, depth: int, root: str, package: str | None = None, nodes: bool = False) -> str:
    if mode == "CLASS":
        src, dst = "'C:'||replace(in_class,'/','.')", "'C:'||replace(target_owner,'/','.')"
    else:
        src = "'M:'||replace(in_class,'/','.')||'#'||in_method||in_desc"
        dst = "'M:'||replace(target_owner,'/','.')||'#'||target_name||target_desc"
    ok = lambda end: f"{end} LIKE '{mode[0]}:{package}%'" if package else "true"
    moves = []
    if direction in ("OUT", "BOTH"):
        moves.append(f"SELECT src AS near, dst AS far, src, dst, n FROM e WHERE {ok('dst')}")
    if direction in ("IN", "BOTH"):
        moves.append(f"SELECT dst AS near, src AS far, src, dst, n FROM e WHERE {ok('src')}")
    body = f"""WITH RECURSIVE e AS (SELECT {src} AS src, {dst} AS dst, count(*) AS n FROM calls GROUP BY 1,2),
      moves AS ({' UNION ALL '.join(moves)}),
      walk AS (SELECT '{root}' AS node, 0 AS lvl UNION SELECT m.far, w.lvl+1 FROM walk w JOIN moves m ON m.near=w.node WHERE w.lvl<{depth}),
      lv AS (SELECT node, min(lvl) AS lvl FROM walk GROUP BY 1)"""
    if nodes:
        return with_views("calls", f"{body} SELECT node, CAST(lvl AS INT) AS level FROM lv")
    return with_views("calls", f"""{body} SELECT src, dst, CAST(sum(n) AS BIGINT) AS weight FROM moves JOIN lv ON lv.node=moves.near
      WHERE lvl<{depth} AND src<>dst GROUP BY 1,2""")


def _root(spark, sf, node):
    """The root as a one-row table, kept only if it occurs in the corpus."""
    return T.read(spark, sf, "part").filter(F.col("p_partkey") == 7).select(F.lit("app").alias("archive_id"), F.lit(node).alias("node"))


@query(_bfs_sql("OUT", "CLASS", 2, "C:k7.C7"))
def call_graph_out2(spark, sf):
    return G.call_graph(_class_calls(spark, sf), _root(spark, sf, "C:k7.C7"), "CLASS", "OUT", 2)[1].drop("archive_id")


@query(_bfs_sql("BOTH", "CLASS", 2, "C:k7.C7"))
def call_graph_both2(spark, sf):
    return G.call_graph(_class_calls(spark, sf), _root(spark, sf, "C:k7.C7"), "CLASS", "BOTH", 2)[1].drop("archive_id")


@query(_bfs_sql("IN", "METHOD", 4, "M:k7.C7#m3()V"))
def call_graph_method_in(spark, sf):
    return G.call_graph(_method_node_calls(spark, sf), _root(spark, sf, "M:k7.C7#m3()V"), "METHOD", "IN", 4)[1].drop("archive_id")


@query(_bfs_sql("OUT", "CLASS", 2, "C:k7.C7", package="k1"))
def call_graph_package(spark, sf):
    return G.call_graph(_class_calls(spark, sf), _root(spark, sf, "C:k7.C7"), "CLASS", "OUT", 2, "k1*")[1].drop("archive_id")


@query(_bfs_sql("BOTH", "CLASS", 1, "C:k7.C7", nodes=True))
def call_graph_nodes(spark, sf):
    return G.call_graph(_class_calls(spark, sf), _root(spark, sf, "C:k7.C7"), "CLASS", "BOTH", 1)[0].drop("archive_id")


@query(with_views("calls", f"""WITH RECURSIVE first AS (SELECT {KEYS} AS callee, {CALLER} AS caller, arg_min(line, {{'a': site_idx, 'b': line}}) AS line FROM calls GROUP BY 1,2),
  tree AS (SELECT 'k7/C7#m3()V' AS method_key, ['k7/C7#m3()V'] AS path, 0 AS level, 0 AS line, false AS cyclic UNION ALL
   SELECT c.caller, list_append(t.path, c.caller), t.level+1, c.line, list_contains(t.path, c.caller) FROM tree t JOIN first c ON c.callee=t.method_key WHERE NOT t.cyclic AND t.level<5)
  SELECT method_key, array_to_string(path,' < ') AS path, CAST(level AS INT) AS level, CAST(line AS INT) AS line, cyclic,
   NOT cyclic AND level=5 AND method_key IN (SELECT callee FROM first) AS truncated FROM tree"""))
def recursive_callers(spark, sf):
    roots = _root(spark, sf, "").select("archive_id", F.lit("k7/C7").alias("owner"), F.lit("m3").alias("name"), F.lit("()V").alias("desc"))
    tree = G.recursive_callers(_method_calls(spark, sf), roots)
    return tree.select("method_key", F.concat_ws(" < ", "path").alias("path"), "level", "line", "cyclic", "truncated")


def _hub_calls(spark, sf) -> Adjacency:
    return _table(spark, sf, "hub_calls", "lineitem", lambda: G.method_edges(T.hub_calls(spark, sf)), G.METHOD_ENDS)


#: Edges with their first line, and the least number of calls from each method to the root.  An edge is on a circle if both ends are in
#: the component of a pivot, or if one leads back to the other around that component.
_HUBS = """WITH RECURSIVE e AS (SELECT caller, callee, count(*) AS sites, arg_min(line, {'a': site_idx, 'b': line}) AS line FROM hub_calls GROUP BY 1,2),
  walk AS (SELECT 'h/S1#m()V' AS node, 0 AS level UNION SELECT e.caller, walk.level+1 FROM walk JOIN e ON e.callee=walk.node WHERE walk.level<40),
  up AS (SELECT node, min(level) AS level FROM walk GROUP BY 1),
  dag AS (SELECT e.caller, e.callee, up.level+1 AS level, e.line, e.sites FROM up JOIN e ON e.callee=up.node),
"""


@query(with_views("hub_calls", _HUBS + """centre AS (SELECT caller AS node FROM dag WHERE caller<>callee GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  fw AS (SELECT node FROM centre UNION SELECT d.callee FROM fw JOIN dag d ON d.caller=fw.node),
  bw AS (SELECT node FROM centre UNION SELECT d.caller FROM bw JOIN dag d ON d.callee=bw.node),
  big AS (SELECT node FROM fw INTERSECT SELECT node FROM bw),
  rest AS (SELECT caller, callee FROM dag WHERE caller NOT IN (SELECT node FROM big) AND callee NOT IN (SELECT node FROM big)),
  core AS (SELECT * FROM rest WHERE caller IN (SELECT callee FROM rest) AND callee IN (SELECT caller FROM rest)),
  far AS (SELECT caller AS a, callee AS b FROM core UNION SELECT far.a, core.callee FROM far JOIN core ON core.caller=far.b),
  back AS (SELECT a, b FROM far)
  SELECT 'h/S1#m()V' AS root, caller, callee, CAST(level AS INT) AS level, CAST(line AS INT) AS line, sites,
    caller=callee OR (caller IN (SELECT node FROM big) AND callee IN (SELECT node FROM big) AND (SELECT count(*) FROM big)>1) OR (callee, caller) IN (SELECT a, b FROM back) AS cyclic,
    false AS truncated FROM dag"""))
def caller_dag(spark, sf):
    roots = _root(spark, sf, "").select("archive_id", F.lit("h/S1").alias("owner"), F.lit("m").alias("name"), F.lit("()V").alias("desc"))
    return G.caller_dag(_hub_calls(spark, sf), roots).drop("archive_id")


@query(with_views("hub_calls", _HUBS + """ranked AS (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS rk, count(*) OVER (PARTITION BY callee) AS callers FROM e),
  one AS (SELECT * FROM ranked WHERE callee='h/S1#m()V' AND rk<=60),
  two AS (SELECT * FROM ranked WHERE callee IN (SELECT caller FROM one) AND callee<>'h/S1#m()V' AND rk<=60),
  met AS (SELECT callee AS node FROM one UNION SELECT caller FROM one),
  shown AS (SELECT *, 1 AS level FROM one UNION ALL SELECT *, 2 FROM two)
  SELECT 'h/S1#m()V' AS root, caller, callee, CAST(level AS INT) AS level, CAST(line AS INT) AS line, sites,
    callers>60 OR (caller NOT IN (SELECT node FROM met) AND caller IN (SELECT callee FROM e)) AS truncated FROM shown"""))
def caller_dag_limited(spark, sf):
    roots = _root(spark, sf, "").select("archive_id", F.lit("h/S1").alias("owner"), F.lit("m").alias("name"), F.lit("()V").alias("desc"))
    return G.caller_dag(_hub_calls(spark, sf), roots, depth=2, per_node=60).drop("archive_id", "cyclic")


@query(with_views("calls", """WITH o AS (SELECT in_class AS owner, in_method AS name, in_desc AS "desc", count(*) AS callees FROM calls GROUP BY ALL),
  i AS (SELECT target_owner AS owner, target_name AS name, target_desc AS "desc", count(*) AS callers FROM calls GROUP BY ALL)
  SELECT owner, name, "desc", coalesce(callers,0) AS callers, coalesce(callees,0) AS callees FROM o FULL JOIN i USING (owner, name, "desc")"""))
def call_degrees(spark, sf):
    return G.degrees(T.call_sites(spark, sf)).drop("archive_id")


def _children_sql(near: str, far: str) -> str:
    n = {"in": ("in_class", "in_method", "in_desc"), "target": ("target_owner", "target_name", "target_desc")}
    a, b = n[near], n[far]
    return with_views("calls call_methods", f"""WITH o AS (SELECT in_class AS ow, in_method AS nm, in_desc AS de, count(*) AS callees FROM calls GROUP BY ALL),
      i AS (SELECT target_owner AS ow, target_name AS nm, target_desc AS de, count(*) AS callers FROM calls GROUP BY ALL),
      c AS (SELECT {a[0]} AS owner, {a[1]} AS name, {a[2]} AS "desc", {b[0]} AS child_owner, {b[1]} AS child_name, {b[2]} AS child_desc,
        count(*) AS sites, arg_min(line, {{'a': site_idx, 'b': line}}) AS first_line FROM calls
        WHERE ({a[0]},{a[1]},{a[2]}) IN (SELECT owner, name, "desc" FROM call_methods WHERE access&1<>0) GROUP BY ALL),
      t AS (SELECT *, owner=child_owner AND name=child_name AND "desc"=child_desc AS terminal FROM c)
      SELECT t.*, CASE WHEN terminal THEN 0 ELSE coalesce(callers,0) END AS child_callers, CASE WHEN terminal THEN 0 ELSE coalesce(callees,0) END AS child_callees
      FROM t LEFT JOIN o ON o.ow=child_owner AND o.nm=child_name AND o.de=child_desc LEFT JOIN i ON i.ow=child_owner AND i.nm=child_name AND i.de=child_desc""")


@query(_children_sql("in", "target"))
def call_tree_callees(spark, sf):
    wanted = T.call_methods(spark, sf).filter(F.col("access").bitwiseAND(1) != 0)
    return G.call_tree_children(_method_calls(spark, sf), wanted, "OUT").drop("archive_id")


@query(_children_sql("target", "in"))
def call_tree_callers(spark, sf):
    wanted = T.call_methods(spark, sf).filter(F.col("access").bitwiseAND(1) != 0)
    return G.call_tree_children(_method_calls(spark, sf), wanted, "IN").drop("archive_id")


@query(with_views("calls", """WITH e AS (SELECT 'C:'||replace(in_class,'/','.') AS src, 'C:'||replace(target_owner,'/','.') AS dst, count(*) AS n FROM calls GROUP BY 1,2)
  SELECT 'out' AS way, src, dst, n FROM e WHERE src='C:k7.C7' UNION ALL SELECT 'in', src, dst, n FROM e WHERE dst='C:k7.C7'"""))
def graph_edges_at(spark, sf):
    root = _root(spark, sf, "C:k7.C7")
    at = lambda way: _class_calls(spark, sf).around(root, way.upper()).select(F.lit(way).alias("way"), "src", "dst", "n")
    return at("out").unionByName(at("in"))
