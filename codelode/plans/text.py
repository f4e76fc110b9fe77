"""Scalar, search, roll-up and byte queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.functions.access import CLASS_FLAGS, METHOD_FLAGS, flag_list, java_version
from codelode.operators import bytestats as B
from codelode.operators import rollups as R
from codelode.operators import search as X
from codelode.operators import usage as U
from codelode.plans.registry import query
from codelode.plans.sqlviews import with_views
from codelode.sources import tables as T
from codelode.sources.reports import report_lines

# --- scalars -----------------------------------------------------------------------------------


def _flags_sql(mask: str, flags: dict) -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {mask}&{v}<>0 THEN '{n}' END" for n, v in flags.items()) + ")"


@query(with_views("resource_kinds", r"""WITH h AS (SELECT path, kind AS kind_by_name, lower(ltrim(content)) AS low,
   [x for x in regexp_extract_all(substr(hex(encode(content)),1,512),'..') if true] AS b FROM resource_kinds),
  c AS (SELECT *, CASE WHEN len([x for x in b if regexp_matches(x,'^(09|0A|0D|[2-6].|7[0-9A-E]|[C-F].)$')])*10 > len(b)*9
   THEN (CASE WHEN low LIKE '<?xml%' THEN 'XML' WHEN low[1] IN ('{','[') THEN 'JSON' WHEN low LIKE '#!%' THEN 'SCRIPT' ELSE 'TEXT' END) END AS kind_by_content FROM h)
  SELECT path, kind_by_name, kind_by_content, CASE WHEN kind_by_name='OTHER' THEN coalesce(kind_by_content,'OTHER') ELSE kind_by_name END AS kind FROM c"""))
def resource_kinds(spark, sf):
    path, content = F.col("path"), F.col("content")
    return T.resources(spark, sf).select(
        "path",
        S.resource_kind(path).alias("kind_by_name"),
        S.resource_kind_by_content(F.substring(content, 1, 256)).alias("kind_by_content"),
        S.entry_kind(path, content).alias("kind"),
    )


@query(with_views("classes", f"""SELECT archive_id, internal_name, {_flags_sql('access', CLASS_FLAGS)} AS flags,
  CASE WHEN major BETWEEN 45 AND 48 THEN 'Java 1.'||(major-44) WHEN major BETWEEN 49 AND 69 THEN 'Java '||(major-44) ELSE 'Unknown ('||major||')' END AS java_version FROM classes"""))
def class_overview(spark, sf):
    return R.class_overview(T.classes(spark, sf))


@query(with_views("", f"SELECT p_partkey, p_size*37%8192 AS mask, {_flags_sql('(p_size*37%8192)', METHOD_FLAGS)} AS flags FROM part"))
def method_flags(spark, sf):
    mask = (F.col("p_size") * 37) % 8192
    return T.read(spark, sf, "part").select("p_partkey", mask.alias("mask"), F.concat_ws(" ", flag_list(mask, "method")).alias("flags"))


@query(with_views("classes", """SELECT internal_name, replace(internal_name,'/','.') AS dotted, split_part(internal_name,'/',1) AS package, split_part(internal_name,'/',2) AS simple FROM classes"""))
def name_parts(spark, sf):
    n = F.col("internal_name")
    return T.classes(spark, sf).select(
        "internal_name", S.dotted(n).alias("dotted"), S.package_of(n).alias("package"), S.simple_name(n).alias("simple")
    )


@query(with_views("comments", "SELECT key, kind, class_fqn, member, member_desc FROM comments"))
def comment_keys(spark, sf):
    decoded = T.comments(spark, sf).withColumn("c", S.decode_comment_key(F.col("key")))
    return decoded.select("key", "c.kind", "c.class_fqn", "c.member", "c.member_desc")


@query(with_views("call_sites", """SELECT target_owner, target_name, target_desc, target_owner||'#'||target_name||target_desc AS method_key,
  target_owner||'.'||target_name||':'||target_desc AS field_key, count(*) AS n FROM call_sites GROUP BY ALL"""))
def member_keys(spark, sf):
    o, n, d = F.col("target_owner"), F.col("target_name"), F.col("target_desc")
    grouped = T.call_sites(spark, sf).groupBy("target_owner", "target_name", "target_desc").agg(F.count("*").alias("n"))
    return grouped.select("*", S.method_key(o, n, d).alias("method_key"), S.field_key(o, n, d).alias("field_key"))


@query(with_views("", """SELECT p_partkey, trim(x) AS java_type, CASE p_partkey%4 WHEN 0 THEN 'I' WHEN 1 THEN '[Ljava/lang/String;' WHEN 2 THEN '[[Z' ELSE 'La/B'||p_partkey||';' END AS descriptor,
   trim(x) AS back, CASE WHEN p_partkey%3=0 THEN '' ELSE 'J' || (CASE p_partkey%4 WHEN 0 THEN 'I' WHEN 1 THEN '[Ljava/lang/String;' WHEN 2 THEN '[[Z' ELSE 'La/B'||p_partkey||';' END) END AS parameters,
   '(' || CASE WHEN p_partkey%3=0 THEN '' ELSE 'long,'||trim(x) END || ')' AS parameter_types, trim(x) AS return_type
  FROM (SELECT *, CASE p_partkey%4 WHEN 0 THEN 'int' WHEN 1 THEN 'java.lang.String[]' WHEN 2 THEN 'boolean[][]' ELSE 'a.B'||p_partkey END AS x FROM part)"""))
def type_descriptors(spark, sf):
    k = F.col("p_partkey")
    java = F.when(k % 4 == 0, "int").when(k % 4 == 1, "java.lang.String[]").when(k % 4 == 2, "boolean[][]").otherwise(F.concat(F.lit("a.B"), k.cast("string")))
    params = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("long, "), F.col("java_type")))
    rows = T.read(spark, sf, "part").select("p_partkey", java.alias("java_type"))
    rows = rows.withColumn("descriptor", S.type_to_descriptor(F.col("java_type"))).withColumn("parameters", S.parameters_to_descriptor(params))
    full = F.concat(F.lit("("), F.col("parameters"), F.lit(")"), F.col("descriptor"))
    return rows.select(
        "*", S.descriptor_to_type(F.col("descriptor")).alias("back"), S.method_parameter_types(full).alias("parameter_types"),
        S.method_return_type(full).alias("return_type"),
    )


@query(with_views("", r"""WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents UNION ALL SELECT unnest(['class','try','$a','1a','a-b','']) FROM region),
  d AS (SELECT word, count(*) AS n FROM w GROUP BY 1)
  SELECT word, n, regexp_matches(word, '^[\p{L}\p{Nl}\p{Sc}\p{Pc}][\p{L}\p{Nl}\p{Sc}\p{Pc}\p{Nd}\p{Mn}\p{Mc}\p{Cf}]*$') AS legal,
   word IN ('class','try','for','in','is','do','if','new','this','int') AND word NOT IN ('in','is') AS reserved FROM d"""))
def identifier_check(spark, sf):
    words = T.read(spark, sf, "documents").select(F.explode(F.split("text", "[ \n]+", -1)).alias("word"))
    extra = T.read(spark, sf, "region").select(F.explode(F.array(*[F.lit(x) for x in ["class", "try", "$a", "1a", "a-b", ""]])).alias("word"))
    counted = words.unionByName(extra).groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", "n", S.is_legal_identifier(F.col("word")).alias("legal"), S.is_java_word(F.col("word")).alias("reserved"))


_DESC = """CASE p_partkey%6 WHEN 0 THEN 'La/B'||p_partkey||';' WHEN 1 THEN 'La.b;' WHEN 2 THEN 'L;' WHEN 3 THEN '[La;' WHEN 4 THEN 'La<b>;' ELSE 'LOk;' END"""


@query(with_views("", f"SELECT p_partkey, {_DESC} AS \"desc\", p_partkey%6 IN (0,5) AS valid FROM part"))
def annotation_descriptors(spark, sf):
    k = F.col("p_partkey")
    desc = (
        F.when(k % 6 == 0, F.concat(F.lit("La/B"), k.cast("string"), F.lit(";"))).when(k % 6 == 1, "La.b;").when(k % 6 == 2, "L;")
        .when(k % 6 == 3, "[La;").when(k % 6 == 4, "La<b>;").otherwise("LOk;")
    )
    return T.read(spark, sf, "part").select("p_partkey", desc.alias("desc"), S.annotation_desc_valid(desc).alias("valid"))


@query(with_views("constant_strings", r"""WITH ch AS (SELECT class_name, ordinal, value, unicode(c) & 255 AS b FROM (SELECT *, unnest(string_split(value, '')) AS c FROM constant_strings WHERE value<>'')),
  ct AS (SELECT class_name, ordinal, b, count(*) AS n FROM ch GROUP BY 1,2,3),
  en AS (SELECT class_name, ordinal, sum(n) AS total, log2(sum(n)) - sum(n*log2(n))/sum(n) AS e FROM ct GROUP BY 1,2)
  SELECT c.class_name, c.ordinal, round(coalesce(e,0),6) AS entropy,
   length(regexp_replace(value,'[^\x00-\x08\x0B\x0C\x0E-\x1F]','','g'))>2 AND length(regexp_replace(value,'[^\x00-\x08\x0B\x0C\x0E-\x1F]','','g'))>length(value)//10 AS control_heavy
  FROM constant_strings c LEFT JOIN en USING (class_name, ordinal)"""))
def string_profile(spark, sf):
    v = F.col("value")
    return T.constant_strings(spark, sf).select(
        "class_name", "ordinal", F.round(S.shannon_entropy(v), 6).alias("entropy"), S.control_char_heavy(v).alias("control_heavy")
    )


@query(with_views("", """WITH l AS (SELECT doc_id, string_split(text, chr(10))[2] AS s FROM documents), c AS (SELECT doc_id, ltrim(rtrim(s, ' '||chr(9)||chr(13)), ' '||chr(9)) AS s FROM l)
  SELECT doc_id, CASE WHEN s IS NULL OR s='' THEN NULL WHEN length(s)>120 THEN substr(s,1,119)||'…' ELSE s END AS snippet FROM c"""))
def source_snippets(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", S.source_snippet(F.col("text"), F.lit(2)).alias("snippet"))


def _header_hex():
    """Headers of all formats, by part key, as hex text."""
    k = F.col("p_partkey")
    pad = lambda n: F.lit("00" * n)
    elf = F.concat(F.lit("7F454C46020101"), F.when(k % 3 == 0, "03").otherwise("00"), pad(8), F.lit("0300"), F.when(k % 2 == 0, "3E00").otherwise("B700"), pad(44))
    elf_be = F.concat(F.lit("7F454C4601020109"), pad(8), F.lit("00030008"), pad(44))
    pe = F.concat(F.lit("4D5A"), pad(58), F.lit("40000000"), F.lit("50450000"), F.when(k % 2 == 0, "6486").otherwise("4C01"), pad(18), F.when(k % 2 == 0, "0B02").otherwise("0B01"))
    macho = F.concat(F.lit("CFFAEDFE"), F.when(k % 2 == 0, "0C000001").otherwise("07000001"), pad(8))
    return F.when(k % 6 == 0, elf).when(k % 6 == 1, elf_be).when(k % 6 == 2, pe).when(k % 6 == 3, macho).when(k % 6 == 4, "CAFEBABE00000002").otherwise("7F45")


@query("""SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN 'ELF' WHEN 1 THEN 'ELF' WHEN 2 THEN 'PE' WHEN 3 THEN 'MACH_O' WHEN 4 THEN 'MACH_O' ELSE 'UNKNOWN' END AS format,
  CASE p_partkey%6 WHEN 0 THEN 'x86_64' WHEN 1 THEN 'MIPS' WHEN 2 THEN 'x86_64' WHEN 3 THEN 'x86_64' WHEN 4 THEN 'fat (multiple slices)' ELSE '?' END AS arch,
  CAST(CASE p_partkey%6 WHEN 0 THEN 64 WHEN 1 THEN 32 WHEN 2 THEN 64 WHEN 3 THEN 64 ELSE 0 END AS INT) AS bitness,
  CASE p_partkey%6 WHEN 1 THEN 'big' WHEN 4 THEN '?' WHEN 5 THEN '?' ELSE 'little' END AS endian,
  CASE p_partkey%6 WHEN 0 THEN (CASE WHEN p_partkey%3=0 THEN 'Linux' ELSE 'System V' END) WHEN 1 THEN 'FreeBSD' WHEN 2 THEN 'Windows' WHEN 5 THEN '?' ELSE 'macOS' END AS os_abi FROM part""")
def native_headers(spark, sf):
    header = S.native_header(F.unhex(_header_hex())).alias("h")
    return T.read(spark, sf, "part").select("p_partkey", header).select("p_partkey", "h.*")


# --- search ------------------------------------------------------------------------------------

RESULT = ["kind", "path", "label", "line", "text", "start", "end", "context"]


def _lines(spark, sf):
    named = T.resources(spark, sf).withColumn("kind", S.resource_kind(F.col("path")))
    return X.resource_lines(named)


_STRING_HITS = """SELECT 'CLASS_STRING' AS kind, class_name AS path, split_part(class_name,'.',2) AS label, ordinal AS line, value AS text, {start} AS start, {end} AS "end", 'CP string' AS context
   FROM (SELECT class_name, ordinal, value, value AS t FROM constant_strings WHERE class_name LIKE '{pkg}%' AND NOT (class_name LIKE 'src13.%' OR class_name LIKE 'src14.%')) WHERE {hit}
  UNION ALL SELECT 'RESOURCE_TEXT', path, path, line_no, text, {start}, {end}, '' FROM (SELECT *, text AS t FROM resource_lines) WHERE {hit}"""


@query(with_views("constant_strings resource_lines", _STRING_HITS.format(
    pkg="src1", hit="contains(lower(t),'ering')", start="CAST(instr(lower(t),'ering')-1 AS INT)", end="CAST(instr(lower(t),'ering')+4 AS INT)")))
def search_strings(spark, sf):
    q = X.Search("eRing", package_filter="src1*", excluded=["src13", "src14.*"])
    return X.search_strings(T.constant_strings(spark, sf), _lines(spark, sf), q).select(*RESULT)


@query(with_views("constant_strings resource_lines", _STRING_HITS.format(
    pkg="src", hit=r"regexp_matches(t,'\bwith\b')", start=r"CAST(length(regexp_extract(t,'(?s)^(.*?)\bwith\b',1)) AS INT)", end=r"CAST(length(regexp_extract(t,'(?s)^(.*?)\bwith\b',1))+4 AS INT)")))
def search_whole_word(spark, sf):
    q = X.Search("with", whole_word=True, case_sensitive=True, package_filter="src", excluded=["src13", "src14"])
    return X.search_strings(T.constant_strings(spark, sf), _lines(spark, sf), q).select(*RESULT)


@query(with_views("constant_strings resource_lines", _STRING_HITS.format(
    pkg="src2", hit="regexp_matches(t,'(?i)er[a-z]+ing')", start="CAST(length(regexp_extract(t,'(?is)^(.*?)er[a-z]+ing',1)) AS INT)",
    end="CAST(length(regexp_extract(t,'(?is)^(.*?)er[a-z]+ing',1))+length(regexp_extract(t,'(?i)er[a-z]+ing')) AS INT)")))
def search_regex(spark, sf):
    q = X.Search("er[a-z]+ing", package_filter="src2", excluded=["src13", "src14"])
    return X.search_regex(T.constant_strings(spark, sf), _lines(spark, sf), q).select(*RESULT)


@query(with_views("classes call_methods fields_a", """WITH n AS (
   SELECT 'CLASS_NAME' AS kind, name AS path, 0 AS line, name AS text, 'class' AS context FROM classes WHERE runtime_version=0
   UNION ALL SELECT 'CLASS_METHOD', replace(owner,'/','.'), ordinal+1, name, 'method' FROM call_methods
   UNION ALL SELECT 'CLASS_FIELD', replace(owner,'/','.'), 1, name, 'field' FROM fields_a)
  SELECT kind, path, split_part(path,'.',2) AS label, CAST(line AS INT) AS line, text, CAST(instr(text,'1')-1 AS INT) AS start, CAST(instr(text,'1') AS INT) AS "end", context
  FROM n WHERE contains(text,'1') AND path LIKE 'k1%' AND NOT path LIKE 'k11.%'"""))
def search_names(spark, sf):
    fields = T.version_fields(spark, sf, "A").withColumn("ordinal", F.lit(0))
    q = X.Search("1", package_filter="k1", excluded=["k11.*"])
    return X.search_names(T.classes(spark, sf), T.call_methods(spark, sf), fields, q).select(*RESULT)


@query(with_views("instructions", """WITH t AS (SELECT *, concat_ws(' ', mnemonic, ref_owner, ref_name, ref_desc) AS text FROM instructions)
  SELECT 'CLASS_BYTECODE' AS kind, replace(owner,'/','.') AS path, split_part(owner,'/',2) AS label, idx AS line, text, CAST(instr(lower(text),'invokestatic k1')-1 AS INT) AS start,
   CAST(instr(lower(text),'invokestatic k1')+14 AS INT) AS "end", '' AS context FROM t WHERE contains(lower(text),'invokestatic k1')"""))
def search_code(spark, sf):
    return X.search_code(T.instructions(spark, sf), X.Search("invokestatic K1")).select(*RESULT)


_NUMBERS = """WITH s AS (SELECT *, coalesce(last_value(line IGNORE NULLS) OVER (PARTITION BY archive_id, owner, method, "desc" ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0) AS cur FROM instructions)
  SELECT 'CLASS_BYTECODE' AS kind, replace(owner,'/','.') AS path, method AS label, CAST(cur AS INT) AS line, CAST(const_long AS VARCHAR) AS text, 0 AS start,
   CAST(length(CAST(const_long AS VARCHAR)) AS INT) AS "end", 'method '||method||' — '||const_long AS context FROM s WHERE const_long = {n}"""


@query(with_views("instructions", _NUMBERS.format(n=1)))
def search_numbers(spark, sf):
    return X.search_numbers(T.instructions(spark, sf), X.Search("0x100000001")).select(*RESULT)


@query(with_views("instructions", _NUMBERS.format(n=25)))
def search_numbers_float(spark, sf):
    return X.search_numbers(T.instructions(spark, sf), X.Search("25.0f")).select(*RESULT)


@query(with_views("comments", """SELECT 'COMMENT' AS kind, class_fqn AS path, split_part(class_fqn,'.',2) AS label, 0 AS line, text, CAST(instr(lower(text),'the ')-1 AS INT) AS start, CAST(instr(lower(text),'the ')+3 AS INT) AS "end",
   CASE kind WHEN 'class' THEN 'class comment' WHEN 'method' THEN 'method '||member||'() comment' ELSE 'field '||member||' comment' END AS context
  FROM comments WHERE contains(lower(text),'the ') AND NOT class_fqn='c.C3'"""))
def search_comments(spark, sf):
    comments = X.present_comments(T.comments(spark, sf))
    return X.search_comments(comments, X.Search("the ", excluded=["c.C3"], in_classes=False)).select(*RESULT)


@query(with_views("constant_strings", """WITH h AS (SELECT class_name AS path, ordinal AS line, value AS text, CAST(instr(lower(value),'tion')-1 AS INT) AS s FROM constant_strings WHERE contains(lower(value),'tion') AND class_name LIKE 'src3%')
  SELECT path, line, CASE WHEN s>40 THEN '…' ELSE '' END || substr(text, greatest(0,s-40)+1, least(length(text),s+84)-greatest(0,s-40)) || CASE WHEN s+84<length(text) THEN '…' ELSE '' END AS snippet FROM h"""))
def search_snippets(spark, sf):
    q = X.Search("tion", package_filter="src3", in_resources=False)
    found = X.search_strings(T.constant_strings(spark, sf), _lines(spark, sf), q)
    return X.in_order(X.with_snippet(found), "path").select("path", "line", "snippet")


@query(with_views("instructions code_fields", """WITH s AS (SELECT *, CAST(coalesce(last_value(line IGNORE NULLS) OVER (PARTITION BY archive_id, owner, method, "desc" ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),0) AS INT) AS cur FROM instructions)
  SELECT archive_id, owner AS in_class, method AS in_member, "desc" AS in_desc, cur AS line, CASE WHEN const_kind='string' THEN 'LDC' ELSE 'INVOKEDYNAMIC_BSM' END AS source, coalesce(const_str, bsm_string) AS value
  FROM s WHERE const_kind='string' OR bsm_string IS NOT NULL UNION ALL SELECT archive_id, owner, name, "desc", 0, 'FIELD_CONSTANT', const_str FROM code_fields WHERE const_kind='string'"""))
def string_literals(spark, sf):
    return X.build_string_sites(T.instructions(spark, sf), T.code_fields(spark, sf))


@query(with_views("string_sites", r"""SELECT 'exact' AS mode, in_class, in_member, line FROM string_sites WHERE value='' UNION ALL SELECT 'contains', in_class, in_member, line FROM string_sites WHERE contains(value,'ering th')
  UNION ALL SELECT 'regex', in_class, in_member, line FROM string_sites WHERE regexp_matches(value,'[0-9]{3,}')"""))
def literal_lookup(spark, sf):
    sites = T.string_sites(spark, sf)
    tag = lambda df, mode: df.select(F.lit(mode).alias("mode"), "in_class", "in_member", "line")
    return (
        tag(X.literal_equals(sites, ""), "exact").unionByName(tag(X.literal_contains(sites, "ering th"), "contains"))
        .unionByName(tag(X.literal_matches(sites, "[0-9]{3,}"), "regex"))
    )


@query(with_views("string_sites", "SELECT value, count(*) AS sites FROM string_sites GROUP BY 1"))
def string_distribution(spark, sf):
    return X.string_distribution(T.string_sites(spark, sf))


@query(with_views("string_sites", "SELECT count(DISTINCT value) AS unique_strings, count(*) AS total_sites FROM string_sites"))
def string_totals(spark, sf):
    return X.string_totals(T.string_sites(spark, sf))


# --- roll-ups ----------------------------------------------------------------------------------

_REPORT = """SELECT 'app' AS archive_id, 'parts' AS source, (SELECT count(*) FROM classes WHERE runtime_version=0) AS class_count, (SELECT count(*) FROM classes WHERE runtime_version>0) AS versioned_class_count,
  (SELECT count(*) FROM resources) AS resource_count, (SELECT count(*) FROM call_sites WHERE kind LIKE 'INVOKE%') AS method_call_count,
  (SELECT count(*) FROM call_sites WHERE kind IN ('GETFIELD','PUTSTATIC')) AS field_access_count, (SELECT count(*) FROM call_sites WHERE kind='NEW') AS class_use_count"""


def _report(spark, sf):
    archives = T.classes(spark, sf).select("archive_id").distinct().withColumn("source", F.lit("parts"))
    return R.archive_report(archives, T.classes(spark, sf), T.resources(spark, sf), T.call_sites(spark, sf))


@query(with_views("classes resources call_sites", _REPORT))
def archive_report(spark, sf):
    return _report(spark, sf)


@query(with_views("classes resources call_sites", f"""SELECT '{{"archive_id":"app","source":"parts","class_count":'||class_count||',"versioned_class_count":'||versioned_class_count||',"resource_count":'||resource_count||
  ',"method_call_count":'||method_call_count||',"field_access_count":'||field_access_count||',"class_use_count":'||class_use_count||'}}' AS value FROM ({_REPORT})"""))
def report_json(spark, sf):
    return report_lines(_report(spark, sf))


@query(with_views("classes", """SELECT runtime_version, package_name AS folder, package_name AS label, count(*) AS entries_below, count(*) AS entries_here FROM classes GROUP BY 1,2"""))
def package_tree(spark, sf):
    return R.package_rollup(T.classes(spark, sf)).drop("archive_id")


@query(with_views("resources", """WITH f AS (SELECT regexp_extract(path,'^(.*)/[^/]*$',1) AS p FROM resources), x AS (SELECT p, string_split(p,'/') AS parts FROM f WHERE p<>''),
  e AS (SELECT p, unnest([array_to_string(parts[1:n],'/') for n in range(1, len(parts)+1)]) AS folder FROM x)
  SELECT folder, split_part(folder,'/',-1) AS label, count(*) AS entries_below, count(*) FILTER (WHERE folder=p) AS entries_here FROM e GROUP BY 1,2"""))
def resource_tree(spark, sf):
    return R.resource_rollup(T.resources(spark, sf)).drop("archive_id")


_STEP = "'{0}'||chr(2)||lower(upper({1}))||chr(2)||{1}||chr(1)"


@query(with_views("classes resources", f"""WITH c AS (SELECT 'CLASS' AS kind, 'PACKAGE' AS folder_kind, simple_name AS label, [package_name] AS folders, runtime_version AS version,
   CASE WHEN runtime_version>0 THEN {_STEP.format(4, "'[Multi-Release]'")}||{_STEP.format(5, "('Java '||runtime_version)")} ELSE '' END AS top, CASE WHEN runtime_version>0 THEN 2 ELSE 0 END AS depth FROM classes),
  r AS (SELECT 'RESOURCE', 'RESOURCE_FOLDER', split_part(path,'/',-1), CASE WHEN regexp_extract(path,'^(.*)/[^/]*$',1)='' THEN [] ELSE string_split(regexp_extract(path,'^(.*)/[^/]*$',1),'/') END, 0, {_STEP.format(1, "'resources'")}, 1 FROM resources),
  l AS (SELECT * FROM c UNION ALL SELECT * FROM r),
  s AS (SELECT *, list_transform(folders, lambda x: CASE WHEN kind='CLASS' THEN {_STEP.format(0, 'x')} ELSE {_STEP.format(1, 'x')} END) AS steps FROM l),
  leaves AS (SELECT depth+len(folders) AS depth, kind, label, top||array_to_string(steps,'')||CASE WHEN kind='CLASS' THEN {_STEP.format(2, 'label')} ELSE {_STEP.format(3, 'label')} END AS sort_path FROM s),
  f AS (SELECT DISTINCT depth+n-1 AS depth, folder_kind AS kind, folders[n] AS label, top||array_to_string(steps[1:n],'') AS sort_path FROM (SELECT *, unnest(range(1, len(folders)+1)) AS n FROM s)),
  t AS (SELECT DISTINCT 0 AS depth, 'RESOURCE_FOLDER' AS kind, 'resources' AS label, top AS sort_path FROM s WHERE kind='RESOURCE'
   UNION SELECT 0, 'MULTI_RELEASE_ROOT', '[Multi-Release]', {_STEP.format(4, "'[Multi-Release]'")} FROM s WHERE version>0 UNION SELECT 1, 'MULTI_RELEASE_VERSION', 'Java '||version, top FROM s WHERE version>0),
  a AS (SELECT * FROM leaves UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t)
  SELECT CAST(row_number() OVER (ORDER BY sort_path)-1 AS BIGINT) AS position, CAST(depth AS INT) AS depth, kind, label, sort_path FROM a"""))
def archive_tree(spark, sf):
    return R.archive_tree(T.classes(spark, sf), T.resources(spark, sf)).drop("archive_id")


@query(with_views("call_methods fields_a", """WITH m AS (SELECT owner, 'FIELD' AS kind, name, "desc", 0 AS block, '' AS s, 0 AS ordinal FROM fields_a
   UNION ALL SELECT owner, 'METHOD', CASE WHEN name='m3' THEN '<init>' ELSE name END, "desc", CASE WHEN name='m3' THEN 1 ELSE 2 END, CASE WHEN name='m3' THEN '<init>' ELSE name END, ordinal FROM call_methods)
  SELECT owner, kind, name, "desc", CAST(row_number() OVER (PARTITION BY owner ORDER BY block, s, ordinal, name, "desc") AS INT) AS position FROM m"""))
def member_listing(spark, sf):
    methods = T.call_methods(spark, sf).withColumn("name", F.when(F.col("name") == "m3", "<init>").otherwise(F.col("name")))
    fields = T.version_fields(spark, sf, "A").withColumn("ordinal", F.lit(0))
    return R.member_listing(methods, fields).drop("archive_id")


@query(with_views("classes", "SELECT archive_id, name FROM classes WHERE contains(lower(name),'c19') ORDER BY length(name), name LIMIT 1"))
def go_to_class(spark, sf):
    return R.go_to_class(T.classes(spark, sf), "C19")


@query(with_views("resources", """WITH c AS (SELECT page_id, path, lower(split_part(path,'/',-1)) AS f, lower(path) AS h FROM resources),
  a AS (SELECT *, instr(f,'s') AS a1, instr(h,'s') AS b1 FROM c),
  b AS (SELECT *, CASE WHEN a1>0 AND instr(substr(f,a1+1),'m')>0 THEN a1+instr(substr(f,a1+1),'m') END AS a2, CASE WHEN b1>0 AND instr(substr(h,b1+1),'m')>0 THEN b1+instr(substr(h,b1+1),'m') END AS b2 FROM a),
  d AS (SELECT *, CASE WHEN a2 IS NOT NULL AND instr(substr(f,a2+1),'e')>0 THEN a2+instr(substr(f,a2+1),'e') END AS a3, CASE WHEN b2 IS NOT NULL AND instr(substr(h,b2+1),'e')>0 THEN b2+instr(substr(h,b2+1),'e') END AS b3 FROM b),
  s AS (SELECT page_id, path, CASE WHEN a3 IS NOT NULL THEN 1+CASE WHEN a2-a1>1 THEN a2-a1 ELSE 0 END+CASE WHEN a3-a2>1 THEN a3-a2 ELSE 0 END
    WHEN b3 IS NOT NULL THEN 1+CASE WHEN b2-b1>1 THEN b2-b1 ELSE 0 END+CASE WHEN b3-b2>1 THEN b3-b2 ELSE 0 END END AS score FROM d)
  SELECT page_id, path, CAST(score AS INT) AS score FROM s WHERE score IS NOT NULL"""))
def fuzzy_rank(spark, sf):
    return R.fuzzy_rank(T.resources(spark, sf).select("page_id", "path"), "sMe")


# --- bytes -------------------------------------------------------------------------------------

_BYTES = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)),'..')) AS byte, generate_subscripts(regexp_extract_all(hex(encode(text)),'..'),1)-1 AS pos FROM documents)"""


def _files(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))


@query(_BYTES + """, n AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY 1,2), e AS (SELECT doc_id, log2(sum(n)) - sum(n*log2(n))/sum(n) AS e FROM n GROUP BY 1)
  SELECT d.doc_id, round(coalesce(e,0),6) AS entropy FROM documents d LEFT JOIN e USING (doc_id)""")
def byte_entropy(spark, sf):
    return _files(spark, sf).select("doc_id", F.round(B.entropy("content"), 6).alias("entropy"))


@query(_BYTES + """, w AS (SELECT doc_id, greatest(64, least(65536, count(*)//200)) AS w FROM b GROUP BY 1), n AS (SELECT b.doc_id, pos//w AS k, byte, count(*) AS n FROM b JOIN w USING (doc_id) GROUP BY 1,2,3)
  SELECT doc_id, CAST(k AS INT) AS window_no, round(log2(sum(n)) - sum(n*log2(n))/sum(n),6) AS entropy FROM n GROUP BY 1,2""")
def entropy_windowed(spark, sf):
    return B.windowed_entropy(_files(spark, sf)).withColumn("entropy", F.round("entropy", 6))


@query(_BYTES + """, l AS (SELECT *, lead(byte) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM b)
  SELECT doc_id, CAST(pos AS INT) AS start, CAST(pos+2 AS INT) AS "end" FROM l WHERE byte='65' AND nx='65'""")
def find_bytes(spark, sf):
    return B.find_bytes(_files(spark, sf), B.parse_needle("0x65 65"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def checksums(spark, sf):
    sums = S.checksums(F.col("content"))
    return _files(spark, sf).select("doc_id", *[sums[k].alias(k) for k in ("md5", "sha1", "sha256")])


@query()
def checksums_all(spark, sf):
    return _files(spark, sf).select("doc_id", *[c.alias(k) for k, c in S.checksums(F.col("content")).items()])


def _pairs(spark, sf):
    t = F.col("text")
    edited = F.translate(t, "e", "E")
    shorter = F.substring(edited, F.lit(1), F.floor(F.length(t) / 2).cast("int"))
    right = F.when(F.col("doc_id") % 3 == 0, shorter).when(F.col("doc_id") % 3 == 1, F.concat(edited, F.lit("tail"))).otherwise(edited)
    return T.read(spark, sf, "documents").select("doc_id", F.encode(t, "UTF-8").alias("left"), F.encode(right, "UTF-8").alias("right"))


_DIFF = """WITH p AS (SELECT doc_id, regexp_extract_all(hex(encode(text)),'..') AS l, regexp_extract_all(hex(encode(CASE doc_id%3 WHEN 0 THEN substr(replace(text,'e','E'),1,length(text)//2) WHEN 1 THEN replace(text,'e','E')||'tail' ELSE replace(text,'e','E') END)),'..') AS r FROM documents),
  x AS (SELECT doc_id, unnest(l[1:least(len(l),len(r))]) AS a, unnest(r[1:least(len(l),len(r))]) AS b, generate_subscripts(l[1:least(len(l),len(r))],1)-1 AS pos FROM p),
  s AS (SELECT doc_id, pos, a=b AS same, pos - row_number() OVER (PARTITION BY doc_id, a=b ORDER BY pos) AS grp FROM x),
  g AS (SELECT doc_id, min(pos) AS "offset", count(*) AS length, CASE WHEN same THEN 'SAME' ELSE 'CHANGED' END AS side FROM s GROUP BY doc_id, same, grp
   UNION ALL SELECT doc_id, least(len(l),len(r)), abs(len(l)-len(r)), CASE WHEN len(l)>len(r) THEN 'ONLY_LEFT' ELSE 'ONLY_RIGHT' END FROM p WHERE len(l)<>len(r))"""


@query(_DIFF + ' SELECT doc_id, CAST("offset" AS INT) AS "offset", CAST(length AS INT) AS length, side FROM g')
def byte_diff(spark, sf):
    return B.byte_diff(_pairs(spark, sf))


@query(_DIFF + " SELECT doc_id, side, CAST(sum(length) AS BIGINT) AS bytes FROM g GROUP BY 1,2")
def byte_diff_totals(spark, sf):
    return B.bytes_per_side(B.byte_diff(_pairs(spark, sf)), ["doc_id"])
