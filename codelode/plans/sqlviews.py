"""The fact views of :mod:`codelode.sources.tables` as ANSI-SQL common table expressions for the oracle."""

from __future__ import annotations

NP = "(SELECT count(*) FROM part)"


def cls(key: str) -> str:
    return f"('k'||(({key})%20)||'/C'||({key}))"


def method_desc(key: str) -> str:
    return (
        f"(CASE WHEN ({key})%3=0 THEN '(Ljava/lang/String;)Ljava/lang/String;' "
        f"WHEN ({key})%3=1 THEN '(ILjava/lang/String;)Ljava/lang/String;' ELSE '()V' END)"
    )


def version(side: str) -> str:
    edited = "(p_partkey%7=0)" if side == "B" else "false"
    return f"""SELECT {cls('p_partkey')} internal_name, replace({cls('p_partkey')},'/','.') AS name,
      CAST(p_size + CASE WHEN {edited} AND p_partkey%2=0 THEN 16 ELSE 0 END AS INT) AS access,
      CASE WHEN {edited} AND p_partkey%3=0 THEN 'java/lang/Object' ELSE {cls('p_partkey//4')} END AS super_name,
      [p_brand, CASE WHEN {edited} AND p_partkey%5=0 THEN 'i/New' ELSE 'i/Old' END] AS interfaces,
      CAST(50 + CASE WHEN {edited} AND p_partkey%11=0 THEN 2 ELSE 0 END AS INT) AS major,
      p_name || CASE WHEN {edited} THEN '''' ELSE '' END AS bytes
      FROM part WHERE p_partkey%10 <> {0 if side == 'A' else 1}"""


def version_fields(side: str) -> str:
    edited = "(s_suppkey%7=0)" if side == "B" else "false"
    keep = "s_suppkey%9<>0" if side == "A" else "s_suppkey%8<>1"
    return f"""SELECT {cls('(s_suppkey%20)*7')} AS owner, 'f'||s_suppkey AS name, 'I' AS "desc",
      CAST(8 + CASE WHEN {edited} AND s_suppkey%2=0 THEN 16 ELSE 0 END AS INT) AS access,
      CAST(CASE WHEN {edited} THEN s_suppkey+1 ELSE s_suppkey END AS VARCHAR) AS const_value
      FROM supplier WHERE {keep}"""


VIEWS: dict[str, str] = {
    "classes": f"""SELECT 'app' AS archive_id, {cls('p_partkey')} AS internal_name,
      replace({cls('p_partkey')},'/','.') AS name, 'k'||(p_partkey%20) AS package_name, 'C'||p_partkey AS simple_name,
      CASE WHEN p_partkey=0 THEN 'java/lang/Object' ELSE {cls('p_partkey//4')} END AS super_name,
      'i/'||p_brand AS interface,
      CAST(CASE p_size%6 WHEN 0 THEN 16385 WHEN 1 THEN 1537 WHEN 2 THEN 1025 WHEN 3 THEN 65537 WHEN 4 THEN 8705 ELSE 33 END AS INT) AS access,
      CAST(43 + p_size%30 AS INT) AS major, CAST(p_size%3 AS INT) AS runtime_version,
      CASE p_partkey%4 WHEN 0 THEN 'C'||p_partkey||'.java' WHEN 1 THEN NULL WHEN 2 THEN 'x.bin' ELSE 'C'||p_partkey||'.kt' END AS source_file,
      p_name AS bytes FROM part""",
    "hub_calls": f"""SELECT {cls('l_partkey')}||'#m()V' AS caller,
      CASE WHEN l_linenumber<3 AND l_partkey<100 THEN 'h/S'||(l_suppkey%5) WHEN l_linenumber=7 AND l_partkey%8=5 AND l_partkey*2<{NP} THEN {cls('l_partkey*2')} ELSE {cls('l_partkey//2')} END||'#m()V' AS callee,
      CAST(l_quantity AS INT) AS line, (l_orderkey*10+l_linenumber)*100000000 + CAST(round(l_extendedprice*100) AS BIGINT) AS site_idx FROM lineitem""",
    "edges_h": """SELECT internal_name AS child, super_name AS parent, 'EXTENDS' AS edge_kind FROM classes
      UNION ALL SELECT internal_name, interface, 'IMPLEMENTS' FROM classes""",
    "ver_a": version("A"),
    "ver_b": version("B"),
    "fields_a": version_fields("A"),
    "fields_b": version_fields("B"),
    "call_sites": f"""SELECT 'app' AS archive_id, {cls(f'l_orderkey % {NP}')} AS in_class, 'm'||l_linenumber AS in_method, '()V' AS in_desc,
      CASE l_returnflag||l_linestatus WHEN 'AF' THEN 'INVOKE_VIRTUAL' WHEN 'AO' THEN 'INVOKE_STATIC' WHEN 'RO' THEN 'INVOKE_INTERFACE'
        WHEN 'NF' THEN 'GETFIELD' WHEN 'NO' THEN 'PUTSTATIC' ELSE 'NEW' END AS kind,
      {cls('l_partkey')} AS target_owner,
      CASE WHEN l_returnflag='N' THEN 'f'||(l_suppkey%7+1) WHEN l_returnflag||l_linestatus IN ('AF','AO','RO') THEN 'm'||(l_suppkey%7+1) ELSE '' END AS target_name,
      CASE WHEN l_returnflag='N' THEN 'I' WHEN l_returnflag||l_linestatus IN ('AF','AO','RO') THEN '()V' ELSE '' END AS target_desc,
      CAST(l_quantity AS INT) AS line,
      (l_orderkey*10+l_linenumber)*100000000 + CAST(round(l_extendedprice*100) AS BIGINT) AS site_idx
      FROM lineitem""",
    "calls": "SELECT * FROM call_sites WHERE kind LIKE 'INVOKE%'",
    "call_methods": f"""SELECT {cls('k')} AS owner, CAST(l_linenumber AS INT) AS ordinal, 'm'||l_linenumber AS name, '()V' AS "desc",
      CAST(min(l_suppkey)%16 AS INT) AS access
      FROM (SELECT l_orderkey % {NP} AS k, l_linenumber, l_suppkey FROM lineitem) GROUP BY k, l_linenumber""",
    "insn_raw": """SELECT *, (l_suppkey*7 + l_linenumber*3 + CAST(l_quantity AS INT)) % 20 AS sel, CAST(l_quantity AS INT) AS qty,
      row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS idx FROM lineitem""",
    "insn_lab": """SELECT *, CASE WHEN sel=0 THEN idx END AS label,
      min(CASE WHEN sel=0 THEN idx END) OVER (PARTITION BY l_partkey ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_label,
      max(CASE WHEN sel=0 THEN idx END) OVER (PARTITION BY l_partkey ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_label
      FROM insn_raw""",
    "instructions": f"""SELECT 'a'||((l_partkey//4)%5) AS archive_id, {cls('l_partkey//4')} AS owner, 'q'||(l_partkey%4) AS method,
      {method_desc('l_partkey')} AS "desc", CAST(idx AS INT) AS idx,
      CAST(CASE sel WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 153 WHEN 5 THEN 154 WHEN 6 THEN 167 WHEN 7 THEN 18 WHEN 8 THEN 18
        WHEN 9 THEN 16 WHEN 10 THEN 17 WHEN 11 THEN 130 WHEN 12 THEN 184 WHEN 13 THEN 183 WHEN 14 THEN 178 WHEN 15 THEN 172 WHEN 16 THEN 170
        WHEN 17 THEN 187 WHEN 18 THEN 182 ELSE 186 END AS INT) AS opcode,
      ['LABEL','LINE','ICONST_0','ICONST_1','IFEQ','IFNE','GOTO','LDC','LDC','BIPUSH','SIPUSH','IXOR','INVOKESTATIC','INVOKESPECIAL',
       'GETSTATIC','IRETURN','TABLESWITCH','NEW','INVOKEVIRTUAL','INVOKEDYNAMIC'][CAST(sel AS INT)+1] AS mnemonic,
      CASE sel WHEN 0 THEN 'LABEL' WHEN 1 THEN 'LINE' END AS pseudo_kind,
      CASE WHEN sel=1 THEN qty END AS line, CAST(label AS INT) AS label,
      CASE WHEN sel IN (4,5,6) THEN [x for x in [coalesce(next_label,prev_label)] if x IS NOT NULL]
           WHEN sel=16 THEN [x for x in [next_label,prev_label] if x IS NOT NULL] ELSE CAST([] AS BIGINT[]) END AS jump_targets,
      CASE sel WHEN 12 THEN {cls('l_suppkey//4')} WHEN 13 THEN 'java/lang/String' WHEN 14 THEN {cls('l_suppkey')}
        WHEN 17 THEN (CASE WHEN l_suppkey%2=1 THEN {cls('l_partkey//4')} ELSE 'java/lang/Thread' END)
        WHEN 18 THEN ['java/io/PrintStream','java/lang/Runtime','java/lang/StringBuilder','java/security/MessageDigest','java/lang/System','java/util/List','java/lang/System'][CAST(l_linenumber AS INT)] END AS ref_owner,
      CASE sel WHEN 12 THEN 'q'||(l_suppkey%4) WHEN 13 THEN '<init>' WHEN 14 THEN 'f'||l_suppkey
        WHEN 18 THEN ['println','exec','append','getInstance','exit','add','loadLibrary'][CAST(l_linenumber AS INT)] END AS ref_name,
      CASE sel WHEN 12 THEN {method_desc('l_suppkey')} WHEN 13 THEN '([C)V' WHEN 14 THEN 'I' WHEN 18 THEN '()V' END AS ref_desc,
      CASE WHEN sel IN (2,3,8,9,10) THEN 'int' WHEN sel=7 THEN 'string' END AS const_kind,
      CASE WHEN sel=7 THEN (CASE WHEN l_linenumber=1 THEN 'https://h'||(l_suppkey%9)||'.example/q?'||(l_partkey%7) WHEN l_linenumber=2 THEN 'ghijklmnopqrstuvwxyz'||upper(md5(CAST(l_suppkey AS VARCHAR)))||md5(CAST(l_suppkey AS VARCHAR)) ELSE 'lit'||(l_suppkey%50) END) END AS const_str,
      CAST(CASE sel WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 8 THEN floor(l_extendedprice) WHEN 9 THEN qty WHEN 10 THEN qty*100 END AS BIGINT) AS const_long,
      CASE WHEN sel=16 THEN qty*2 END AS switch_cases,
      CASE WHEN sel=19 THEN (CASE WHEN l_suppkey%10=0 THEN 'com/licel/stringer/Boot' ELSE 'java/lang/invoke/Factory' END) END AS bsm_owner,
      CASE WHEN sel=19 THEN 'recipe'||(l_suppkey%5) END AS bsm_string
      FROM insn_lab""",
    "code_methods": f"""SELECT 'a'||((p_partkey//4)%5) AS archive_id, {cls('p_partkey//4')} AS owner, CAST(p_partkey%4 AS INT) AS ordinal,
      'q'||(p_partkey%4) AS name, {method_desc('p_partkey')} AS "desc",
      CAST(CASE WHEN p_size%10=0 THEN 257 WHEN p_size%2=0 THEN 9 ELSE 1 END AS INT) AS access FROM part""",
    "code_classes": f"""SELECT 'a'||(p_partkey%5) AS archive_id, {cls('p_partkey')} AS owner,
      coalesce(CASE WHEN p_partkey%17<8 THEN (CASE p_partkey%5 WHEN 0 THEN 'a' WHEN 1 THEN 'IlIl1' WHEN 2 THEN 'Il1O0Il1O0Il1O0Il1O0Il1O0' WHEN 3 THEN 'Größe' WHEN 4 THEN 'StringerHelper' END) END, 'C'||p_partkey) AS simple_name,
      'k'||(p_partkey%20)||'/'||coalesce(CASE WHEN p_partkey%17<8 THEN (CASE p_partkey%5 WHEN 0 THEN 'a' WHEN 1 THEN 'IlIl1' WHEN 2 THEN 'Il1O0Il1O0Il1O0Il1O0Il1O0' WHEN 3 THEN 'Größe' WHEN 4 THEN 'StringerHelper' END) END, 'C'||p_partkey) AS internal_name
      FROM part WHERE p_partkey*4 < {NP}""",
    "code_resources": """SELECT 'a'||(page_id%5) AS archive_id,
      CASE page_id%40 WHEN 3 THEN 'META-INF/proguard/rules.pro' WHEN 4 THEN 'lib/natives/native0.so' WHEN 6 THEN 'META-INF/ALLATORI'
       WHEN 7 THEN 'yguard.xml' WHEN 9 THEN 'win/helper.dll' WHEN 10 THEN 'mapping.txt' ELSE 'res/'||page_id||'.html' END AS path FROM pages""",
    "code_local_vars": """SELECT 'a'||((p_partkey//4)%5) AS archive_id,
      CASE WHEN (p_partkey//4)%5 < 2 AND p_size%2=0 THEN 'arg'||(p_partkey%4) ELSE 'count' END AS name FROM part""",
    "code_fields": f"""SELECT 'a'||(s_suppkey%5) AS archive_id, {cls('s_suppkey')} AS owner, 'f'||s_suppkey AS name, 'I' AS "desc",
      CAST(CASE WHEN s_suppkey%3=0 THEN 9 ELSE 25 END AS INT) AS access,
      CASE s_suppkey%4 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'string' END AS const_kind,
      CASE WHEN s_suppkey%4=2 THEN s_name END AS const_str,
      CASE s_suppkey%4 WHEN 0 THEN s_suppkey*53-3 WHEN 1 THEN (s_suppkey//4)%3 END AS const_long FROM supplier""",
    "try_catch": """SELECT archive_id, owner, method, "desc", min(label) AS start_label, max(label) AS end_label, max(label) AS handler_label
      FROM instructions WHERE label IS NOT NULL GROUP BY ALL HAVING min(label) < max(label)""",
    "code_annotations": f"""SELECT 'a'||(p_partkey%5) AS archive_id, 'class' AS target_kind, {cls('p_partkey')} AS owner, '' AS member, '' AS member_desc,
       CASE WHEN p_partkey%4=0 THEN 'La.bad;' ELSE 'Lkotlin/Metadata;' END AS "desc", p_partkey%9<>0 AS visible FROM part WHERE p_partkey%6=0
      UNION ALL SELECT 'a'||((p_partkey//4)%5), 'method', {cls('p_partkey//4')}, 'q'||(p_partkey%4), {method_desc('p_partkey')}, CASE WHEN p_partkey%3=0 THEN 'L<x>;' ELSE 'La/Test;' END, false FROM part WHERE p_partkey%5=0""",
    "code_headers": """SELECT * REPLACE ('a'||(CAST(substr(simple_name,2) AS BIGINT)%5) AS archive_id) FROM classes""",
    "method_counts": """SELECT c.*, coalesce(j,0) AS jump_label_count FROM (SELECT archive_id, owner, method AS name, "desc", CAST(count(*) FILTER (WHERE opcode>=0) AS INT) AS real_count,
       CAST(count(*) FILTER (WHERE pseudo_kind='LABEL') AS INT) AS label_count, CAST(count(*) FILTER (WHERE pseudo_kind='LINE') AS INT) AS line_count FROM instructions GROUP BY ALL) c
      LEFT JOIN (SELECT i.archive_id, i.owner, i.method AS name, i."desc", CAST(count(*) AS INT) AS j FROM instructions i WHERE i.label IS NOT NULL AND (i.archive_id, i.owner, i.method, i."desc", i.label) IN
       (SELECT archive_id, owner, method, "desc", CAST(unnest(jump_targets) AS INT) FROM instructions UNION SELECT archive_id, owner, method, "desc", start_label FROM try_catch UNION SELECT archive_id, owner, method, "desc", end_label FROM try_catch) GROUP BY ALL) r
      USING (archive_id, owner, name, "desc")""",
    "doc_lines": """SELECT d.*, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents d""",
    "constant_strings": """SELECT 'app' AS archive_id, source||'.D'||doc_id AS class_name, value, CAST(ordinal AS INT) AS ordinal FROM doc_lines""",
    "string_sites": """SELECT 'app' AS archive_id, source AS in_class, 'd'||doc_id AS in_member, '()V' AS in_desc, 'LDC' AS source, value, CAST(ordinal AS INT) AS line FROM doc_lines""",
    "resources": """SELECT 'app' AS archive_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') ||
      ['/a.class','/module-info.class','/n.dll','/n.so','/n.jnilib','/n.jar','/n.war','/n.zip','/META-INF/MANIFEST.MF','/META-INF/services/s',
       '/p.properties','/p.XSD','/p.json','/p.yml','/readme.MD','/i.webp','/f.woff2','/q.sql','/run.ps1','/d.dat','/page.html','/noext'][CAST(page_id%22 AS INT)+1] AS path,
      html AS content, CAST(strlen(html) AS BIGINT) AS size, page_id FROM pages""",
    "resource_kinds": """SELECT *, CASE
       WHEN path ILIKE '%.class' THEN 'JAVA_CLASS' WHEN path ILIKE '%.dll' THEN 'NATIVE_DLL' WHEN path ILIKE '%.so' THEN 'NATIVE_SO'
       WHEN path ILIKE '%.dylib' OR path ILIKE '%.jnilib' THEN 'NATIVE_DYLIB' WHEN path ILIKE '%.jar' THEN 'NESTED_JAR'
       WHEN path ILIKE '%.war' THEN 'NESTED_WAR' WHEN path ILIKE '%.zip' THEN 'NESTED_ZIP'
       WHEN path ILIKE '%/manifest.mf' OR lower(path)='manifest.mf' THEN 'MANIFEST'
       WHEN path ILIKE 'meta-inf/services/%' OR path ILIKE '%/meta-inf/services/%' THEN 'SERVICE'
       WHEN regexp_matches(lower(path),'\\.properties$') THEN 'PROPERTIES' WHEN regexp_matches(lower(path),'\\.(xml|xsd|xslt)$') THEN 'XML'
       WHEN path ILIKE '%.json' THEN 'JSON' WHEN regexp_matches(lower(path),'\\.ya?ml$') THEN 'YAML'
       WHEN regexp_matches(lower(path),'\\.(txt|md|rst|csv|log)$') THEN 'TEXT'
       WHEN regexp_matches(lower(path),'\\.(png|jpg|jpeg|gif|svg|ico|webp|bmp)$') THEN 'IMAGE'
       WHEN regexp_matches(lower(path),'\\.(ttf|otf|woff|woff2)$') THEN 'FONT' WHEN path ILIKE '%.sql' THEN 'SQL'
       WHEN regexp_matches(lower(path),'\\.(sh|bat|cmd|ps1)$') THEN 'SCRIPT' WHEN regexp_matches(lower(path),'\\.(bin|dat)$') THEN 'BINARY'
       ELSE 'OTHER' END AS kind FROM resources""",
    "resource_lines": """SELECT path, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS line_no, unnest(string_split(content, chr(10))) AS text
      FROM resource_kinds WHERE kind IN ('MANIFEST','SERVICE','PROPERTIES','XML','JSON','YAML','TEXT','SQL','SCRIPT')""",
    "comments": """SELECT 'app' AS archive_id, CASE WHEN turn=0 THEN 'CLASS:c.C'||conv_id
      ELSE (CASE WHEN role='user' THEN 'FIELD' ELSE 'METHOD' END)||':c.C'||conv_id||':'||role||':'||turn END AS key, text,
      CASE WHEN turn=0 THEN 'class' WHEN role='user' THEN 'field' ELSE 'method' END AS kind, 'c.C'||conv_id AS class_fqn,
      CASE WHEN turn<>0 THEN role END AS member, CASE WHEN turn<>0 THEN CAST(turn AS VARCHAR) END AS member_desc FROM conversations""",
    "map1": """SELECT 'class' AS kind, 'C'||p_partkey AS owner, '' AS name, '' AS "desc", CASE WHEN p_partkey%3=0 THEN 'U'||p_partkey ELSE 'N'||(p_partkey%500) END AS target FROM part
      UNION ALL SELECT 'field', 'C'||p_partkey, 'f'||(p_partkey%7), 'I', 'g'||(p_partkey%3) FROM part
      UNION ALL SELECT 'method', 'C'||p_partkey, 'm'||(p_partkey%5), '()V', 'n'||(p_partkey%4) FROM part""",
    "map2": """SELECT 'class' AS kind, 'N'||s_suppkey AS owner, '' AS name, '' AS "desc", 'F'||s_suppkey AS target FROM supplier
      UNION ALL SELECT 'class', CASE WHEN s_suppkey%2=0 THEN 'C' ELSE 'Z' END||s_suppkey, '', '', 'G'||s_suppkey FROM supplier
      UNION ALL SELECT 'field', 'N'||s_suppkey, 'g'||(s_suppkey%3), 'I', 'h'||s_suppkey FROM supplier
      UNION ALL SELECT 'method', 'N'||s_suppkey, 'n'||(s_suppkey%4), '()V', 'z'||s_suppkey FROM supplier""",
    "map1_v2": """SELECT kind, owner, name, "desc", CASE WHEN n%7=0 THEN target||'_v2' ELSE target END AS target
        FROM (SELECT *, CAST(substr(owner,2) AS BIGINT) AS n FROM map1) WHERE n%10<>0
      UNION ALL SELECT kind, 'X'||owner, name, "desc", target FROM (SELECT *, CAST(substr(owner,2) AS BIGINT) AS n FROM map1) WHERE n%11=0""",
    "polls": """SELECT user_id%8 AS pid, event_id AS tick, user_id AS u, value AS v, event_type AS e, props,
      CAST(round(value*100) AS BIGINT)*104857 AS used FROM events""",
    "samples": """SELECT pid, tick, 'heap_mb' AS series, CAST(used//1048576 AS DOUBLE) AS value FROM polls WHERE e<>'view'
      UNION ALL SELECT pid, tick, 'threads', CAST(u%50+10 AS DOUBLE) FROM polls WHERE e<>'click'
      UNION ALL SELECT pid, tick, 'cpu_pct', greatest(0.0, v/500-(u%2)*CAST(0.1 AS DOUBLE))*100 FROM polls WHERE e<>'signup'""",
    "attempts": """SELECT 'u'||user_id AS key, 'u'||user_id||'@'||strftime(ts,'%d') AS chain, event_id AS attempt_no,
      CASE WHEN event_type='view' THEN 'Fallback' ELSE 'engine-'||event_type END AS engine, event_type IN ('view','purchase','click') AS success FROM events""",
}

# Which views a view reads.
_NEEDS = {
    "edges_h": ["classes"],
    "calls": ["call_sites"],
    "insn_lab": ["insn_raw"],
    "instructions": ["insn_lab"],
    "try_catch": ["instructions"],
    "method_counts": ["try_catch"],
    "code_headers": ["classes"],
    "constant_strings": ["doc_lines"],
    "string_sites": ["doc_lines"],
    "resource_kinds": ["resources"],
    "resource_lines": ["resource_kinds"],
    "map1_v2": ["map1"],
    "samples": ["polls"],
}


def with_views(views: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views (space separated) and everything they read in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for v in views.split():
        add(v)
    body = body.strip()
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    if not ctes:
        return body
    word = "WITH RECURSIVE " if recursive else "WITH "
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(lead):
            word = lead if lead != "WITH " else word
            return f"{word}{ctes}, {body[len(lead):]}"
    return f"{word}{ctes} {body}"
