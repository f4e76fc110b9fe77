"""Fact views over the star-schema test tables.

The engine's operators take fact tables (archives, classes, methods, instructions, ...).  Where no
archives are at hand, these views read the same shapes out of relational tables: line items become
call sites and instructions, parts become classes and methods, documents become string constants.
Every view is a plain projection (plus, for instructions, one window per method), so filters and
column pruning still reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import dealt

APP = "app"
STRING_DESC = "(Ljava/lang/String;)Ljava/lang/String;"
INT_STRING_DESC = "(ILjava/lang/String;)Ljava/lang/String;"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_count(spark: SparkSession, sf_dir: str) -> int:
    """Row count from Parquet footers."""
    return read(spark, sf_dir, "part").count()


def _s(c: Column) -> Column:
    return c.cast("string")


def class_name(key: Column) -> Column:
    return F.concat(F.lit("k"), _s(key % 20), F.lit("/C"), _s(key))


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("long")


def _method_desc(key: Column) -> Column:
    return F.when(key % 3 == 0, STRING_DESC).when(key % 3 == 1, INT_STRING_DESC).otherwise("()V")


# --- classes and members -----------------------------------------------------------------------


def class_name_sql(key: str) -> str:
    return f"concat('k', ({key}) % 20, '/C', {key})"


def _method_desc_sql(key: str) -> str:
    return f"CASE ({key}) % 3 WHEN 0 THEN '{STRING_DESC}' WHEN 1 THEN '{INT_STRING_DESC}' ELSE '()V' END"


# The three views that most queries read are written as SQL text: building a plan then costs one call
# to the JVM per column instead of one per operator.


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = class_name_sql("p_partkey")
    return read(spark, sf_dir, "part").selectExpr(
        f"'{APP}' AS archive_id",
        f"{own} AS internal_name",
        f"translate({own}, '/', '.') AS name",
        "concat('k', p_partkey % 20) AS package_name",
        "concat('C', p_partkey) AS simple_name",
        f"CASE WHEN p_partkey = 0 THEN 'java/lang/Object' ELSE {class_name_sql('p_partkey div 4')} END AS super_name",
        "array(concat('i/', p_brand)) AS interfaces",
        # enum, interface, abstract, record, annotation, plain; all but the last public
        """CAST(CASE p_size % 6 WHEN 0 THEN 16385 WHEN 1 THEN 1537 WHEN 2 THEN 1025 WHEN 3 THEN 65537
             WHEN 4 THEN 8705 ELSE 33 END AS INT) AS access""",
        "CAST(43 + p_size % 30 AS INT) AS major",
        "CAST(p_size % 3 AS INT) AS runtime_version",
        """CASE p_partkey % 4 WHEN 0 THEN concat('C', p_partkey, '.java') WHEN 2 THEN 'x.bin'
             WHEN 3 THEN concat('C', p_partkey, '.kt') END AS source_file""",
        "encode(p_name, 'UTF-8') AS bytes",
    )


def versions(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Two snapshots of the classes: ``A`` lacks keys 0 mod 10, ``B`` lacks 1 mod 10 and edits 0 mod 7."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = read(spark, sf_dir, "part").filter(k % 10 != (0 if side == "A" else 1))
    edited = (k % 7 == 0) if side == "B" else F.lit(False)
    name = class_name(k)
    return part.select(
        F.lit(APP).alias("archive_id"),
        name.alias("internal_name"),
        F.translate(name, "/", ".").alias("name"),
        F.lit(0).alias("runtime_version"),
        (size + F.when(edited & (k % 2 == 0), 16).otherwise(0)).cast("int").alias("access"),
        F.when(edited & (k % 3 == 0), "java/lang/Object").otherwise(class_name(_div(k, 4))).alias("super_name"),
        F.array(F.col("p_brand"), F.when(edited & (k % 5 == 0), "i/New").otherwise("i/Old")).alias("interfaces"),
        (F.lit(50) + F.when(edited & (k % 11 == 0), 2).otherwise(0)).cast("int").alias("major"),
        F.encode(F.concat(F.col("p_name"), F.when(edited, "'").otherwise("")), "UTF-8").alias("bytes"),
        F.lit(0).cast("long").alias("ordinal"),
    )


def version_fields(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Fields of the two snapshots, from suppliers spread over the parts' classes."""
    k = F.col("s_suppkey")
    edited = (k % 7 == 0) if side == "B" else F.lit(False)
    keep = (k % 9 != 0) if side == "A" else (k % 8 != 1)
    return read(spark, sf_dir, "supplier").filter(keep).select(
        F.lit(APP).alias("archive_id"),
        class_name((k % 20) * 7).alias("owner"),
        F.concat(F.lit("f"), _s(k)).alias("name"),
        F.lit("I").alias("desc"),
        (F.lit(8) + F.when(edited & (k % 2 == 0), 16).otherwise(0)).cast("int").alias("access"),
        F.lit("int").alias("const_kind"),
        F.when(edited, k + 1).otherwise(k).cast("string").alias("const_value"),
    )


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    np = part_count(spark, sf_dir)
    flags = "concat(l_returnflag, l_linestatus)"
    member = "l_suppkey % 7 + 1"
    return read(spark, sf_dir, "lineitem").selectExpr(
        f"'{APP}' AS archive_id",
        f"{class_name_sql(f'l_orderkey % {np}')} AS in_class",
        "concat('m', l_linenumber) AS in_method",
        "'()V' AS in_desc",
        f"""CASE {flags} WHEN 'AF' THEN 'INVOKE_VIRTUAL' WHEN 'AO' THEN 'INVOKE_STATIC' WHEN 'RO' THEN 'INVOKE_INTERFACE'
              WHEN 'NF' THEN 'GETFIELD' WHEN 'NO' THEN 'PUTSTATIC' ELSE 'NEW' END AS kind""",
        f"{class_name_sql('l_partkey')} AS target_owner",
        f"""CASE WHEN {flags} IN ('NF','NO') THEN concat('f', {member}) WHEN {flags} IN ('AF','AO','RO')
              THEN concat('m', {member}) ELSE '' END AS target_name""",
        f"CASE WHEN {flags} IN ('NF','NO') THEN 'I' WHEN {flags} IN ('AF','AO','RO') THEN '()V' ELSE '' END AS target_desc",
        "CAST(l_quantity AS INT) AS line",
        "(l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS site_idx",
    )


def hub_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites with five hubs that many methods call, long chains above them, and some circles: a class calls the one with half
    of its number, one in eight by its seventh items the one with twice its number."""
    np = part_count(spark, sf_dir)
    return read(spark, sf_dir, "lineitem").selectExpr(
        f"'{APP}' AS archive_id",
        f"{class_name_sql('l_partkey')} AS in_class",
        "'m' AS in_method",
        "'()V' AS in_desc",
        "'INVOKE_STATIC' AS kind",
        f"""CASE WHEN l_linenumber < 3 AND l_partkey < 100 THEN concat('h/S', l_suppkey % 5)
              WHEN l_linenumber = 7 AND l_partkey % 8 = 5 AND l_partkey * 2 < {np} THEN {class_name_sql('l_partkey * 2')} ELSE {class_name_sql('l_partkey div 2')} END AS target_owner""",
        "'m' AS target_name",
        "'()V' AS target_desc",
        "CAST(l_quantity AS INT) AS line",
        "(l_orderkey * 10 + l_linenumber) * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS site_idx",
    )


def call_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that contain call sites."""
    np = part_count(spark, sf_dir)
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % np).alias("k"), F.col("l_linenumber"))
        .agg((F.min("l_suppkey") % 16).cast("int").alias("access"))
        .select(
            F.lit(APP).alias("archive_id"),
            class_name(F.col("k")).alias("owner"),
            F.col("l_linenumber").cast("int").alias("ordinal"),
            F.concat(F.lit("m"), _s(F.col("l_linenumber"))).alias("name"),
            F.lit("()V").alias("desc"),
            "access",
        )
    )


# --- code --------------------------------------------------------------------------------------


def code_archive(key: Column) -> Column:
    return F.concat(F.lit("a"), _s(_div(key, 4) % 5))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One method per part; its line items in order are the instructions.

    A real method holds at most 65 535 bytes of code, so a window over one method is always small.
    """
    own = class_name_sql("l_partkey div 4")
    by_method = "PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice"
    # Dealt here, so that a task sorts some 200 000 rows of tables of any size; rows are counted from Parquet footers.
    numbered = dealt(read(spark, sf_dir, "lineitem"), "l_partkey").selectExpr(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "CAST(l_quantity AS INT) AS qty",
        "(l_suppkey * 7 + l_linenumber * 3 + CAST(l_quantity AS INT)) % 20 AS sel",
        f"CAST(row_number() OVER ({by_method}) AS INT) AS idx",
    )
    labelled = numbered.selectExpr(
        "*",
        "CASE WHEN sel = 0 THEN idx END AS label",
        """min(CASE WHEN sel = 0 THEN idx END) OVER (PARTITION BY l_partkey ORDER BY idx
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_label""",
        """max(CASE WHEN sel = 0 THEN idx END) OVER (PARTITION BY l_partkey ORDER BY idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_label""",
    )
    opcodes = ", ".join(str(OPCODES[i]) for i in range(20))
    names = ", ".join(f"'{MNEMONICS[i]}'" for i in range(20))
    mnemonic = f"element_at(array({names}), CAST(sel AS INT) + 1)"
    ref_owner = f"""CASE sel WHEN 12 THEN {class_name_sql('l_suppkey div 4')} WHEN 13 THEN 'java/lang/String'
        WHEN 14 THEN {class_name_sql('l_suppkey')} WHEN 17 THEN if(l_suppkey % 2 = 1, {own}, 'java/lang/Thread')
        WHEN 18 THEN element_at(array('java/io/PrintStream','java/lang/Runtime','java/lang/StringBuilder',
          'java/security/MessageDigest','java/lang/System','java/util/List','java/lang/System'), l_linenumber) END"""
    ref_name = """CASE sel WHEN 12 THEN concat('q', l_suppkey % 4) WHEN 13 THEN '<init>' WHEN 14 THEN concat('f', l_suppkey)
        WHEN 18 THEN element_at(array('println','exec','append','getInstance','exit','add','loadLibrary'), l_linenumber) END"""
    ref_desc = f"CASE sel WHEN 12 THEN {_method_desc_sql('l_suppkey')} WHEN 13 THEN '([C)V' WHEN 14 THEN 'I' WHEN 18 THEN '()V' END"
    text = """CASE l_linenumber WHEN 1 THEN concat('https://h', l_suppkey % 9, '.example/q?', l_partkey % 7)
        WHEN 2 THEN concat('ghijklmnopqrstuvwxyz', upper(md5(CAST(CAST(l_suppkey AS STRING) AS BINARY))), md5(CAST(CAST(l_suppkey AS STRING) AS BINARY)))
        ELSE concat('lit', l_suppkey % 50) END"""
    some = lambda labels: f"filter(array({labels}), x -> x IS NOT NULL)"
    return labelled.selectExpr(
        "concat('a', (l_partkey div 4) % 5) AS archive_id",
        f"{own} AS owner",
        "concat('q', l_partkey % 4) AS method",
        f"{_method_desc_sql('l_partkey')} AS desc",
        "idx",
        f"element_at(array({opcodes}), CAST(sel AS INT) + 1) AS opcode",
        f"{mnemonic} AS mnemonic",
        "CASE sel WHEN 0 THEN 'LABEL' WHEN 1 THEN 'LINE' END AS pseudo_kind",
        "CASE WHEN sel = 1 THEN qty END AS line",
        "label",
        f"""CASE WHEN sel IN (4, 5, 6) THEN {some('coalesce(next_label, prev_label)')}
             WHEN sel = 16 THEN {some('next_label, prev_label')} ELSE CAST(array() AS ARRAY<INT>) END AS jump_targets""",
        f"{ref_owner} AS ref_owner",
        f"{ref_name} AS ref_name",
        f"{ref_desc} AS ref_desc",
        "CASE WHEN sel IN (2, 3, 8, 9, 10) THEN 'int' WHEN sel = 7 THEN 'string' END AS const_kind",
        f"CASE WHEN sel = 7 THEN {text} END AS const_str",
        """CAST(CASE sel WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 8 THEN floor(l_extendedprice) WHEN 9 THEN qty
             WHEN 10 THEN qty * 100 END AS BIGINT) AS const_long""",
        "CAST(NULL AS DOUBLE) AS const_double",
        "CASE WHEN sel = 16 THEN qty * 2 END AS switch_cases",
        "CASE WHEN sel = 19 THEN if(l_suppkey % 10 = 0, 'com/licel/stringer/Boot', 'java/lang/invoke/Factory') END AS bsm_owner",
        "CASE WHEN sel = 19 THEN array(concat('recipe', l_suppkey % 5)) END AS bsm_strings",
        f"concat_ws(' ', {mnemonic}, {ref_owner}, {ref_name}, {ref_desc}) AS text",
    )


def with_twins(facts: DataFrame, owner: str) -> DataFrame:
    """The facts with a ``class_id``, and once more for every fifth class as it is for a later runtime version."""
    base = facts.withColumn("class_id", F.concat(F.col(owner), F.lit(".class")))
    fifth = F.regexp_extract(owner, "C([0-9]+)$", 1).try_cast("long") % 5 == 0
    return base.unionByName(base.where(fifth).withColumn("class_id", F.concat(F.lit("META-INF/versions/9/"), F.col("class_id"))))


def twin_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions of an archive with classes for two runtime versions; the later ones lack every other row and have other lines."""
    later = F.col("class_id").startswith("META-INF")
    twins = with_twins(instructions(spark, sf_dir), "owner").where(~later | (F.col("idx") % 2 == 0))
    return twins.withColumn("line", F.when(later, F.col("line") + 1000).otherwise(F.col("line")))


def twin_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    twins = with_twins(classes(spark, sf_dir), "internal_name")
    return twins.withColumn("runtime_version", F.when(F.col("class_id").startswith("META-INF"), 9).otherwise(0))


# --- fixed values: opcodes and mnemonics of the instruction set, by row selector ---------------
OPCODES = [-1, -1, 3, 4, 153, 154, 167, 18, 18, 16, 17, 130, 184, 183, 178, 172, 170, 187, 182, 186]
MNEMONICS = (
    "LABEL LINE ICONST_0 ICONST_1 IFEQ IFNE GOTO LDC LDC BIPUSH SIPUSH IXOR INVOKESTATIC INVOKESPECIAL "
    "GETSTATIC IRETURN TABLESWITCH NEW INVOKEVIRTUAL INVOKEDYNAMIC"
).split()


def _case(sel: Column, pairs: dict, default=None) -> Column:
    out = None
    for value, result in pairs.items():
        out = F.when(sel == value, result) if out is None else out.when(sel == value, result)
    return out if default is None else out.otherwise(default)


def code_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared methods matching :func:`instructions`; native when the part size is a multiple of 10."""
    k, size = F.col("p_partkey"), F.col("p_size")
    access = F.when(size % 10 == 0, 0x0101).when(size % 2 == 0, 0x0009).otherwise(0x0001)
    return read(spark, sf_dir, "part").select(
        code_archive(k).alias("archive_id"),
        class_name(_div(k, 4)).alias("owner"),
        (k % 4).cast("int").alias("ordinal"),
        F.concat(F.lit("q"), _s(k % 4)).alias("name"),
        _method_desc(k).alias("desc"),
        access.cast("int").alias("access"),
    )


# --- fixed values: simple names that set off the name-shape detectors --------------------------
ODD_NAMES = {0: "a", 1: "IlIl1", 2: "Il1O0Il1O0Il1O0Il1O0Il1O0", 3: "Größe", 4: "StringerHelper"}


def code_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that own the code methods, some with tell-tale names, in five archives."""
    k = F.col("p_partkey")
    np = part_count(spark, sf_dir)
    odd = F.when(k % 17 < 8, _case(k % 5, {i: F.lit(v) for i, v in ODD_NAMES.items()}))
    simple = F.coalesce(odd, F.concat(F.lit("C"), _s(k)))
    package = F.concat(F.lit("k"), _s(k % 20))
    return (
        read(spark, sf_dir, "part")
        .filter(k * 4 < np)
        .select(
            F.concat(F.lit("a"), _s(k % 5)).alias("archive_id"),
            class_name(k).alias("owner"),
            F.concat(package, F.lit("/"), simple).alias("internal_name"),
            simple.alias("simple_name"),
            F.lit(0).alias("runtime_version"),
            F.lit(True).alias("decoded"),
        )
    )


def code_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = (
        F.when(k % 40 == 3, "META-INF/proguard/rules.pro")
        .when(k % 40 == 4, "lib/natives/native0.so")
        .when(k % 40 == 6, "META-INF/ALLATORI")
        .when(k % 40 == 7, "yguard.xml")
        .when(k % 40 == 9, "win/helper.dll")
        .when(k % 40 == 10, "mapping.txt")
        .otherwise(F.concat(F.lit("res/"), _s(k), F.lit(".html")))
    )
    return read(spark, sf_dir, "pages").select(
        F.concat(F.lit("a"), _s(k % 5)).alias("archive_id"), path.alias("path")
    )


def code_local_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        code_archive(k).alias("archive_id"),
        F.when((_div(k, 4) % 5 < 2) & (F.col("p_size") % 2 == 0), F.concat(F.lit("arg"), _s(k % 4)))
        .otherwise("count")
        .alias("name"),
    )


def code_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class annotations on every sixth part's class and method annotations on some methods."""
    k = F.col("p_partkey")
    cls = class_name(k)
    on_class = read(spark, sf_dir, "part").filter(k % 6 == 0).select(
        class_archive(k).alias("archive_id"), F.lit("class").alias("target_kind"), cls.alias("owner"),
        F.lit("").alias("member"), F.lit("").alias("member_desc"),
        F.when(k % 4 == 0, "La.bad;").otherwise("Lkotlin/Metadata;").alias("desc"), (k % 9 != 0).alias("visible"),
    )
    on_method = read(spark, sf_dir, "part").filter(k % 5 == 0).select(
        code_archive(k).alias("archive_id"), F.lit("method").alias("target_kind"), class_name(_div(k, 4)).alias("owner"),
        F.concat(F.lit("q"), _s(k % 4)).alias("member"), _method_desc(k).alias("member_desc"),
        F.when(k % 3 == 0, "L<x>;").otherwise("La/Test;").alias("desc"), F.lit(False).alias("visible"),
    )
    return on_class.unionByName(on_method)


def class_archive(key: Column) -> Column:
    return F.concat(F.lit("a"), _s(key % 5))


def code_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`classes` in the five archives of the code tables."""
    key = F.substring("simple_name", 2, 20).cast("long")
    return classes(spark, sf_dir).withColumn("archive_id", class_archive(key))


def code_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "int").when(k % 4 == 1, "long").when(k % 4 == 2, "string")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("a"), _s(k % 5)).alias("archive_id"),
        class_name(k).alias("owner"),
        F.lit(0).alias("ordinal"),
        F.concat(F.lit("f"), _s(k)).alias("name"),
        F.lit("I").alias("desc"),
        F.when(k % 3 == 0, 9).otherwise(25).cast("int").alias("access"),
        kind.alias("const_kind"),
        F.when(kind == "string", F.col("s_name")).alias("const_str"),
        F.when(kind == "int", k * 53 - 3).when(kind == "long", _div(k, 4) % 3).cast("long").alias("const_long"),
        F.lit(None).cast("double").alias("const_double"),
    )


def code_try_catch(spark: SparkSession, sf_dir: str, insns: DataFrame) -> DataFrame:
    """One handler per method with two or more labels: from its first label to its last."""
    return (
        insns.filter(F.col("label").isNotNull())
        .groupBy("archive_id", "owner", "method", "desc")
        .agg(F.min("label").alias("start_label"), F.max("label").alias("end_label"))
        .filter(F.col("start_label") < F.col("end_label"))
        .withColumn("handler_label", F.col("end_label"))
    )


# --- text, resources, comments -----------------------------------------------------------------


def constant_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines as the string constants of one class per document."""
    return read(spark, sf_dir, "documents").select(
        F.lit(APP).alias("archive_id"),
        F.concat(F.col("source"), F.lit(".D"), _s(F.col("doc_id"))).alias("class_name"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "value"),
    ).withColumn("ordinal", (F.col("pos") + 1).cast("int")).drop("pos")


def string_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(
        F.lit(APP).alias("archive_id"),
        F.col("source").alias("in_class"),
        F.concat(F.lit("d"), _s(F.col("doc_id"))).alias("in_member"),
        F.lit("()V").alias("in_desc"),
        F.lit("LDC").alias("source"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "value"),
    ).withColumn("line", (F.col("pos") + 1).cast("int")).drop("pos")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(
        F.lit(APP).alias("archive_id"),
        F.concat(F.regexp_replace("url", r"^https?://|[?#].*$", ""), _resource_suffix()).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
        F.length(F.encode("html", "UTF-8")).cast("long").alias("size"),
        F.col("page_id"),
    )


# --- fixed values: suffixes given to pages so that every kind of entry occurs ------------------
PAGE_SUFFIXES = [
    "/a.class", "/module-info.class", "/n.dll", "/n.so", "/n.jnilib", "/n.jar", "/n.war", "/n.zip",
    "/META-INF/MANIFEST.MF", "/META-INF/services/s", "/p.properties", "/p.XSD", "/p.json", "/p.yml",
    "/readme.MD", "/i.webp", "/f.woff2", "/q.sql", "/run.ps1", "/d.dat", "/page.html", "/noext",
]


def _resource_suffix() -> Column:
    return F.element_at(
        F.array(*[F.lit(s) for s in PAGE_SUFFIXES]), (F.col("page_id") % len(PAGE_SUFFIXES) + 1).cast("int")
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    key = F.when(
        F.col("turn") == 0, F.concat(F.lit("CLASS:c.C"), _s(c))
    ).otherwise(
        F.concat(F.when(F.col("role") == "user", "FIELD").otherwise("METHOD"), F.lit(":c.C"), _s(c), F.lit(":"), F.col("role"), F.lit(":"), _s(F.col("turn")))
    )
    return read(spark, sf_dir, "conversations").select(
        F.lit(APP).alias("archive_id"), key.alias("key"), F.col("text")
    )


# --- mappings ----------------------------------------------------------------------------------


def _mapping_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Explode each input row into its mapping entries (one pass over the table)."""
    entry = lambda kind, owner, name, desc, target: F.struct(
        F.lit(kind).alias("kind"), owner.alias("owner"), name.alias("name"), desc.alias("desc"), target.alias("target")
    )
    return df.select(F.lit("m").alias("mapping_id"), F.explode(F.array(*[entry(*r) for r in rows])).alias("e")).select(
        "mapping_id", "e.*"
    )


def mapping_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    c = lambda prefix, x: F.concat(F.lit(prefix), _s(x))
    empty = F.lit("")
    return _mapping_rows(
        read(spark, sf_dir, "part"),
        [
            ("class", c("C", k), empty, empty, F.when(k % 3 == 0, c("U", k)).otherwise(c("N", k % 500))),
            ("field", c("C", k), c("f", k % 7), F.lit("I"), c("g", k % 3)),
            ("method", c("C", k), c("m", k % 5), F.lit("()V"), c("n", k % 4)),
        ],
    )


def mapping_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("s_suppkey")
    c = lambda prefix, x: F.concat(F.lit(prefix), _s(x))
    empty = F.lit("")
    return _mapping_rows(
        read(spark, sf_dir, "supplier"),
        [
            ("class", c("N", j), empty, empty, c("F", j)),
            ("class", F.when(j % 2 == 0, c("C", j)).otherwise(c("Z", j)), empty, empty, c("G", j)),
            ("field", c("N", j), c("g", j % 3), F.lit("I"), c("h", j)),
            ("method", c("N", j), c("n", j % 4), F.lit("()V"), c("z", j)),
        ],
    )


def mapping_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mapping after a round of edits: some entries dropped, renamed or added."""
    first = mapping_first(spark, sf_dir)
    num = F.regexp_extract("owner", r"([0-9]+)$", 1).cast("long")
    kept = first.filter(num % 10 != 0).withColumn(
        "target", F.when(num % 7 == 0, F.concat("target", F.lit("_v2"))).otherwise(F.col("target"))
    )
    added = first.filter(num % 11 == 0).withColumn("owner", F.concat(F.lit("X"), "owner"))
    return kept.unionByName(added)


# --- runtime state -----------------------------------------------------------------------------


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_of(read(spark, sf_dir, "events"))


def snapshots_of(events: DataFrame) -> DataFrame:
    """Events as polled runtime snapshots: ``pid``, ``tick`` and one JSON object per poll."""
    u, v = F.col("user_id"), F.col("value")
    used = F.round(v * 100).cast("long") * 104857
    usage = lambda x: F.struct(F.lit(0).alias("init"), x.alias("used"), (x * 2).alias("committed"))
    section = lambda hidden, body: F.when(F.col("event_type") != hidden, body)
    thread = lambda i: F.struct(
        (u * 10 + i).alias("id"),
        F.concat(F.lit("T"), _s(9 - F.lit(i)), F.lit("-"), _s(u)).alias("name"),
        F.when(u % 2 == 0, "RUNNABLE").otherwise("BLOCKED").alias("state"),
        (u + i).alias("blockedCount"),
    )
    body = F.struct(
        F.struct((u % 8).alias("pid"), F.lit("vm").alias("name")).alias("runtime"),
        section("view", F.struct(usage(used).alias("heap"), usage(used * 3).alias("nonHeap"))).alias("memory"),
        F.array(
            F.struct(F.lit("Eden").alias("name"), F.lit("HEAP").alias("type"), usage(used).alias("usage")),
            F.struct(F.lit("Code").alias("name"), F.lit("NON_HEAP").alias("type"), usage(used + 1).alias("usage")),
        ).alias("memoryPools"),
        F.array(F.struct(F.lit("G1").alias("name"), F.col("event_id").alias("collectionCount"))).alias("gc"),
        section(
            "click",
            F.struct(
                (u % 50 + 10).alias("threadCount"),
                F.when(F.col("event_type") == "error", F.array(u * 10 + 1)).otherwise(F.array()).alias("deadlocked"),
                F.array(thread(0), thread(1)).alias("list"),
            ),
        ).alias("threads"),
        section("signup", F.struct((v / 500 - (u % 2) * 0.1).alias("processCpuLoad"))).alias("os"),
        F.create_map(
            F.lit("user.id"), _s(u), F.lit("Event.Type"), F.col("event_type"), F.lit("os.props"), F.col("props")
        ).alias("systemProperties"),
    )
    return events.select(
        (u % 8).alias("pid"), F.col("event_id").alias("tick"), F.to_json(body).alias("json")
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(read(spark, sf_dir, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    """Events as engine attempts: one chain per user and day, ordered by time."""
    e = F.col("event_type")
    return events.select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("key"),
        F.concat(F.lit("u"), _s(F.col("user_id")), F.lit("@"), F.date_format("ts", "dd")).alias("chain"),
        F.col("event_id").alias("attempt_no"),
        F.when(e == "view", "Fallback").otherwise(F.concat(F.lit("engine-"), e)).alias("engine"),
        e.isin("view", "purchase", "click").alias("success"),
    )
