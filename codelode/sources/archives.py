"""Archives to fact tables: scan entries, decode classes, and split the decoded rows into tables."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codelode.functions import scalars as S
from codelode.operators.hierarchy import hierarchy_edges
from codelode.operators.search import build_string_sites, resource_lines
from codelode.operators.usage import build_call_sites
from codelode.session import BATCH_BYTES, small_batches
from codelode.sources.classfile import decode_class

LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
JMOD = b"JM\x01\x00"

ENTRY_ROW = "archive_id STRING, entry_no INT, path STRING, content BINARY, diagnostics ARRAY<STRING>"


def _inflate(method: int, data: bytes) -> bytes:
    if method == 0:
        return data
    if method == 8:
        return zlib.decompressobj(-15).decompress(data)
    raise ValueError(f"compression method {method}")


def _walk_local_headers(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Entries by their local headers, for archives whose directory cannot be trusted."""
    at = data.find(LOCAL)
    while 0 <= at < len(data) - 30:
        if data[at : at + 4] in (CENTRAL, END):
            return
        if data[at : at + 4] != LOCAL:
            at = data.find(LOCAL, at + 1)
            continue
        try:
            _, flags, method, _, _, _, packed, _, n_name, n_extra = struct.unpack_from("<HHHHHIIIHH", data, at + 4)
            start = at + 30 + n_name + n_extra
            name = data[at + 30 : at + 30 + n_name].decode("utf-8" if flags & 0x800 else "latin-1")
            if method == 8 and (flags & 8 or packed == 0):
                stream = zlib.decompressobj(-15)
                body = stream.decompress(data[start:])
                end = len(data) - len(stream.unused_data)
                following = data.find(LOCAL, end)
                at = following if following >= 0 else max(data.find(CENTRAL, end), -1)
            else:
                if start + packed > len(data):
                    packed = max(0, data.find(LOCAL, start) - start)
                body = _inflate(method, data[start : start + packed])
                at = start + packed
            yield name, body
        except (ValueError, struct.error, zlib.error, UnicodeDecodeError):
            at = data.find(LOCAL, at + 1)


def _entries(path: str, data: bytes) -> tuple[Iterator[tuple[str, bytes]], list[str]]:
    """``(name, content)`` of the archive's files and what was odd about it."""
    notes: list[str] = []
    if path.lower().endswith(".class"):
        return iter([(path.rsplit("/", 1)[-1], data)]), notes
    jmod = data[:4] == JMOD
    if jmod:
        data = data[4:]
    if data[:4] != LOCAL and (begin := data.find(LOCAL)) > 0:
        notes.append(f"leading-bytes:{begin}")
    if data.rfind(END, max(0, len(data) - 65557)) < 0:
        notes.append("no-end-record")

    def logical(name: str) -> str:
        if not jmod:
            return name
        return name[8:] if name.startswith("classes/") else name.split("/", 1)[-1] if name.find("/") > 0 else name

    seen: set[str] = set()
    repeated = 0
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        infos = []
        for info in archive.infolist():
            if info.is_dir():
                continue
            if info.filename in seen:
                repeated += 1
                continue
            seen.add(info.filename)
            infos.append(info)
        if repeated:
            notes.append(f"repeated-directory-entries:{repeated}")

        def stored():
            for info in infos:
                try:
                    yield logical(info.filename), archive.read(info)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
                    continue

        return stored(), notes
    except zipfile.BadZipFile:
        notes.append("unreadable-directory")
    found = []
    for name, body in _walk_local_headers(data):
        if name.endswith("/"):
            continue
        if name in seen:
            repeated += 1
            continue
        seen.add(name)
        found.append((logical(name), body))
    if repeated:
        notes.append(f"repeated-local-entries:{repeated}")
    return iter(found), notes


def _batches(rows: Iterator[dict], schema: pa.Schema, weight: str) -> Iterator[pa.RecordBatch]:
    """Row dictionaries as record batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if size >= BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def scan_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every file of every archive: ``archive_id, entry_no, path, content, is_class, runtime_version``.

    One task unpacks whole archives and hands entries on in bounded batches; ``archive_id`` is the file.
    """
    return scan_archive_files(
        spark.read.format("binaryFile").load(paths).select(F.col("path").alias("archive_id"), "content")
    )


def scan_archive_files(files: DataFrame) -> DataFrame:
    """The same for archives at hand as ``(archive_id, content)`` rows."""
    schema = to_arrow_schema(T.StructType.fromDDL(ENTRY_ROW))
    small_batches(files.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1)):
                    entries, notes = _entries(path.as_py(), content.as_py())
                    for i, (name, body) in enumerate(entries):
                        yield {"archive_id": path.as_py(), "entry_no": i, "path": name, "content": body, "diagnostics": notes}

        yield from _batches(rows(), schema, "content")

    found = files.select("archive_id", "content").mapInArrow(unpack, ENTRY_ROW)
    versioned = r"^META-INF/versions/(\d+)/(.+)\z"
    path = F.col("path")
    version = F.expr(r"try_cast(nullif(regexp_extract(path, '^META-INF/versions/([0-9]+)/(.+)$', 1), '') AS INT)")
    in_versions = path.rlike(versioned)
    # A version too large for a number makes the class a plain resource.
    is_class = path.endswith(".class") & (~in_versions | version.isNotNull())
    return found.select(
        "*", is_class.alias("is_class"), F.when(is_class, F.coalesce(version, F.lit(0))).otherwise(0).alias("runtime_version")
    )


def resources(entries: DataFrame) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    return entries.filter(~F.col("is_class")).select(
        "archive_id", "path", S.simple_name(path).alias("simple_name"), F.length(content).cast("long").alias("size"),
        S.entry_kind(path, content).alias("kind"), "content",
    )


def archives(entries: DataFrame) -> DataFrame:
    """``total_bytes`` counts class bytes, as the reports do."""
    return entries.groupBy("archive_id").agg(
        F.coalesce(F.sum(F.when(F.col("is_class"), F.length("content"))), F.lit(0)).cast("long").alias("total_bytes"),
        F.first("diagnostics").alias("diagnostics"),
    ).withColumn("source", F.col("archive_id"))


_EXPORT = "ARRAY<STRUCT<package: STRING, access: INT, modules: ARRAY<STRING>>>"
_CONST = "const_kind: STRING, const_str: STRING, const_long: BIGINT, const_double: DOUBLE"
CLASS_ROW = f"""archive_id STRING, path STRING, runtime_version INT, bytes BINARY, error STRING,
 internal_name STRING, super_name STRING, interfaces ARRAY<STRING>, access INT, major INT, minor INT, cp_size INT, source_file STRING,
 module_info STRUCT<name: STRING, version: STRING, access: INT, requires: ARRAY<STRUCT<module: STRING, access: INT, version: STRING>>,
   exports: {_EXPORT}, opens: {_EXPORT}, uses: ARRAY<STRING>, provides: ARRAY<STRUCT<service: STRING, providers: ARRAY<STRING>>>>,
 pool ARRAY<STRUCT<cp_index: INT, tag: INT, text: STRING, a: INT, b: INT, num: BIGINT, real: DOUBLE>>,
 fields ARRAY<STRUCT<ordinal: INT, name: STRING, desc: STRING, access: INT, {_CONST}, attrs: ARRAY<STRING>>>,
 annotations ARRAY<STRUCT<target_kind: STRING, member: STRING, member_desc: STRING, desc: STRING, visible: BOOLEAN>>,
 methods ARRAY<STRUCT<ordinal: INT, name: STRING, desc: STRING, access: INT, max_stack: INT, max_locals: INT,
   code: ARRAY<STRUCT<idx: INT, opcode: INT, pseudo_kind: STRING, line: INT, label: INT, jump_targets: ARRAY<INT>, ref_owner: STRING,
     ref_name: STRING, ref_desc: STRING, {_CONST}, switch_cases: INT, bsm_owner: STRING, bsm_strings: ARRAY<STRING>>>,
   try_catch: ARRAY<STRUCT<start_label: INT, end_label: INT, handler_label: INT>>, local_vars: ARRAY<STRING>>>"""


def decode_classes(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """One nested row per class entry; ``error`` says why an entry could not be read.

    Entries are spread evenly first, so that a single big archive is decoded by all tasks.
    """
    classes = entries.filter("is_class").select("archive_id", "path", "runtime_version", "content")
    spread = classes.repartition(partitions) if partitions else classes.repartition(F.xxhash64("archive_id", "path"))
    schema = T.StructType.fromDDL(CLASS_ROW)
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    base = {"archive_id": row["archive_id"], "path": row["path"], "runtime_version": row["runtime_version"], "bytes": row["content"]}
                    try:
                        yield {**base, **decode_class(row["content"])}
                    except Exception as ex:  # any damage in foreign bytes: keep the entry, say why
                        yield {**base, "error": f"{type(ex).__name__}: {ex}"}

        yield from _batches(rows(), arrow, "bytes")

    return spread.mapInArrow(decode, schema)


# --- fixed values: names of constant pool tags and of instructions, by run of numbers ----------
TAGS = {
    1: "Utf8", 3: "Integer", 4: "Float", 5: "Long", 6: "Double", 7: "Class", 8: "String", 9: "Fieldref", 10: "Methodref",
    11: "InterfaceMethodref", 12: "NameAndType", 15: "MethodHandle", 16: "MethodType", 17: "Dynamic", 18: "InvokeDynamic",
    19: "Module", 20: "Package",
}
MNEMONIC_RUNS = {
    0: "NOP ACONST_NULL ICONST_M1 ICONST_0 ICONST_1 ICONST_2 ICONST_3 ICONST_4 ICONST_5 LCONST_0 LCONST_1 FCONST_0 FCONST_1 "
    "FCONST_2 DCONST_0 DCONST_1 BIPUSH SIPUSH LDC",
    21: "ILOAD LLOAD FLOAD DLOAD ALOAD",
    46: "IALOAD LALOAD FALOAD DALOAD AALOAD BALOAD CALOAD SALOAD ISTORE LSTORE FSTORE DSTORE ASTORE",
    79: "IASTORE LASTORE FASTORE DASTORE AASTORE BASTORE CASTORE SASTORE POP POP2 DUP DUP_X1 DUP_X2 DUP2 DUP2_X1 DUP2_X2 SWAP "
    "IADD LADD FADD DADD ISUB LSUB FSUB DSUB IMUL LMUL FMUL DMUL IDIV LDIV FDIV DDIV IREM LREM FREM DREM INEG LNEG FNEG DNEG "
    "ISHL LSHL ISHR LSHR IUSHR LUSHR IAND LAND IOR LOR IXOR LXOR IINC I2L I2F I2D L2I L2F L2D F2I F2L F2D D2I D2L D2F I2B I2C "
    "I2S LCMP FCMPL FCMPG DCMPL DCMPG IFEQ IFNE IFLT IFGE IFGT IFLE IF_ICMPEQ IF_ICMPNE IF_ICMPLT IF_ICMPGE IF_ICMPGT "
    "IF_ICMPLE IF_ACMPEQ IF_ACMPNE GOTO JSR RET TABLESWITCH LOOKUPSWITCH IRETURN LRETURN FRETURN DRETURN ARETURN RETURN "
    "GETSTATIC PUTSTATIC GETFIELD PUTFIELD INVOKEVIRTUAL INVOKESPECIAL INVOKESTATIC INVOKEINTERFACE INVOKEDYNAMIC NEW NEWARRAY "
    "ANEWARRAY ARRAYLENGTH ATHROW CHECKCAST INSTANCEOF MONITORENTER MONITOREXIT",
    197: "MULTIANEWARRAY IFNULL IFNONNULL",
}


def _by_number(names: dict[int, str], number: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), number)


def _number_text(kind: Column, whole: Column, real: Column) -> Column:
    return F.when(kind == "float", real.cast("float").cast("string")).when(kind == "double", real.cast("string")).otherwise(
        whole.cast("string")
    )


class ClassFacts:
    """Fact tables out of decoded class rows; read the rows from a written table when using several."""

    def __init__(self, decoded: DataFrame):
        self.decoded = decoded
        self.good = decoded.filter(F.col("error").isNull())

    def classes(self) -> DataFrame:
        name = F.col("internal_name")
        return self.good.select(
            "archive_id", "internal_name", S.dotted(name).alias("name"), S.package_of(name).alias("package_name"),
            S.simple_name(name).alias("simple_name"), "super_name", "interfaces", "access", "major", "minor",
            F.size("methods").alias("method_count"), F.size("fields").alias("field_count"), "cp_size", "source_file",
            "runtime_version", "bytes", "module_info", F.lit(True).alias("decoded"),
        )

    def failures(self) -> DataFrame:
        return self.decoded.filter(F.col("error").isNotNull()).select("archive_id", "path", "error")

    def _members(self, column: str) -> DataFrame:
        plain = self.good.filter(F.col("runtime_version") == 0)
        return plain.select("archive_id", F.col("internal_name").alias("owner"), F.explode(column).alias("m"))

    def fields(self) -> DataFrame:
        return self._members("fields").select("archive_id", "owner", "m.*")

    def constant_pool(self) -> DataFrame:
        m = F.col("m")
        tag = m["tag"]
        link = F.concat(F.lit("#"), m["a"].cast("string"), F.lit(" -> "), m["text"])
        value = (
            F.when(tag == 1, m["text"])
            .when(tag.isin(7, 8, 16, 19, 20), link)
            .when(tag == 15, F.concat(F.lit("kind="), m["a"].cast("string"), F.lit(", #"), m["b"].cast("string")))
            .when(m["num"].isNotNull(), m["num"].cast("string"))
            .when(tag == 4, m["real"].cast("float").cast("string"))
            .when(tag == 6, m["real"].cast("string"))
            .otherwise(F.concat(F.lit("#"), m["a"].cast("string"), F.lit(", #"), m["b"].cast("string")))
        )
        return self._members("pool").select(
            "archive_id", "owner", m["cp_index"].alias("cp_index"), _by_number(TAGS, tag).alias("type"), value.alias("value")
        )

    def constant_strings(self) -> DataFrame:
        """Texts of the pool, numbered from 1 within their class."""
        texts = F.transform(F.filter("pool", lambda p: p["tag"] == 1), lambda p: p["text"])
        plain = self.good.filter(F.col("runtime_version") == 0)
        return plain.select(
            "archive_id", S.dotted(F.col("internal_name")).alias("class_name"), F.posexplode(texts).alias("pos", "value")
        ).select("archive_id", "class_name", (F.col("pos") + 1).alias("ordinal"), "value")

    def methods(self) -> DataFrame:
        """Declared methods with their node counts, taken from the nested code without a shuffle."""
        m = F.col("m")
        jumps = F.array_distinct(
            F.concat(
                F.flatten(F.transform(m["code"], lambda c: c["jump_targets"])),
                F.flatten(F.transform(m["try_catch"], lambda t: F.array(t["start_label"], t["end_label"], t["handler_label"]))),
            )
        )
        count = lambda test: F.size(F.filter(m["code"], test))
        return self._members("methods").select(
            "archive_id", "owner", m["ordinal"].alias("ordinal"), m["name"].alias("name"), m["desc"].alias("desc"),
            m["access"].alias("access"), m["max_stack"].alias("max_stack"), m["max_locals"].alias("max_locals"),
            count(lambda c: c["opcode"] >= 0).alias("real_count"),
            count(lambda c: c["pseudo_kind"] == "LABEL").alias("label_count"),
            count(lambda c: c["pseudo_kind"] == "LINE").alias("line_count"),
            F.size(jumps).alias("jump_label_count"),
        )

    def instructions(self) -> DataFrame:
        names = {start + i: n for start, run in MNEMONIC_RUNS.items() for i, n in enumerate(run.split())}
        rows = self._members("methods").select(
            "archive_id", "owner", F.col("m.name").alias("method"), F.col("m.desc").alias("desc"), F.explode("m.code").alias("c")
        ).select("archive_id", "owner", "method", "desc", "c.*")
        mnemonic = F.coalesce("pseudo_kind", _by_number(names, F.col("opcode")))
        constant = F.when(F.col("const_kind").isin("string", "type"), F.col("const_str")).otherwise(
            _number_text(F.col("const_kind"), F.col("const_long"), F.col("const_double"))
        )
        return rows.withColumn("mnemonic", mnemonic).withColumn(
            "text", F.concat_ws(" ", "mnemonic", "ref_owner", "ref_name", "ref_desc", constant, F.col("line").cast("string"))
        )

    def _per_method(self, column: str) -> DataFrame:
        return self._members("methods").select(
            "archive_id", "owner", F.col("m.name").alias("method"), F.col("m.desc").alias("desc"), F.explode(f"m.{column}").alias("x")
        )

    def try_catch(self) -> DataFrame:
        return self._per_method("try_catch").select("archive_id", "owner", "method", "desc", "x.*")

    def local_vars(self) -> DataFrame:
        return self._per_method("local_vars").withColumnRenamed("x", "name")

    def annotations(self) -> DataFrame:
        return self._members("annotations").select("archive_id", "owner", "m.*")


def ingest(spark: SparkSession, paths: str | list[str], folder: str) -> dict[str, DataFrame]:
    """Archives to Parquet fact tables under ``folder``; gives the tables as read back from there.

    Classes are decoded once, into a nested table that all other tables are read out of.
    """
    from codelode.sources.reports import write_facts

    def stored(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{folder}/_{name}")
        return spark.read.parquet(f"{folder}/_{name}")

    entries = stored("entries", scan_archives(spark, paths))
    facts = ClassFacts(stored("decoded", decode_classes(entries)))
    res = resources(entries)
    tables = {
        "archives": archives(entries), "classes": facts.classes(), "methods": facts.methods(), "fields": facts.fields(),
        "instructions": facts.instructions(), "constant_pool": facts.constant_pool(), "try_catch": facts.try_catch(),
        "local_vars": facts.local_vars(), "annotations": facts.annotations(), "resources": res,
        "resource_lines": resource_lines(res), "constant_strings": facts.constant_strings(),
    }
    write_facts(tables, folder)
    back = {name: spark.read.parquet(f"{folder}/{name}") for name in tables}
    plain = back["classes"].filter(F.col("runtime_version") == 0)
    derived = {
        "call_sites": build_call_sites(back["instructions"], plain),
        "string_sites": build_string_sites(back["instructions"], back["fields"]),
        "hierarchy_edges": hierarchy_edges(plain),
    }
    write_facts(derived, folder)
    return back | {name: spark.read.parquet(f"{folder}/{name}") for name in derived}
