"""Row-level expressions on Columns; all but the string entropy stay inside the JVM."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: file-name rules, in test order (first hit wins) -----------------------------
SUFFIX_KINDS = [
    ("NATIVE_DLL", [".dll"]),
    ("NATIVE_SO", [".so"]),
    ("NATIVE_DYLIB", [".dylib", ".jnilib"]),
    ("NESTED_JAR", [".jar"]),
    ("NESTED_WAR", [".war"]),
    ("NESTED_ZIP", [".zip"]),
]
SUFFIX_KINDS_AFTER_META = [
    ("PROPERTIES", [".properties"]),
    ("XML", [".xml", ".xsd", ".xslt"]),
    ("JSON", [".json"]),
    ("YAML", [".yaml", ".yml"]),
    ("TEXT", [".txt", ".md", ".rst", ".csv", ".log"]),
    ("IMAGE", [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp"]),
    ("FONT", [".ttf", ".otf", ".woff", ".woff2"]),
    ("SQL", [".sql"]),
    ("SCRIPT", [".sh", ".bat", ".cmd", ".ps1"]),
    ("BINARY", [".bin", ".dat"]),
]
TEXT_KINDS = ["MANIFEST", "SERVICE", "PROPERTIES", "XML", "JSON", "YAML", "TEXT", "SQL", "SCRIPT"]
# --- fixed values: magic numbers as upper-case hex prefixes, in test order ---------------------
MAGIC_KINDS = [
    ("JAVA_CLASS", ["CAFEBABE"]),
    ("NESTED_JAR", ["504B0304"]),
    ("IMAGE", ["89504E47", "47494638", "FFD8FF", "424D"]),
    ("FONT", ["774F4646", "774F4632", "00010000", "4F54544F"]),
    ("NATIVE_SO", ["7F454C46"]),
    ("NATIVE_DLL", ["4D5A"]),
    ("NATIVE_DYLIB", ["FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE"]),
]


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def resource_kind(path: Column) -> Column:
    """Kind of an archive entry by its name."""
    low = F.lower(path)
    ends = lambda suffixes: _any([low.endswith(s) for s in suffixes])
    # Class files are tested first, so MODULE_INFO can never be reported.
    out = F.when(low.endswith(".class"), "JAVA_CLASS")
    for kind, suffixes in SUFFIX_KINDS:
        out = out.when(ends(suffixes), kind)
    out = out.when((low == "manifest.mf") | low.endswith("/manifest.mf"), "MANIFEST")
    out = out.when(low.startswith("meta-inf/services/") | low.contains("/meta-inf/services/"), "SERVICE")
    for kind, suffixes in SUFFIX_KINDS_AFTER_META:
        out = out.when(ends(suffixes), kind)
    return out.otherwise("OTHER")


def resource_kind_by_content(content: Column) -> Column:
    """Kind by magic number, else by how printable the first 256 bytes are; null when neither tells."""
    head = F.hex(F.substring(content, 1, 4))
    sample = F.decode(F.substring(content, 1, 256), "ISO-8859-1")
    printable = F.length(F.regexp_replace(sample, r"[^\t\n\r\x20-\x7e\xc0-\xff]", ""))
    prefix = F.lower(F.regexp_replace(F.substring(sample, 1, 64), r"^[\x00-\x20]+", ""))
    is_text = printable * 10 > F.length(sample) * 9
    out = F.when(F.length(content) < 4, None)
    for kind, magics in MAGIC_KINDS:
        out = out.when(_any([head.startswith(m) for m in magics]), kind)
    return (
        out.when(is_text & prefix.startswith("<?xml"), "XML")
        .when(is_text & (prefix.startswith("{") | prefix.startswith("[")), "JSON")
        .when(is_text & prefix.startswith("#!"), "SCRIPT")
        .when(is_text, "TEXT")
    )


def entry_kind(path: Column, content: Column) -> Column:
    """Name rule first; the content rule only decides what the name leaves open."""
    by_name = resource_kind(path)
    by_content = resource_kind_by_content(F.substring(content, 1, 256))
    return F.when(by_name == "OTHER", F.coalesce(by_content, by_name)).otherwise(by_name)


def dotted(internal: Column) -> Column:
    return F.translate(internal, "/", ".")


def package_of(internal: Column) -> Column:
    return dotted(F.regexp_extract(internal, r"^(.*)/[^/]*$", 1))


def simple_name(name: Column, sep: str = "/") -> Column:
    return F.substring_index(name, sep, -1)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def decode_comment_key(key: Column) -> Column:
    """``CLASS:fqn`` or ``METHOD|FIELD:fqn:name:desc`` (member parts taken from the right); null if neither."""
    member = r"(?s)^(METHOD|FIELD):(.*):([^:]*):([^:]*)\z"
    is_class = key.startswith("CLASS:")
    is_member = key.rlike(member)
    part = lambda i: F.regexp_extract(key, member, i)
    nothing = F.lit(None).cast("string")
    parsed = F.struct(
        F.when(is_class, F.lit("class")).otherwise(F.lower(part(1))).alias("kind"),
        F.when(is_class, F.substring(key, 7, 1 << 30)).otherwise(part(2)).alias("class_fqn"),
        F.when(is_class, nothing).otherwise(part(3)).alias("member"),
        F.when(is_class, nothing).otherwise(part(4)).alias("member_desc"),
    )
    return F.when(is_class | is_member, parsed)


def number_equals(a: Column, b: Column, floating: bool = False) -> Column:
    """Integers match when equal or equal in the low 32 bits; floating values match as doubles."""
    if floating:
        return a.cast("double") == b.cast("double")
    mask = F.lit(0xFFFFFFFF).cast("long")
    return (a == b) | (a.bitwiseAND(mask) == b.bitwiseAND(mask))


def included_by_prefix(fqn: Column, package_filter: str | None) -> Column:
    """Raw prefix test: ``com.foo`` also admits ``com.foobar``."""
    text = (package_filter or "").strip()
    return fqn.startswith(text.removesuffix("*")) if text else F.lit(True)


def excluded_by_packages(fqn: Column, patterns: list[str] | None) -> Column:
    """True when ``fqn`` is, or lies under, one of ``patterns`` (trailing ``*`` and ``.`` ignored)."""
    heads = [p.strip().removesuffix("*").removesuffix(".") for p in patterns or [] if p]
    heads = [h for h in heads if h]
    return _any([(fqn == h) | fqn.startswith(h + ".") for h in heads]) if heads else F.lit(False)


def utf16_length(text: Column) -> Column:
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def first_match(text: Column, java_regex: str) -> Column:
    """``struct(start, end)`` of the first match in UTF-16 units, null when there is none."""
    pattern = F.lit(java_regex)
    start = F.regexp_instr(text, pattern) - 1
    found = F.regexp_substr(text, pattern)
    return F.when(
        text.rlike(java_regex),
        F.struct(start.cast("int").alias("start"), (start + utf16_length(found)).cast("int").alias("end")),
    )


def utf16_slice(text: Column, start: Column, end: Column) -> Column:
    """The UTF-16 units ``start`` to ``end`` of a text; a character that an edge would halve is left out."""
    units = F.encode(text, "UTF-16BE")
    halved = lambda at: F.hex(F.substring(units, 2 * at + 1, F.lit(1))).between("DC", "DF").cast("int")
    low, high = start + halved(start), end - halved(end)
    return F.decode(F.substring(units, 2 * low + 1, F.greatest(F.lit(0), 2 * (high - low))), "UTF-16BE")


def literal_regex(text: str, whole_word: bool = False, case_sensitive: bool = False) -> str:
    """Java regex that finds ``text`` verbatim."""
    quoted = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    bounded = f"\\b{quoted}\\b" if whole_word else quoted
    return bounded if case_sensitive else "(?iu)" + bounded


def fuzzy_score(haystack: Column, needle: Column) -> Column:
    """Greedy in-order subsequence match: 1 + sum of jumps longer than one; -1 without a match."""
    chars = F.split(F.lower(haystack), "")
    low = F.lower(needle)
    size = F.length(low)
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("used"), F.lit(-1).alias("last"), F.lit(0).alias("gaps")
    )

    def step(acc: Column, ch: Column) -> Column:
        hit = (acc.used < size) & (ch == F.substring(low, acc.used + 1, F.lit(1)))
        jump = acc.at - acc.last
        return F.struct(
            (acc.at + 1).alias("at"),
            F.when(hit, acc.used + 1).otherwise(acc.used).alias("used"),
            F.when(hit, acc.at).otherwise(acc.last).alias("last"),
            (acc.gaps + F.when(hit & (acc.last >= 0) & (jump > 1), jump).otherwise(0)).alias("gaps"),
        )

    score = F.aggregate(chars, start, step, lambda acc: F.when(acc.used == size, acc.gaps + 1).otherwise(-1))
    return F.when(F.trim(needle) == "", 0).otherwise(score)


def source_snippet(text: Column, line_no: Column, width: int = 120) -> Column:
    """Trimmed source line ``line_no`` (from 1), cut with an ellipsis; null when absent or blank."""
    line = F.get(F.split(text, "\n", -1), line_no - 1)
    clean = F.regexp_replace(F.regexp_replace(line, r"[ \t\r]+\z", ""), r"^[ \t]+", "")
    cut = F.when(
        utf16_length(clean) > width, F.concat(utf16_slice(clean, F.lit(0), F.lit(width - 1)), F.lit("…"))
    ).otherwise(clean)
    return F.when((line_no > 0) & (clean != ""), cut)


def match_snippet(text: Column, start: Column, end: Column, before: int = 40, after: int = 80) -> Column:
    """The match with up to ``before``/``after`` UTF-16 units around it, marked where text was left out."""
    size = utf16_length(text)
    lo = F.greatest(F.lit(0), start - before)
    hi = F.least(size, end + after)
    return F.concat(
        F.when(lo > 0, "…").otherwise(""),
        utf16_slice(text, lo, hi),
        F.when(hi < size, "…").otherwise(""),
    )


@F.pandas_udf(T.DoubleType())
def shannon_entropy(texts: pd.Series) -> pd.Series:
    """Bits per character over the low byte of each UTF-16 unit; 0 for empty or absent text.

    A batch is one numpy histogram; the built-in array functions would visit each character in turn.
    """
    raw = [(t or "").encode("utf-16-le", "surrogatepass")[::2] for t in texts]
    out = np.zeros(len(raw))
    for at in range(0, len(raw), 1024):
        part = raw[at : at + 1024]
        sizes = np.array([len(r) for r in part])
        cells = np.repeat(np.arange(len(part)) * 256, sizes) + np.frombuffer(b"".join(part), dtype=np.uint8)
        hist = np.bincount(cells, minlength=len(part) * 256).reshape(-1, 256)
        p = hist / np.maximum(sizes, 1)[:, None]
        out[at : at + 1024] = -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=1) + 0.0
    return pd.Series(out)


def control_char_heavy(text: Column) -> Column:
    controls = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return (controls > 2) & (controls > F.floor(utf16_length(text) / 10))


IDENTIFIER = r"^\p{javaJavaIdentifierStart}[\p{javaJavaIdentifierPart}&&[^\x00-\x1F\x7F]]*\z"

# --- fixed values: words of the Java language that cannot be identifiers -----------------------
JAVA_WORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double "
    "else enum extends final finally float for goto if implements import instanceof int interface "
    "long native new null package private protected public return short static strictfp super "
    "switch synchronized this throw throws transient try void volatile while true false"
).split()


def is_legal_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def is_java_word(name: Column) -> Column:
    return name.isin(JAVA_WORDS)


def annotation_desc_valid(desc: Column) -> Column:
    return F.coalesce(desc.rlike(r"^L[^.;\[<>\x00-\x1F]+;\z"), F.lit(False))


# --- fixed values: primitive type letters of the class-file format -----------------------------
PRIMITIVES = {
    "boolean": "Z",
    "byte": "B",
    "char": "C",
    "short": "S",
    "int": "I",
    "long": "J",
    "float": "F",
    "double": "D",
    "void": "V",
}


def _lookup(pairs: dict, key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.element_at(table, key)


def type_to_descriptor(java_type: Column) -> Column:
    base = F.regexp_replace(java_type, r"(\[\])+\z", "")
    dims = ((F.length(java_type) - F.length(base)) / 2).cast("int")
    name = F.trim(base)
    plain = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv]), name),
        F.concat(F.lit("L"), F.translate(name, ".", "/"), F.lit(";")),
    )
    return F.concat(F.repeat(F.lit("["), dims), plain)


def parameters_to_descriptor(parameter_list: Column) -> Column:
    """``int,java.lang.String`` to ``ILjava/lang/String;``; empty stays empty."""
    joined = F.array_join(F.transform(F.split(parameter_list, ","), lambda p: type_to_descriptor(F.trim(p))), "")
    return F.when(parameter_list == "", "").otherwise(joined)


def descriptor_to_type(desc: Column) -> Column:
    dims = F.length(F.regexp_extract(desc, r"^(\[*)", 1))
    core = F.regexp_replace(desc, r"^\[+", "")
    reverse = F.create_map(*[F.lit(x) for name, letter in PRIMITIVES.items() for x in (letter, name)])
    named = F.translate(F.regexp_extract(core, r"^L(.*);\z", 1), "/", ".")
    plain = F.coalesce(F.try_element_at(reverse, core), F.when(named != "", named), core)
    return F.concat(plain, F.repeat(F.lit("[]"), dims))


def method_return_type(desc: Column) -> Column:
    return descriptor_to_type(F.substring_index(desc, ")", -1))


def method_parameter_types(desc: Column) -> Column:
    """``(I[La/B;)V`` to ``(int,a.B[])``."""
    inner = F.regexp_extract(desc, r"^\((.*)\)", 1)
    tokens = F.regexp_extract_all(inner, F.lit(r"(\[*(?:L[^;]*;|[^L\[]))"), F.lit(1))
    return F.concat(F.lit("("), F.array_join(F.transform(tokens, descriptor_to_type), ","), F.lit(")"))


def jni_unmangle(text: Column) -> Column:
    """Undo the underscore escapes of native symbol names, scanning left to right."""
    tokens = F.regexp_extract_all(text, F.lit("(_0[0-9a-fA-F]{4}|_[123]|_|[^_]+)"), F.lit(1))

    def plain(tok: Column) -> Column:
        return (
            F.when(tok == "_1", "_")
            .when(tok == "_2", ";")
            .when(tok == "_3", "[")
            .when(tok == "_", "/")
            .when(tok.startswith("_0"), F.decode(F.unhex(F.substring(tok, 3, 4)), "UTF-16BE"))
            .otherwise(tok)
        )

    return F.array_join(F.transform(tokens, plain), "")


def jni_parse(symbol: Column) -> Column:
    """``struct(class_fqn, method, desc)`` of a ``Java_`` symbol, null when it is not one."""
    rest = F.substring(symbol, 6, 1 << 30)
    cut = F.instr(rest, "__")
    body = jni_unmangle(F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest))
    desc = F.when(cut > 0, jni_unmangle(F.substring(rest, cut + 2, F.length(rest))))
    owner = F.regexp_extract(body, r"(?s)^(.*)/[^/]*\z", 1)
    method = F.substring_index(body, "/", -1)
    ok = symbol.startswith("Java_") & body.contains("/") & (owner != "") & (method != "")
    return F.when(
        ok, F.struct(dotted(owner).alias("class_fqn"), method.alias("method"), desc.alias("desc"))
    )


def descriptor_tokens(desc: Column) -> Column:
    """A descriptor cut into object types and the text between them."""
    return F.regexp_extract_all(desc, F.lit("(L[^;]*;|[^L]+)"), F.lit(1))


def checksums(content: Column) -> dict[str, Column]:
    return {
        "crc32": F.lpad(F.hex(F.crc32(content)), 8, "0"),
        "md5": F.md5(content),
        "sha1": F.sha1(content),
        "sha256": F.sha2(content, 256),
        "sha512": F.sha2(content, 512),
    }


def method_key(owner: Column, name: Column, desc: Column) -> Column:
    return F.concat(owner, F.lit("#"), name, desc)


def field_key(owner: Column, name: Column, desc: Column) -> Column:
    return F.concat(owner, F.lit("."), name, F.lit(":"), desc)


def mapping_method_key(owner: Column, name: Column, desc: Column) -> Column:
    return F.concat(owner, F.lit("."), name, desc)


# --- fixed values: processor codes of native library headers -----------------------------------
ELF_MACHINES = {
    0x03: "x86",
    0x3E: "x86_64",
    0x28: "ARM",
    0xB7: "AArch64",
    0x08: "MIPS",
    0xF3: "RISC-V",
    0x14: "PowerPC",
    0x15: "PowerPC64",
}
ELF_ABIS = {0: "System V", 3: "Linux", 6: "Solaris", 9: "FreeBSD", 12: "OpenBSD"}
PE_MACHINES = {
    0x014C: "x86",
    0x8664: "x86_64",
    0x01C0: "ARM",
    0x01C2: "ARM",
    0x01C4: "ARM",
    0xAA64: "ARM64",
    0x0200: "IA64",
}
MACHO_CPUS = {
    (7, False): "x86",
    (7, True): "x86_64",
    (12, False): "ARM",
    (12, True): "ARM64",
    (18, False): "PowerPC",
    (18, True): "PowerPC64",
}


def _uint(content: Column, offset: Column | int, size: int, little: Column | bool) -> Column:
    """Unsigned integer at a 0-based byte offset."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = [F.hex(F.substring(content, at + 1 + i, F.lit(1))) for i in range(size)]
    number = lambda parts: F.conv(F.concat(*parts), 16, 10).cast("long")
    if isinstance(little, bool):
        return number(digits[::-1] if little else digits)
    return F.when(little, number(digits[::-1])).otherwise(number(digits))


def _code_name(table: dict, code: Column, unknown: Column) -> Column:
    names = F.create_map(*[x for value, name in table.items() for x in (F.lit(value).cast("long"), F.lit(name))])
    return F.coalesce(F.try_element_at(names, code), unknown)


def native_header(content: Column) -> Column:
    """``struct(format, arch, bitness, endian, os_abi)`` of a native library, from its header alone."""
    head = F.hex(F.substring(content, 1, 4))
    size = F.length(content)

    def row(fmt, arch, bits, endian, abi):
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            as_col(fmt).alias("format"),
            as_col(arch).alias("arch"),
            as_col(bits).cast("int").alias("bitness"),
            as_col(endian).alias("endian"),
            as_col(abi).alias("os_abi"),
        )

    hexed = lambda code: F.concat(F.lit("unknown (0x"), F.lower(F.hex(code)), F.lit(")"))
    elf_little = F.hex(F.substring(content, 6, 1)) == "01"
    elf_class = F.hex(F.substring(content, 5, 1))
    elf_code = _uint(content, 18, 2, elf_little)
    elf_abi = _uint(content, 7, 1, True)
    elf = row(
        "ELF",
        _code_name(ELF_MACHINES, elf_code, hexed(elf_code)),
        F.when(elf_class == "01", 32).when(elf_class == "02", 64).otherwise(0),
        F.when(elf_little, "little").otherwise("big"),
        _code_name(ELF_ABIS, elf_abi, F.concat(F.lit("ABI "), elf_abi.cast("string"))),
    )
    pe_at = _uint(content, 0x3C, 4, True)
    pe_ok = (size >= 0x40) & (pe_at + 26 <= size)
    pe_sig = F.hex(F.substring(content, pe_at + 1, F.lit(4)))
    pe_code = _uint(content, pe_at + 4, 2, True)
    pe_opt = _uint(content, pe_at + 24, 2, True)
    pe = row(
        "PE",
        _code_name(PE_MACHINES, pe_code, hexed(pe_code)),
        F.when(pe_opt == 0x20B, 64).otherwise(32),
        "little",
        "Windows",
    )
    mach_little = head.isin("CEFAEDFE", "CFFAEDFE")
    mach_cpu = _uint(content, 4, 4, mach_little)
    mach_base = mach_cpu.bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    mach_names = {base + (0x01000000 if wide else 0): name for (base, wide), name in MACHO_CPUS.items()}
    mach_kept = mach_cpu.bitwiseAND(F.lit(0x01FFFFFF).cast("long"))
    mach = row(
        "MACH_O",
        _code_name(mach_names, mach_kept, F.concat(F.lit("cpu "), mach_base.cast("string"))),
        F.when(head.isin("CFFAEDFE", "FEEDFACF"), 64).otherwise(32),
        F.when(mach_little, "little").otherwise("big"),
        "macOS",
    )
    fat = row("MACH_O", "fat (multiple slices)", 0, "?", "macOS")
    unknown = row("UNKNOWN", "?", 0, "?", "?")
    return (
        F.when(size < 4, unknown)
        .when((head == "7F454C46") & (size >= 0x40), elf)
        .when(head.startswith("4D5A") & pe_ok & (pe_sig == "50450000"), pe)
        .when(head.isin("CAFEBABE", "BEBAFECA"), fat)
        .when(head.isin("FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE") & (size >= 8), mach)
        .otherwise(unknown)
    )
