"""Rename-mapping files in eleven text formats, read and written as ``mappings`` rows.

A mapping is rows ``(mapping_id, kind, owner, name, desc, target)`` with kind class, field or method.
Lines of all files and formats are parsed in one pass; "current class" state is carried forward in
line order instead of being held by a reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators.ordered import carry_forward
from codelode.session import cut_lineage, written

FORMATS = [
    "PROGUARD", "TINY_V1", "TINY_V2", "SRG", "XSRG", "TSRG", "TSRG_V2", "CSRG", "JOBF", "ENIGMA", "RECAF",
]
_CLASS_BLOCKS = ["PROGUARD", "TINY_V2", "TSRG", "TSRG_V2"]


def read_mapping_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(mapping_id, line_no, line)`` of every file under ``path``; the file is the mapping.

    Files are read by lines, and a large file by several tasks.  A task numbers the lines of its blocks; how many lines lie before
    a block comes from one row per block.
    """
    lines = cut_lineage(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("mapping_id"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
        )
    )
    blocks = lines.groupBy("mapping_id", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("mapping_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("shift")
    placed = lines.join(blocks.select("mapping_id", "block", shift), ["mapping_id", "block"])
    return placed.select("mapping_id", (F.col("at") + F.col("shift")).alias("line_no"), "line")


def read_mapping(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Mapping rows of all files under ``path``; without ``fmt`` each file's format is detected."""
    lines = read_mapping_lines(spark, path)
    if fmt is not None:
        return parse_mapping_lines(lines.withColumn("format", F.lit(fmt)), [fmt])
    formats = cut_lineage(detect_formats(lines))
    unknown = formats.filter(F.col("format").isNull()).first()
    if unknown:
        raise ValueError(f"cannot detect mapping format of {unknown['mapping_id']}")
    present = [r["format"] for r in formats.select("format").distinct().collect()]  # eleven at most
    return parse_mapping_lines(lines.join(formats, "mapping_id"), present)


def _trim(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def detect_formats(lines: DataFrame) -> DataFrame:
    """``(mapping_id, format)`` by the first meaningful line; null when nothing fits.

    The descriptor-less class/field/method format has no rule: its files read as TSRG.
    """
    t = F.col("t")
    wide_field = t.startswith("FD:") & (F.size(F.split(t, r"\s+")) >= 5)
    meant = (t != "") & ~t.startswith("#") & ~t.startswith("//")
    # Numbers and flags are gathered in place; lines would have to be sorted for it, so the first one is looked up.
    firsts = written(
        lines.withColumn("t", _trim(F.col("line"))).groupBy("mapping_id")
        .agg(F.min(F.when(meant, F.col("line_no"))).alias("line_no"), F.bool_or(wide_field).alias("wide")),
        "firsts",
    )
    found = lines.select("mapping_id", "line_no", "line").join(firsts.select("mapping_id", "line_no"), ["mapping_id", "line_no"])
    found = found.withColumn("t", _trim(F.col("line"))).filter(meant).groupBy("mapping_id").agg(F.min("t").alias("t"))
    told = firsts.join(found, "mapping_id", "left").select("mapping_id", "t", "wide")
    starts = lambda *heads: S._any([t.startswith(h) for h in heads])
    parts = F.split(t, r"\s+")
    fmt = (
        F.when(starts("tiny\t2\t", "tiny 2 "), "TINY_V2")
        .when(starts("v1\t"), "TINY_V1")
        .when(starts("tsrg2 ", "tsrg2\t"), "TSRG_V2")
        .when(starts(".class_map", ".field_map", ".method_map"), "JOBF")
        .when(starts("CL:", "FD:", "MD:", "PK:"), F.when(F.col("wide"), "XSRG").otherwise("SRG"))
        .when(starts("CLASS "), "ENIGMA")
        .when(t.contains(" -> ") & t.endswith(":"), "PROGUARD")
        .when(~t.contains("->") & ~t.contains(":") & t.rlike(r"^[\w/$]+\s+[\w/$]+"), "TSRG")
        .when((F.size(parts) == 2) & F.get(parts, 0).contains("."), "RECAF")
    )
    return told.select("mapping_id", fmt.alias("format"))


# --- parsing -----------------------------------------------------------------------------------


def _entry(kind: str, owner: Column, target: Column, name: Column | None = None, desc: Column | None = None) -> Column:
    blank = F.lit("")
    return F.struct(
        F.lit(kind).alias("kind"),
        owner.alias("owner"),
        (blank if name is None else name).alias("name"),
        (blank if desc is None else desc).alias("desc"),
        target.alias("target"),
    )


def _slash(name: Column) -> Column:
    return F.translate(name, ".", "/")


def _head(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.+)/[^/]*\z", 1)


def _last(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parse_mapping_lines(lines: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Parse ``(mapping_id, format, line_no, line)`` rows; a key given twice keeps its last target.

    Lines are spread and written down once, by format.  Each of ``formats`` (those that can occur) is a branch of its own with a few
    expressions per line, and reads its own lines only.
    """
    line = F.col("line")
    usable = (F.regexp_replace(line, r"\s", "") != "") & ~line.startswith("#")
    formats = formats or FORMATS
    tidy = lines.filter(usable & F.col("format").isin(formats)).withColumn("t", _trim(line)).select("mapping_id", "line_no", "line", "t", "format")
    tidy = written(tidy.hint("rebalance", "format"), "lines", "format")
    found = None
    for fmt in formats:
        rows = tidy.filter(F.col("format") == fmt).withColumn("p", F.split("t", r"\s+"))
        branch = _parse_nested(rows) if fmt == "ENIGMA" else _parse_lines_of(rows, fmt)
        found = branch if found is None else found.unionByName(branch)
    return last_targets(found, "line_no")


def _after_header(rows: DataFrame, fmt: str) -> DataFrame:
    """Drop the header line; a header is only a header on the first line of its file."""
    first = rows.groupBy("mapping_id").agg(F.min("line_no").alias("first_no"))
    rows = rows.join(first, "mapping_id")
    is_first = F.col("line_no") == F.col("first_no")
    if fmt == "TSRG_V2":
        return rows.filter(~(is_first & F.col("t").startswith("tsrg2")))
    is_head = F.col("line").rlike("^tiny\t2\t[^\t]*\t[^\t]*\t")
    bad = rows.filter(is_first & ~is_head).first()
    if bad:
        raise ValueError(f"Tiny v2 header missing in {bad['mapping_id']}")
    return rows.filter(~is_first)


def _only(text: Column, marks: str) -> Column:
    """Nothing but word characters and the given marks, and something."""
    return (text != "") & ~text.rlike(f"[^A-Za-z0-9_{marks}]")


def _arrow_class(line: Column) -> tuple[Column, Column, Column]:
    """``original -> new:`` at the start of a line: whether it is that, and both names."""
    sides = F.split(line, r"\s*->\s*")
    old, new = F.get(sides, 0), F.get(sides, 1)
    bare = F.substring_index(new, ":", 1)
    names = _only(old, r"$.\[\]") & _only(bare, r"$.\[\]")
    return F.coalesce((F.size(sides) == 2) & (new == F.concat(bare, F.lit(":"))) & names, F.lit(False)), old, bare


def _arrow_member(line: Column) -> tuple[Column, Column, Column, Column, Column, Column]:
    """``type name -> new`` or ``type name(parameters) -> new``, indented, with line ranges before the type and after the
    member: whether it is that, whether it is a method, and type, name, parameters and new name."""
    sides = F.split(line, r"\s*->\s*")
    new = F.get(sides, 1)
    # A range is two numbers with a colon each; what is left of the arrow reads: range, type, blank, member, range.
    words = F.split(F.regexp_replace(F.trim(F.translate(F.get(sides, 0), "\t", " ")), r"^\d+:\d+:", ""), r"\s+", 2)
    kind, rest = F.get(words, 0), F.get(words, 1)
    is_method = rest.contains("(")
    inside = F.substring_index(F.substring_index(rest, ")", 1), "(", -1)
    name = F.trim(F.substring_index(F.when(is_method, F.substring_index(rest, "(", 1)).otherwise(rest), ":", 1))
    after = F.when(is_method, F.substring_index(rest, ")", -1)).otherwise(F.regexp_replace(rest, r"^[^:]*", ""))
    ranged = F.regexp_replace(after, r"\s", "").rlike(r"^(:\d+:\d+)?\z")
    closed = ~is_method | (F.regexp_count(rest, F.lit(r"\)")) == 1) & (F.instr(rest, "(") < F.instr(rest, ")"))
    good = line.rlike(r"^\s") & (F.size(sides) == 2) & _only(kind, r"$.\[\]") & _only(name, "$<>") & _only(new, "$<>") & ranged & closed
    return F.coalesce(good, F.lit(False)), is_method, kind, name, F.when(is_method, inside).otherwise(F.lit("")), new


def _parse_lines_of(rows: DataFrame, fmt: str) -> DataFrame:
    """``(mapping_id, line_no, e)`` of one line-by-line format."""
    if fmt in ("TINY_V2", "TSRG_V2"):
        rows = _after_header(rows, fmt)
    rows = rows.withColumn("tabs", F.split("line", "\t", -1))
    line, cur = F.col("line"), F.col("cur")
    p = lambda i: F.get("p", i)
    tab = lambda i: F.get("tabs", i)
    n, ntab = F.size("p"), F.size("tabs")
    indent = F.length(F.regexp_extract("line", "^(\t*)", 1))
    indented = line.startswith("\t") | line.startswith(" ")
    opens_class = {
        "PROGUARD": F.when(_arrow_class(line)[0], _slash(_arrow_class(line)[2])),
        "TINY_V2": F.when((ntab >= 3) & (tab(0) == "c"), tab(1)),
        "TSRG": F.when(~indented & (n >= 2) & (p(0) != "tsrg2"), p(0)),
        "TSRG_V2": F.when((indent == 0) & (n >= 2), p(0)),
    }
    if fmt in opens_class:
        rows = carry_forward(rows, ["mapping_id"], "line_no", {"cur": opens_class[fmt]})

    if fmt == "PROGUARD":
        is_class, old, _ = _arrow_class(line)
        is_member, is_method, kind, name, inside, new = _arrow_member(line)
        method_desc = F.concat(F.lit("("), S.parameters_to_descriptor(inside), F.lit(")"), S.type_to_descriptor(kind))
        member = F.when(is_method, _entry("method", cur, name, new, method_desc)).otherwise(_entry("field", cur, name, new, S.type_to_descriptor(kind)))
        entry = F.when(is_class, _entry("class", cur, _slash(old))).when(is_member & cur.isNotNull(), member)
    elif fmt == "TINY_V1":
        entry = (
            F.when((tab(0) == "CLASS") & (ntab >= 3), _entry("class", tab(1), tab(2)))
            .when((tab(0) == "FIELD") & (ntab >= 5), _entry("field", tab(1), tab(4), tab(3), tab(2)))
            .when((tab(0) == "METHOD") & (ntab >= 5), _entry("method", tab(1), tab(4), tab(3), tab(2)))
        )
    elif fmt == "TINY_V2":
        changed = lambda new, old: (new != "") & (new != old)
        member = (ntab >= 5) & (tab(0) == "") & cur.isNotNull() & changed(tab(4), tab(3))
        entry = (
            F.when((tab(0) == "c") & (ntab >= 3) & changed(tab(2), tab(1)), _entry("class", tab(1), tab(2)))
            .when(member & (tab(1) == "f"), _entry("field", cur, tab(4), tab(3), tab(2)))
            .when(member & (tab(1) == "m"), _entry("method", cur, tab(4), tab(3), tab(2)))
        )
    elif fmt in ("SRG", "XSRG"):
        both = lambda a, b: (_head(a) != "") & (_head(b) != "")
        named = p(2) if fmt == "SRG" else p(3)
        enough = 3 if fmt == "SRG" else 5
        desc = None if fmt == "SRG" else p(2)
        entry = (
            F.when((p(0) == "CL:") & (n >= 3), _entry("class", p(1), p(2)))
            .when((p(0) == "FD:") & (n >= enough) & both(p(1), named), _entry("field", _head(p(1)), _last(named), _last(p(1)), desc))
            .when((p(0) == "MD:") & (n >= 5) & both(p(1), p(3)), _entry("method", _head(p(1)), _last(p(3)), _last(p(1)), p(2)))
        )
    elif fmt == "TSRG":
        inside = indented & cur.isNotNull()
        entry = (
            F.when(~indented & (n >= 2) & (p(0) != "tsrg2"), _entry("class", p(0), p(1)))
            .when(inside & (n == 2), _entry("field", cur, p(1), p(0)))
            .when(inside & (n >= 3), _entry("method", cur, p(2), p(0), p(1)))
        )
    elif fmt == "TSRG_V2":
        inside = (indent == 1) & cur.isNotNull()
        entry = (
            F.when((indent == 0) & (n >= 2), _entry("class", p(0), p(1)))
            .when(inside & (n >= 3) & p(1).startswith("("), _entry("method", cur, p(2), p(0), p(1)))
            .when(inside & (n >= 2), _entry("field", cur, p(1), p(0)))
        )
    elif fmt == "CSRG":
        entry = (
            F.when(n == 2, _entry("class", p(0), p(1)))
            .when(n == 3, _entry("field", p(0), p(2), p(1)))
            .when((n == 4) & p(2).startswith("("), _entry("method", p(0), p(3), p(1), p(2)))
        )
    elif fmt == "JOBF":
        before = F.substring_index(p(1), "(", 1)
        entry = F.when(F.col("t").startswith("//") | (n < 3), None).otherwise(
            F.when(p(0) == ".class_map", _entry("class", _slash(p(1)), _slash(p(2))))
            .when(
                (p(0) == ".field_map") & (_before_dot(p(1)) != ""),
                _entry("field", _slash(_before_dot(p(1))), p(2), _after_dot(p(1))),
            )
            .when(
                (p(0) == ".method_map") & p(1).contains("(") & (_before_dot(before) != ""),
                _entry("method", _slash(_before_dot(before)), p(2), _after_dot(before), _from_paren(p(1))),
            )
        )
    elif fmt == "RECAF":
        head = F.substring_index(p(0), "(", 1)
        has_paren = p(0).contains("(") & (head != "")
        entry = F.when(
            n == 2,
            F.when(
                has_paren & (_before_dot(head) != ""),
                _entry("method", _before_dot(head), p(1), _after_dot(head), _from_paren(p(0))),
            )
            .when(~has_paren & (_before_dot(p(0)) != ""), _entry("field", _before_dot(p(0)), p(1), _after_dot(p(0))))
            .otherwise(_entry("class", p(0), p(1))),
        )
    else:
        raise ValueError(f"unknown mapping format {fmt}")
    return _entries_of(rows, entry)


def _entries_of(rows: DataFrame, entry: Column) -> DataFrame:
    """The entries of lines that have one; a generator, so that the entry is worked out once per line."""
    return rows.select("mapping_id", "line_no", F.inline(F.filter(F.array(entry), lambda e: e.isNotNull())))


def _before_dot(x: Column) -> Column:
    return F.regexp_extract(x, r"^(.+)\.[^.]*\z", 1)


def _after_dot(x: Column) -> Column:
    return F.substring_index(x, ".", -1)


def _from_paren(x: Column) -> Column:
    return F.regexp_extract(x, r"^[^(]*(\(.*)\z", 1)


def last_targets(rows: DataFrame, order: str) -> DataFrame:
    """One row per mapped item: the last target given in ``order``."""
    return rows.groupBy("mapping_id", "kind", "owner", "name", "desc").agg(F.max_by("target", order).alias("target"))


def _parse_nested(lines: DataFrame) -> DataFrame:
    """The tab-nested format: inner classes are ``outer$inner`` by their place in the file.

    A class stays open at its indent until any line at that indent or less.  So for each indent the
    last line at or below it says whether a class is open there; all indents are carried forward in
    one pass, and the open classes of a line are folded from the outside in.
    """
    p = lambda i: F.get("p", i)
    n = F.size("p")
    rows = lines.filter(~F.col("t").startswith("#")).withColumn("indent", F.length(F.regexp_extract("line", "^(\t*)", 1)))
    is_class = (p(0) == "CLASS") & (n >= 2)
    deepest = rows.agg(F.max(F.when(is_class, F.col("indent")))).first()[0]
    nesting = 1 + (deepest or 0)
    opened = F.struct(
        (is_class).alias("open"), p(1).alias("obf"), F.when(n >= 3, p(2)).alias("named")
    )
    closed = F.struct(
        F.lit(False).alias("open"), F.lit(None).cast("string").alias("obf"), F.lit(None).cast("string").alias("named")
    )
    levels = {
        f"at{j}": F.when(is_class & (F.col("indent") == j), opened).when(F.col("indent") <= j, closed)
        for j in range(nesting)
    }
    carried = carry_forward(rows, ["mapping_id"], "line_no", levels)
    stack = F.filter(
        F.array(*[F.when(F.col("indent") > j, F.col(f"at{j}")) for j in range(nesting)]),
        lambda s: F.coalesce(s["open"], F.lit(False)),
    )

    def enter(outer: Column, cls: Column) -> Column:
        full = F.when(outer["full"] == "", cls["obf"]).otherwise(F.concat(outer["full"], F.lit("$"), cls["obf"]))
        inner = (outer["full"] != "") & ~cls["named"].contains("/")
        renamed = F.when(inner, F.concat(outer["mapped"], F.lit("$"), cls["named"])).otherwise(cls["named"])
        kept = cls["named"].isNull() | (cls["named"] == full)
        return F.struct(full.alias("full"), F.when(kept, full).otherwise(renamed).alias("mapped"), (~kept).alias("renamed"))

    start = F.struct(F.lit("").alias("full"), F.lit("").alias("mapped"), F.lit(False).alias("renamed"))
    placed = carried.withColumn("outer", F.aggregate(stack, start, enter)).withColumn("own", enter(F.col("outer"), opened))
    owner = F.col("outer.full")
    in_class = (owner != "") & (n >= 4) & (p(1) != p(2))
    entry = (
        F.when(is_class & F.col("own.renamed"), _entry("class", F.col("own.full"), F.col("own.mapped")))
        .when((p(0) == "FIELD") & in_class, _entry("field", owner, p(2), p(1), p(3)))
        .when((p(0) == "METHOD") & in_class, _entry("method", owner, p(2), p(1), p(3)))
    )
    return _entries_of(placed, entry)


# --- writing -----------------------------------------------------------------------------------

HEADERS = {"TINY_V1": "v1\tofficial\tnamed", "TINY_V2": "tiny\t2\t0\tofficial\tnamed", "TSRG_V2": "tsrg2 obf named"}
ORDER = ["section", "group_key", "rank", "name", "desc"]


def mapping_lines(mappings: DataFrame, fmt: str) -> DataFrame:
    """Lines of one format with their sort key ``(mapping_id, section, group_key, rank, name, desc)``.

    The original order of members is undefined, so they are sorted by owner, kind, name and desc.
    """
    kind, owner, name, desc, target = (F.col(c) for c in ("kind", "owner", "name", "desc", "target"))
    is_class, is_field = kind == "class", kind == "field"
    classes = mappings.filter(is_class).select("mapping_id", "owner", F.col("target").alias("named_owner"))
    rows = mappings.join(classes, ["mapping_id", "owner"], "left")
    in_block = fmt in (*_CLASS_BLOCKS, "ENIGMA")
    if in_block and fmt != "PROGUARD":
        # Owners that only have members still get their class line.
        bare = (
            rows.filter(F.col("named_owner").isNull())
            .select("mapping_id", "owner")
            .distinct()
            .select(
                "mapping_id", "owner", F.lit("class").alias("kind"), F.lit("").alias("name"),
                F.lit("").alias("desc"), F.col("owner").alias("target"), F.lit(None).cast("string").alias("named_owner"),
            )
        )
        rows = rows.unionByName(bare)
    named = F.coalesce("named_owner", "owner")
    tab, sp = F.lit("\t"), F.lit(" ")
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    dots = lambda x: F.translate(x, "/", ".")
    if fmt == "TINY_V1":
        line = (
            F.when(is_class, c("CLASS\t", owner, tab, target))
            .when(is_field, c("FIELD\t", owner, tab, desc, tab, name, tab, target))
            .otherwise(c("METHOD\t", owner, tab, desc, tab, name, tab, target))
        )
    elif fmt == "TINY_V2":
        line = F.when(is_class, c("c\t", owner, tab, target)).otherwise(
            c("\t", F.when(is_field, "f").otherwise("m"), tab, desc, tab, name, tab, target)
        )
    elif fmt in ("SRG", "XSRG"):
        field = c("FD: ", owner, "/", name, sp, named, "/", target)
        if fmt == "XSRG":
            field = c("FD: ", owner, "/", name, sp, desc, sp, named, "/", target, sp, desc)
        line = (
            F.when(is_class, c("CL: ", owner, sp, target))
            .when(is_field, field)
            .otherwise(c("MD: ", owner, "/", name, sp, desc, sp, named, "/", target, sp, desc))
        )
    elif fmt in ("TSRG", "TSRG_V2"):
        line = (
            F.when(is_class, c(owner, sp, target))
            .when(is_field, c("\t", name, sp, target))
            .otherwise(c("\t", name, sp, desc, sp, target))
        )
    elif fmt == "CSRG":
        line = (
            F.when(is_class, c(owner, sp, target))
            .when(is_field, c(owner, sp, name, sp, target))
            .otherwise(c(owner, sp, name, sp, desc, sp, target))
        )
    elif fmt == "JOBF":
        line = (
            F.when(is_class, c(".class_map ", dots(owner), sp, target))
            .when(is_field, c(".field_map ", dots(owner), ".", name, sp, target))
            .otherwise(c(".method_map ", dots(owner), ".", name, desc, sp, target))
        )
    elif fmt == "RECAF":
        line = (
            F.when(is_class, c(owner, sp, target))
            .when(is_field, c(owner, ".", name, sp, target))
            .otherwise(c(owner, ".", name, desc, sp, target))
        )
    elif fmt == "ENIGMA":
        line = F.when(is_class, c("CLASS ", owner, sp, target)).otherwise(
            c("\t", F.when(is_field, "FIELD ").otherwise("METHOD "), name, sp, target, sp, desc)
        )
    elif fmt == "PROGUARD":
        rows = rows.filter(is_class | F.col("named_owner").isNotNull())
        line = (
            F.when(is_class, c(dots(target), " -> ", dots(owner), ":"))
            .when(is_field, c("    ", S.descriptor_to_type(desc), sp, target, " -> ", name))
            .otherwise(c("    ", S.method_return_type(desc), sp, target, S.method_parameter_types(desc), " -> ", name))
        )
    else:
        raise ValueError(f"unknown mapping format {fmt}")
    if in_block:
        group = F.coalesce("named_owner", "owner") if fmt == "PROGUARD" else owner
        section = F.when((F.lit(fmt) == "ENIGMA") & F.col("named_owner").isNull(), 2).otherwise(1)
        rank = F.when(is_class, 0).when(is_field, 2).otherwise(1)
        # Two classes of one original name keep their members under their own line.
        key = c(group, "\u0000", owner)
    else:
        section = F.when(is_class, 1).when(is_field, 2).otherwise(3)
        rank, key = F.lit(0), owner
    out = rows.select(
        "mapping_id", section.alias("section"), key.alias("group_key"), rank.alias("rank"), "name", "desc", line.alias("line")
    )
    if fmt in HEADERS:
        head = mappings.select("mapping_id").distinct().select(
            "mapping_id", F.lit(0).alias("section"), F.lit("").alias("group_key"), F.lit(0).alias("rank"),
            F.lit("").alias("name"), F.lit("").alias("desc"), F.lit(HEADERS[fmt]).alias("line"),
        )
        out = head.unionByName(out)
    return out


def write_mapping(mappings: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> None:
    """Write one mapping as text: range-partitioned, so the part files read in order are the file."""
    lines = mapping_lines(mappings, fmt)
    lines.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).select("line").write.mode(mode).text(path)


def write_mappings(mappings: DataFrame, fmt: str, path: str, mode: str = "overwrite") -> None:
    """Write many mappings in one job: a folder ``mapping_id=...`` each, whose part files read in the order of their names are the file.

    Lines are range-partitioned by mapping and place, so small mappings share a task and a large one is spread over several, in order.
    """
    lines = mapping_lines(mappings.withColumn("mapping_id", F.coalesce("mapping_id", F.lit("none"))), fmt)
    # A column that may be null would be sorted once more on its way out, and lines would lose their order.
    lines = lines.withColumn("mapping_id", F.coalesce("mapping_id", F.lit("none")))
    laid_out = lines.repartitionByRange("mapping_id", *ORDER).sortWithinPartitions("mapping_id", *ORDER)
    laid_out.select("mapping_id", "line").write.mode(mode).partitionBy("mapping_id").text(path)
