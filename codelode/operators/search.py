"""Text, name, number, comment and regex search with one result schema.

Result rows: ``archive_id, kind, path, label, line, text, start, end, context``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators.identity import base_members, is_base
from codelode.functions.scalars import TEXT_KINDS
from codelode.operators.usage import with_current_line


@dataclass(frozen=True)
class Search:
    """What to look for and where."""

    text: str
    whole_word: bool = False
    case_sensitive: bool = False
    package_filter: str | None = None
    excluded: list[str] = field(default_factory=list)
    in_classes: bool = True
    in_resources: bool = True

    @property
    def blank(self) -> bool:
        return not self.text.strip()

    def literal(self) -> str:
        return S.literal_regex(self.text, self.whole_word, self.case_sensitive)

    def regex(self) -> str:
        return self.text if self.case_sensitive else "(?iu)" + self.text

    def admits(self, fqn: Column) -> Column:
        return S.included_by_prefix(fqn, self.package_filter) & ~S.excluded_by_packages(fqn, self.excluded)


def _hits(rows: DataFrame, text: Column, java_regex: str, wanted: bool = True) -> DataFrame:
    """Keep rows whose text matches and add the position of the first match."""
    if not wanted:
        return rows.limit(0).withColumn("hit", S.first_match(text, "x"))
    return rows.filter(text.rlike(java_regex)).withColumn("hit", S.first_match(text, java_regex))


def _result(rows: DataFrame, kind: str | Column, path, label, line, text, context) -> DataFrame:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select(
        "archive_id",
        col(kind).alias("kind"),
        col(path).alias("path"),
        col(label).alias("label"),
        col(line).cast("int").alias("line"),
        col(text).alias("text"),
        F.col("hit.start").alias("start"),
        F.col("hit.end").alias("end"),
        col(context).alias("context"),
    )


def _is_valid_regex(frame: DataFrame, java_regex: str) -> bool:
    """Ask the JVM whether the pattern compiles."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import IllegalArgumentException

    try:
        frame.sparkSession._jvm.java.util.regex.Pattern.compile(java_regex)
        return True
    except (IllegalArgumentException, Py4JJavaError):
        return False


def resource_lines(resources: DataFrame) -> DataFrame:
    """Lines of the textual resources, numbered from 1; trailing empty lines are kept."""
    # Bytes that are no UTF-8 become replacement characters instead of failing the job.
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return (
        resources.filter(F.col("kind").isin(TEXT_KINDS))
        .select("archive_id", "path", F.posexplode(F.split(text, "\n", -1)).alias("pos", "text"))
        .select("archive_id", "path", (F.col("pos") + 1).cast("int").alias("line_no"), "text")
    )


def _search_text(strings: DataFrame, lines: DataFrame, q: Search, java_regex: str) -> DataFrame:
    fqn = F.col("class_name")
    in_classes = _hits(strings.filter(q.admits(fqn)), F.col("value"), java_regex, q.in_classes)
    in_lines = _hits(lines, F.col("text"), java_regex, q.in_resources)
    return _result(
        in_classes, "CLASS_STRING", fqn, S.simple_name(fqn, "."), F.col("ordinal"), F.col("value"), "CP string"
    ).unionByName(
        # Package filters speak about classes only.
        _result(in_lines, "RESOURCE_TEXT", F.col("path"), F.col("path"), F.col("line_no"), F.col("text"), "")
    )


def search_strings(strings: DataFrame, lines: DataFrame, q: Search) -> DataFrame:
    """``strings(archive_id, class_name, ordinal, value)`` and resource lines against literal text."""
    return _search_text(strings, lines, q, q.literal() if not q.blank else "(?!)")


def search_regex(strings: DataFrame, lines: DataFrame, q: Search) -> DataFrame:
    """Like :func:`search_strings` with a regex; a pattern that does not compile finds nothing."""
    usable = not q.blank and _is_valid_regex(strings, q.regex())
    return _search_text(strings, lines, q, q.regex() if usable else "(?!)")


def search_names(classes: DataFrame, methods: DataFrame, fields: DataFrame, q: Search) -> DataFrame:
    """Class names (line 0), then method and field names numbered within their own list.

    Classes for a certain runtime version repeat the names of those they stand in for, so they and their members are left out.
    """
    methods, fields, classes = base_members(methods, classes), base_members(fields, classes), classes.where(is_base(classes))
    if q.blank or not q.in_classes:
        q = Search("x", in_classes=False)
    regex = q.literal()
    named = classes.select("archive_id", F.col("name").alias("fqn")).filter(q.admits(F.col("fqn")))
    fqn = F.col("fqn")
    label = S.simple_name(fqn, ".")
    out = _result(_hits(named, fqn, regex, q.in_classes), "CLASS_NAME", fqn, label, 0, fqn, "class")
    for members, kind, context in [(methods, "CLASS_METHOD", "method"), (fields, "CLASS_FIELD", "field")]:
        rows = members.withColumn("fqn", S.dotted(F.col("owner"))).filter(q.admits(fqn))
        found = _hits(rows, F.col("name"), regex, q.in_classes)
        out = out.unionByName(_result(found, kind, fqn, label, F.col("ordinal") + 1, F.col("name"), context))
    return out


def search_code(instructions: DataFrame, q: Search) -> DataFrame:
    """The rendered instruction listing, one line per instruction."""
    fqn = S.dotted(F.col("owner"))
    regex = q.literal() if not q.blank else "(?!)"
    found = _hits(instructions.filter(q.admits(fqn)), F.col("text"), regex, q.in_classes)
    return _result(found, "CLASS_BYTECODE", fqn, S.simple_name(fqn, "."), F.col("idx"), F.col("text"), "")


def parse_number(text: str) -> tuple[int | float, bool] | None:
    """``(value, is_floating)`` of a numeric query, or None when it is not a number."""
    s = (text or "").strip()
    if "_" in s or any(c.isspace() for c in s):
        return None
    try:
        if s[:2] in ("0x", "0X"):
            return int(s[2:], 16), False
        if s[-1:] in ("L", "l"):
            return int(s[:-1]), False
        if s[-1:] in ("F", "f"):
            # A float constant holds the nearest single-precision value.
            return float(np.float32(s[:-1])), True
        if s[-1:] in ("D", "d"):
            return float(s[:-1]), True
        if any(c in s for c in ".eE"):
            return float(s), True
        return int(s), False
    except ValueError:
        return None


def search_numbers(instructions: DataFrame, q: Search) -> DataFrame:
    """Numeric literals equal to the query, with the source line they stand on."""
    parsed = parse_number(q.text) if q.in_classes else None
    numbers = instructions.filter(F.col("const_kind").isin("int", "long", "float", "double"))
    is_float = F.col("const_kind").isin("float", "double")
    if parsed is None or (not parsed[1] and not -(2**63) <= parsed[0] < 2**63):
        match = F.lit(False)
    else:
        value, floating = parsed
        as_double = F.coalesce(F.col("const_double"), F.col("const_long").cast("double"))
        by_double = as_double == F.lit(float(value))
        match = by_double if floating else F.when(is_float, by_double).otherwise(
            S.number_equals(F.col("const_long"), F.lit(value).cast("long"))
        )
    fqn = S.dotted(F.col("owner"))
    wanted = match & q.admits(fqn)
    # The line is only needed in methods that have a hit, so the scan is cut down before the window.
    marks = instructions.select(
        "archive_id", "owner", "method", "desc", "idx", "pseudo_kind", "line", "const_kind", "const_long", "const_double",
    ).filter((F.col("pseudo_kind") == "LINE") | (F.col("const_kind").isin("int", "long", "float", "double") & wanted))
    hits = with_current_line(marks).filter(F.col("const_kind").isNotNull())
    shown = F.when(is_float, F.col("const_double").cast("string")).otherwise(F.col("const_long").cast("string"))
    hits = hits.withColumn("shown", shown).withColumn(
        "hit", F.struct(F.lit(0).alias("start"), F.length("shown").alias("end"))
    )
    return _result(
        hits, "CLASS_BYTECODE", fqn, F.col("method"), F.col("current_line"), F.col("shown"),
        F.concat(F.lit("method "), F.col("method"), F.lit(" — "), F.col("shown")),
    )


def present_comments(comments: DataFrame) -> DataFrame:
    """Comments with text; a blank one counts as absent."""
    return comments.filter(F.regexp_replace("text", r"\s", "") != "")


def search_comments(comments: DataFrame, q: Search) -> DataFrame:
    """Comments on classes and members; package filters apply, the class/resource switches do not."""
    decoded = comments.withColumn("c", S.decode_comment_key(F.col("key"))).filter(F.col("c").isNotNull())
    fqn, member, kind = F.col("c.class_fqn"), F.col("c.member"), F.col("c.kind")
    regex = q.literal() if not q.blank else "(?!)"
    found = _hits(decoded.filter(q.admits(fqn)), F.col("text"), regex)
    context = (
        F.when(kind == "class", F.lit("class comment"))
        .when(kind == "method", F.concat(F.lit("method "), member, F.lit("() comment")))
        .otherwise(F.concat(F.lit("field "), member, F.lit(" comment")))
    )
    return _result(found, "COMMENT", fqn, S.simple_name(fqn, "."), 0, F.col("text"), context)


# --- string literals ---------------------------------------------------------------------------


def build_string_sites(instructions: DataFrame, fields: DataFrame) -> DataFrame:
    """String literals of code, bootstrap arguments and constant fields."""
    used = instructions.select(
        "archive_id", "owner", "method", "desc", "idx", "pseudo_kind", "line", "const_kind", "const_str", "bsm_strings"
    ).filter((F.col("pseudo_kind") == "LINE") | (F.col("const_kind") == "string") | F.col("bsm_strings").isNotNull())
    literal = F.when(F.col("const_kind") == "string", F.array("const_str")).otherwise(F.col("bsm_strings"))
    source = F.when(F.col("const_kind") == "string", "LDC").otherwise("INVOKEDYNAMIC_BSM")
    code = with_current_line(used).filter(F.col("pseudo_kind").isNull()).select(
        "archive_id", F.col("owner").alias("in_class"), F.col("method").alias("in_member"),
        F.col("desc").alias("in_desc"), F.col("current_line").cast("int").alias("line"),
        source.alias("source"), F.explode(literal).alias("value"),
    )
    constants = fields.filter(F.col("const_kind") == "string").select(
        "archive_id", F.col("owner").alias("in_class"), F.col("name").alias("in_member"),
        F.col("desc").alias("in_desc"), F.lit(0).alias("line"), F.lit("FIELD_CONSTANT").alias("source"),
        F.col("const_str").alias("value"),
    )
    return code.unionByName(constants)


def literal_equals(sites: DataFrame, value: str) -> DataFrame:
    return sites.filter(F.col("value") == value)


def literal_contains(sites: DataFrame, fragment: str) -> DataFrame:
    """Case-sensitive; an empty fragment finds nothing."""
    return sites.filter(F.col("value").contains(fragment)) if fragment else sites.limit(0)


def literal_matches(sites: DataFrame, java_regex: str) -> DataFrame:
    return sites.filter(F.col("value").rlike(java_regex))


def string_distribution(sites: DataFrame) -> DataFrame:
    """Number of sites per distinct literal."""
    return sites.groupBy("value").agg(F.count("*").alias("sites"))


def string_totals(sites: DataFrame) -> DataFrame:
    """Distinct literals and all sites, from per-value counts."""
    return string_distribution(sites).agg(
        F.count("*").alias("unique_strings"), F.coalesce(F.sum("sites"), F.lit(0)).alias("total_sites")
    )


# --- presentation ------------------------------------------------------------------------------



def in_order(results: DataFrame, order: str) -> DataFrame:
    """Result order: ``path`` (then line), ``line`` (then path) or ``kind``."""
    path = F.lower("path").asc_nulls_last()
    keys = {
        "path": [path, F.col("line")],
        "line": [F.col("line"), path],
        "kind": [F.col("kind"), path, F.col("line")],
    }[order]
    return results.orderBy(*keys)


def with_snippet(results: DataFrame) -> DataFrame:
    return results.withColumn("snippet", S.match_snippet(F.col("text"), F.col("start"), F.col("end")))


def stream_results(results: DataFrame, job_group: str) -> Iterator[Row]:
    """Hand rows over one partition at a time; cancel with ``sparkContext.cancelJobGroup(job_group)``."""
    sc = results.sparkSession.sparkContext
    sc.setJobGroup(job_group, "search results", interruptOnCancel=True)
    yield from results.toLocalIterator(prefetchPartitions=True)
