"""Differences between two versions of archives: classes, members, resources.

Both sides carry the same ``archive_id`` (the pair); contents are hashed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _list_text(value: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(value, ", "), F.lit("]"))


def _arrow(old: Column, new: Column) -> Column:
    return F.concat(old, F.lit(" -> "), new)


def _change(old: Column, new: Column, same: Column) -> Column:
    return F.when(old.isNull(), "ADDED").when(new.isNull(), "REMOVED").when(same, "UNCHANGED").otherwise("MODIFIED")


def class_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(archive_id, name, change, header_changes)``; versioned classes take no part.

    A name that occurs twice on a side counts with its last class.
    """

    def side(classes: DataFrame, tag: str) -> DataFrame:
        facts = F.struct(
            F.sha2("bytes", 256).alias("digest"), "access", "super_name", "interfaces", F.col("major").alias("version")
        )
        return (
            classes.filter(F.col("runtime_version") == 0)
            .select("archive_id", "name", "ordinal", facts.alias("facts"))
            .groupBy("archive_id", "name")
            .agg(F.max_by("facts", "ordinal").alias(tag))
        )

    both = side(left, "a").join(side(right, "b"), ["archive_id", "name"], "full")
    a, b = F.col("a"), F.col("b")
    differs = lambda f: ~a[f].eqNullSafe(b[f])
    headers = F.array(
        F.when(differs("access"), F.concat(F.lit("access: "), _arrow(_text(a["access"]), _text(b["access"])))),
        F.when(differs("super_name"), F.concat(F.lit("super: "), _arrow(_text(a["super_name"]), _text(b["super_name"])))),
        F.when(
            differs("interfaces"),
            F.concat(F.lit("interfaces: "), _arrow(_list_text(a["interfaces"]), _list_text(b["interfaces"]))),
        ),
        F.when(differs("version"), F.concat(F.lit("version: "), _arrow(_text(a["version"]), _text(b["version"])))),
    )
    change = _change(a, b, a["digest"] == b["digest"])
    none = F.array().cast("array<string>")
    return both.select(
        "archive_id", "name", change.alias("change"),
        F.when(change == "MODIFIED", F.filter(headers, lambda h: h.isNotNull())).otherwise(none).alias("header_changes"),
    )


def _member_diff(a: DataFrame, b: DataFrame, kind: str, same: Column, otherwise: Column) -> DataFrame:
    """Join two sides ``(keys..., a|b struct)`` and describe the change; an access change is told first."""
    keys = ["archive_id", "owner", "name", "desc"]
    old, new = F.col("a"), F.col("b")
    access_differs = old["access"] != new["access"]
    change = _change(old, new, ~access_differs & same)
    detail = F.when(
        change == "MODIFIED",
        F.when(access_differs, F.concat(F.lit("access "), _arrow(_text(old["access"]), _text(new["access"])))).otherwise(otherwise),
    ).otherwise("")
    return a.join(b, keys, "full").select(
        "archive_id", "owner", F.lit(kind).alias("kind"), change.alias("change"), "name", "desc",
        F.coalesce(old["access"], F.lit(0)).alias("old_access"), F.coalesce(new["access"], F.lit(0)).alias("new_access"),
        detail.alias("detail"),
    )


def _only(members: DataFrame, modified: DataFrame) -> DataFrame:
    return members.join(modified.select("archive_id", "owner"), ["archive_id", "owner"], "left_semi")


def method_diff(
    left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame], modified: DataFrame
) -> DataFrame:
    """Methods of the ``modified(archive_id, owner)`` classes; each side is ``(methods, instructions)``.

    Bodies compare by descriptor, access and opcode sequence alone: an edit of operands changes nothing.
    """
    keys = ["archive_id", "owner", "name", "desc"]

    def side(methods: DataFrame, instructions: DataFrame, tag: str) -> DataFrame:
        # One method's opcodes (65 535 bytes of code at most) meet in one row.
        body = (
            _only(instructions, modified)
            .groupBy("archive_id", "owner", F.col("method").alias("name"), "desc")
            .agg(F.sort_array(F.collect_list(F.struct("idx", "opcode"))).alias("ops"))
            .select(*keys, F.sha2(F.array_join(F.transform("ops", lambda s: s["opcode"].cast("string")), ";"), 256).alias("body"))
        )
        return (
            _only(methods, modified)
            .join(body, keys, "left")
            .select(*keys, F.struct("access", F.coalesce("body", F.lit("")).alias("body")).alias(tag))
        )

    same = F.col("a")["body"] == F.col("b")["body"]
    return _member_diff(side(*left, "a"), side(*right, "b"), "METHOD", same, F.lit("bytecode changed"))


def field_diff(left: DataFrame, right: DataFrame, modified: DataFrame) -> DataFrame:
    """Fields of the modified classes by access and constant value (``const_value`` as text)."""
    side = lambda fields, tag: _only(fields, modified).select(
        "archive_id", "owner", "name", "desc", F.struct("access", "const_kind", "const_value").alias(tag)
    )
    a, b = F.col("a"), F.col("b")
    same = a["const_value"].eqNullSafe(b["const_value"]) & a["const_kind"].eqNullSafe(b["const_kind"])
    value = F.concat(F.lit("value "), _arrow(_text(a["const_value"]), _text(b["const_value"])))
    return _member_diff(side(left, "a"), side(right, "b"), "FIELD", same, value)


def resource_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """By path: equal contents, or equal sizes where a content is not at hand."""
    side = lambda r, tag: r.select(
        "archive_id", "path", F.struct("size", F.sha2("content", 256).alias("digest")).alias(tag)
    )
    a, b = F.col("a"), F.col("b")
    same = F.coalesce(a["digest"] == b["digest"], a["size"] == b["size"])
    size = lambda s: F.coalesce(s["size"], F.lit(0)).cast("long")
    return side(left, "a").join(side(right, "b"), ["archive_id", "path"], "full").select(
        "archive_id", "path", _change(a, b, same).alias("change"), size(a).alias("old_size"), size(b).alias("new_size")
    )


def diff_stats(classes: DataFrame, resources: DataFrame) -> DataFrame:
    """Eight counters per archive."""
    changes = ["ADDED", "REMOVED", "MODIFIED", "UNCHANGED"]
    counted = lambda df, what: df.groupBy("archive_id").agg(
        *[F.count_if(F.col("change") == c).alias(f"{what}_{c.lower()}") for c in changes]
    )
    names = [f"{w}_{c.lower()}" for w in ("classes", "resources") for c in changes]
    both = counted(classes, "classes").join(counted(resources, "resources"), "archive_id", "full")
    return both.select("archive_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def diff_tree(diff: DataFrame, label: str) -> DataFrame:
    """Changed rows grouped by change with their number; unchanged rows are hidden."""
    shown = diff.filter(F.col("change") != "UNCHANGED")
    totals = shown.groupBy("archive_id", "change").agg(F.count("*").alias("in_group"))
    return shown.select("archive_id", "change", F.col(label).alias("label")).join(totals, ["archive_id", "change"])
