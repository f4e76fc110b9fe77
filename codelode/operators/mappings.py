"""Mapping algebra: diff, compose, invert, apply, generate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.session import TASK_ROWS

ITEM = ["kind", "owner", "name", "desc"]


def _kind(mappings: DataFrame, kind: str) -> DataFrame:
    return mappings.filter(F.col("kind") == kind)


def _class_targets(mappings: DataFrame, target: str = "target") -> DataFrame:
    return _kind(mappings, "class").select(F.col("owner").alias("class_key"), F.col("target").alias(target))


def mapping_counts(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("kind").agg(F.count("*").alias("n"))


def lookup(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mapped name of each ``(kind, owner, name, desc)``; the item's own name when unmapped."""
    own = F.when(F.col("kind") == "class", F.col("owner")).otherwise(F.col("name"))
    found = mappings.select(*ITEM, "target")
    return items.join(found, ITEM, "left").withColumn("target", F.coalesce("target", own))


def mapping_diff(base: DataFrame, updated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Items added, removed or renamed between two mappings; tables of many are told apart ``by`` columns such as ``mapping_id``."""
    item = [*by, *ITEM]
    old = base.select(*item, F.col("target").alias("old_target"))
    new = updated.select(*item, F.col("target").alias("new_target"))
    o, n = F.col("old_target"), F.col("new_target")
    change = F.when(o.isNull(), "ADDED").when(n.isNull(), "REMOVED").when(o != n, "RENAMED")
    return old.join(new, item, "full").withColumn("change", change).filter(F.col("change").isNotNull())


def mapping_diff_counts(diff: DataFrame) -> DataFrame:
    """Nine counters and their total in one row."""
    cells = [(k, c) for k in ("class", "field", "method") for c in ("ADDED", "REMOVED", "RENAMED")]
    hit = lambda k, c: (F.col("kind") == k) & (F.col("change") == c)
    return diff.agg(
        *[F.count_if(hit(k, c)).alias(f"{k}_{c.lower()}") for k, c in cells], F.count("*").alias("total_changes")
    )


def compose(first: DataFrame, second: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A→B followed by B→C; in tables of many, each with its own second ``by`` columns such as ``mapping_id``.

    Unmatched entries of the first survive.  Classes known only to the second are kept unless the
    first has them as key or target; members known only to the second are dropped.
    """
    of = list(by)
    targets = lambda table, key, name: _kind(table, "class").select(*of, F.col("owner").alias(key), F.col("target").alias(name))
    classes = (
        _kind(first, "class")
        .join(targets(second, "target", "chained"), [*of, "target"], "left")
        .select(*of, *ITEM, F.coalesce("chained", "target").alias("target"))
    )
    mentioned = _kind(first, "class").select(*of, F.explode(F.array("owner", "target")).alias("owner")).distinct()
    extra = _kind(second, "class").join(mentioned, [*of, "owner"], "left_anti").select(*of, *ITEM, "target")
    members = (
        first.filter(F.col("kind") != "class")
        .join(targets(first, "owner", "named_owner"), [*of, "owner"], "left")
        .select(*of, *ITEM, "target", F.coalesce("named_owner", "owner").alias("via_owner"), F.col("target").alias("via_name"))
    )
    second_members = second.filter(F.col("kind") != "class").select(
        *of, "kind", F.col("owner").alias("via_owner"), F.col("name").alias("via_name"), "desc", F.col("target").alias("chained")
    )
    chained = members.join(second_members, [*of, "kind", "via_owner", "via_name", "desc"], "left").select(
        *of, *ITEM, F.coalesce("chained", "target").alias("target")
    )
    return classes.unionByName(extra).unionByName(chained)


def invert(mappings: DataFrame) -> DataFrame:
    """B→A.  Class targets that are not unique have no inverse.

    A member is keyed by ``reverse(classMap(owner))``, which is the obfuscated owner again wherever the
    class is uniquely mapped; two members meeting on one key keep the smallest name.
    """
    reverse = (
        _kind(mappings, "class")
        .groupBy("target")
        .agg(F.count("*").alias("n"), F.min("owner").alias("back"))
        .filter(F.col("n") == 1)
        .select(F.col("target").alias("reverse_key"), "back")
    )
    blank = F.lit("")
    classes = reverse.select(
        F.lit("class").alias("kind"), F.col("reverse_key").alias("owner"), blank.alias("name"), blank.alias("desc"),
        F.col("back").alias("target"),
    )
    members = (
        mappings.filter(F.col("kind") != "class")
        .join(_class_targets(mappings, "mapped"), F.col("owner") == F.col("class_key"), "left")
        .withColumn("reverse_key", F.coalesce("mapped", "owner"))
        .join(reverse, "reverse_key", "left")
        .select("kind", F.coalesce("back", "owner").alias("owner"), F.col("target").alias("new_name"), "desc", "name")
        .groupBy("kind", "owner", "new_name", "desc")
        .agg(F.min("name").alias("target"))
        .select("kind", "owner", F.col("new_name").alias("name"), "desc", "target")
    )
    return classes.unionByName(members)


# --- applying to facts -------------------------------------------------------------------------


class Renamer:
    """Rename the columns of fact tables by one mapping.

    Entries are counted first.  A mapping of more than ``TASK_ROWS`` is dealt to tasks and hashed there, while the facts pass by
    unsorted: Spark takes a mapping for as small as the file it is made from, and would send all of it to every task, once per join.
    """

    def __init__(self, mappings: DataFrame):
        self.source = mappings
        self.large = mappings.count() > TASK_ROWS
        self.classes = _class_targets(mappings, "new_class")
        members = mappings.select("kind", "owner", "name", "desc", F.col("target").alias("new_name"))
        self.fields = members.filter(F.col("kind") == "field").drop("kind")
        self.methods = members.filter(F.col("kind") == "method").drop("kind")

    def _join(self, rows: DataFrame, table: DataFrame, pairs: dict[str, str]) -> DataFrame:
        """Left join on ``pairs`` (table column to row column), dropping the table's key columns."""
        keyed = table
        cond = F.lit(True)
        for key, column in pairs.items():
            keyed = keyed.withColumnRenamed(key, f"_k_{key}")
            cond = cond & (F.col(column) == F.col(f"_k_{key}"))
        if self.large:
            keyed = keyed.hint("shuffle_hash")
        return rows.join(keyed, cond, "left").drop(*[f"_k_{k}" for k in pairs])

    def class_column(self, rows: DataFrame, column: str) -> DataFrame:
        out = self._join(rows, self.classes, {"class_key": column})
        return out.withColumn(column, F.coalesce("new_class", column)).drop("new_class")

    def class_array(self, rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
        """Rename the elements of an array column, keeping their order.

        Each distinct array is rewritten once and joined by its content, so rows that share ``keys`` keep their own.
        """
        arrays = rows.select(F.col(column).alias("_old")).filter(F.size("_old") > 0).distinct()
        renamed = self.class_column(arrays.select("_old", F.posexplode("_old").alias("_pos", "_item")), "_item").groupBy("_old").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_item"))), lambda s: s["_item"]).alias("_new")
        )
        joined = rows.join(renamed, rows[column] == F.col("_old"), "left")
        return joined.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")

    def descriptor_column(self, rows: DataFrame, column: str) -> DataFrame:
        """Rename every object type inside a descriptor; each distinct descriptor is rewritten once."""
        distinct = rows.select(F.col(column).alias("_desc")).filter(F.col("_desc").contains("L")).distinct()
        tokens = distinct.select("_desc", F.posexplode(S.descriptor_tokens(F.col("_desc"))).alias("_pos", "_tok"))
        tokens = tokens.withColumn("_cls", F.regexp_extract("_tok", r"^L([^;]*);", 1))
        mapped = self._join(tokens, self.classes, {"class_key": "_cls"})
        token = F.when(
            F.col("new_class").isNotNull(), F.concat(F.lit("L"), "new_class", F.lit(";"))
        ).otherwise(F.col("_tok"))
        rebuilt = mapped.groupBy("_desc").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_pos", token.alias("t")))), lambda s: s["t"]), ""
            ).alias("_new_desc")
        )
        joined = rows.join(rebuilt, rows[column] == F.col("_desc"), "left")
        return joined.withColumn(column, F.coalesce("_new_desc", column)).drop("_desc", "_new_desc")

    def member_column(self, rows: DataFrame, owner: str, name: str, desc: str, is_field: Column | None) -> DataFrame:
        """Rename a member by its exact owner.  Fields also try an entry without a descriptor.

        ``is_field`` says which rows are fields (the others are methods); None means all are methods.
        """
        out = self._join(rows, self.methods, {"owner": owner, "name": name, "desc": desc})
        new = F.col("new_name")
        if is_field is None:
            return out.withColumn(name, F.coalesce(new, F.col(name))).drop("new_name")
        out = out.withColumnRenamed("new_name", "_m")
        exact = self.fields.withColumnRenamed("new_name", "_f")
        loose = self.fields.filter(F.col("desc") == "").drop("desc").withColumnRenamed("new_name", "_g")
        out = self._join(out, exact, {"owner": owner, "name": name, "desc": desc})
        out = self._join(out, loose, {"owner": owner, "name": name})
        renamed = F.when(is_field, F.coalesce("_f", "_g")).otherwise(F.col("_m"))
        return out.withColumn(name, F.coalesce(renamed, F.col(name))).drop("_m", "_f", "_g")

    # Names and descriptors are renamed before owners: mapping keys are in the old namespace.

    def apply_classes(self, classes: DataFrame) -> DataFrame:
        out = self.class_column(classes, "super_name")
        out = self.class_array(out, "interfaces", ["archive_id", "internal_name"])
        return self.class_column(out, "internal_name")

    def apply_members(self, members: DataFrame, kind: str) -> DataFrame:
        out = self.member_column(members, "owner", "name", "desc", F.lit(True) if kind == "field" else None)
        return self.class_column(self.descriptor_column(out, "desc"), "owner")

    def apply_call_sites(self, sites: DataFrame) -> DataFrame:
        is_field = F.col("kind").isin("GETFIELD", "PUTFIELD", "GETSTATIC", "PUTSTATIC")
        out = self.member_column(sites, "target_owner", "target_name", "target_desc", is_field)
        out = self.member_column(out, "in_class", "in_method", "in_desc", None)
        for column in ("target_desc", "in_desc"):
            out = self.descriptor_column(out, column)
        return self.class_column(self.class_column(out, "target_owner"), "in_class")


# --- generating --------------------------------------------------------------------------------


def _usable_replacement(groups: int, replacement: str) -> bool:
    """Would the JVM accept the replacement text for a pattern with this many groups?"""
    rest = re.sub(r"\\.", "", replacement, flags=re.S)
    if rest.endswith("\\"):
        return False
    for ref in re.finditer(r"\$(.?)", rest, flags=re.S):
        if not ref.group(1).isdigit() or int(ref.group(1)) > groups:
            return False
    return True


def mass_rename(
    classes: DataFrame,
    methods: DataFrame,
    fields: DataFrame,
    java_regex: str,
    replacement: str,
    kinds: tuple[str, ...] = ("class", "method", "field"),
) -> DataFrame:
    """Mapping that renames every simple, method and field name the regex changes.

    ``<init>`` and ``<clinit>`` are never renamed; a replacement naming a missing group renames nothing.
    """
    jvm = classes.sparkSession._jvm
    groups = jvm.java.util.regex.Pattern.compile(java_regex).matcher("").groupCount()
    usable = F.lit(_usable_replacement(groups, replacement))
    renamed = lambda c: F.regexp_replace(c, F.lit(java_regex), F.lit(replacement if _usable_replacement(groups, replacement) else ""))
    blank = F.lit("")
    package = F.regexp_extract("internal_name", r"^(.*/)[^/]*\z", 1)
    simple = S.simple_name(F.col("internal_name"))
    by_kind = {
        "class": classes.select(
            "archive_id", F.lit("class").alias("kind"), F.col("internal_name").alias("owner"), blank.alias("name"),
            blank.alias("desc"), simple.alias("old"), package.alias("prefix"),
        ),
        "method": methods.filter(~F.col("name").startswith("<")).select(
            "archive_id", F.lit("method").alias("kind"), "owner", "name", "desc", F.col("name").alias("old"), blank.alias("prefix")
        ),
        "field": fields.select(
            "archive_id", F.lit("field").alias("kind"), "owner", "name", "desc", F.col("name").alias("old"), blank.alias("prefix")
        ),
    }
    rows = None
    for kind in kinds:
        rows = by_kind[kind] if rows is None else rows.unionByName(by_kind[kind])
    return (
        rows.filter(usable & F.col("old").rlike(java_regex))
        .withColumn("new", renamed(F.col("old")))
        .filter(F.col("new") != F.col("old"))
        .select("archive_id", *ITEM, F.concat("prefix", "new").alias("target"))
    )
