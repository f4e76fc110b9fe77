"""Call sites and usage queries: who uses a method, a field or a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.operators.identity import class_key, definitions, method_key, with_class_id

# --- fixed values: opcodes that name another member or type ------------------------------------
SITE_KINDS = {
    182: "INVOKE_VIRTUAL",
    183: "INVOKE_SPECIAL",
    184: "INVOKE_STATIC",
    185: "INVOKE_INTERFACE",
    178: "GETSTATIC",
    179: "PUTSTATIC",
    180: "GETFIELD",
    181: "PUTFIELD",
    187: "NEW",
    189: "ANEWARRAY",
    192: "CHECKCAST",
    193: "INSTANCEOF",
}
INVOKE_KINDS = ["INVOKE_VIRTUAL", "INVOKE_SPECIAL", "INVOKE_STATIC", "INVOKE_INTERFACE", "INVOKE_DYNAMIC"]
READ_KINDS = ["GETFIELD", "GETSTATIC"]
WRITE_KINDS = ["PUTFIELD", "PUTSTATIC"]
TYPE_KINDS = ["NEW", "CHECKCAST", "INSTANCEOF", "ANEWARRAY", "MULTIANEWARRAY", "TYPE_IN_SIGNATURE", "CLASS_LITERAL"]
FAMILIES = {"invoke": INVOKE_KINDS, "read": READ_KINDS, "write": WRITE_KINDS, "type": TYPE_KINDS}

def kind_family(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for family, kinds in FAMILIES.items():
        out = out.when(kind.isin(kinds), family)
    return out


def with_current_line(instructions: DataFrame) -> DataFrame:
    """Carry the last line number seen in the method forward onto every row (0 before the first).

    A method's code is at most 65 535 bytes, so each window holds a bounded number of rows.
    """
    so_far = Window.partitionBy(*method_key(instructions)).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("pseudo_kind") == "LINE", F.col("line")), ignorenulls=True).over(so_far)
    return instructions.withColumn("current_line", F.coalesce(seen, F.lit(0)))


def build_call_sites(instructions: DataFrame, classes: DataFrame) -> DataFrame:
    """Every reference from code plus the superclass and interface references of class headers.

    Where both tables have a ``class_id``, the sites have it too: two classes of one name keep their lines apart.
    """
    own_id = [c for c in ("class_id",) if c in instructions.columns and c in classes.columns]
    kinds = F.create_map(*[F.lit(x) for kv in SITE_KINDS.items() for x in kv])
    # Only line markers and referring instructions take part in the shuffle.
    relevant = instructions.filter(
        F.col("opcode").isin(list(SITE_KINDS)) | (F.col("pseudo_kind") == "LINE")
    ).select(*method_key(instructions), "idx", "opcode", "pseudo_kind", "line", "ref_owner", "ref_name", "ref_desc")
    code = with_current_line(relevant).filter(F.col("opcode").isin(list(SITE_KINDS))).select(
        "archive_id",
        *own_id,
        F.col("owner").alias("in_class"),
        F.col("method").alias("in_method"),
        F.col("desc").alias("in_desc"),
        F.element_at(kinds, F.col("opcode")).alias("kind"),
        F.col("ref_owner").alias("target_owner"),
        F.coalesce("ref_name", F.lit("")).alias("target_name"),
        F.coalesce("ref_desc", F.lit("")).alias("target_desc"),
        F.col("current_line").cast("int").alias("line"),
        F.col("idx").cast("long").alias("site_idx"),
    )
    parents = F.filter(
        F.concat(F.array("super_name"), F.coalesce("interfaces", F.array())), lambda x: x.isNotNull()
    )
    headers = classes.select(
        "archive_id",
        *own_id,
        F.col("internal_name").alias("in_class"),
        F.lit("<class>").alias("in_method"),
        F.lit("").alias("in_desc"),
        F.lit("TYPE_IN_SIGNATURE").alias("kind"),
        F.posexplode(parents).alias("site_idx", "target_owner"),
    ).select(
        "archive_id", *own_id, "in_class", "in_method", "in_desc", "kind", "target_owner",
        F.lit("").alias("target_name"), F.lit("").alias("target_desc"),
        F.lit(0).alias("line"), F.col("site_idx").cast("long").alias("site_idx"),
    )
    return code.unionByName(headers)


def method_calls(call_sites: DataFrame) -> DataFrame:
    return call_sites.filter(F.col("kind").isin(INVOKE_KINDS))


def usages_of_member(call_sites: DataFrame, owner: str, name: str, desc: str) -> DataFrame:
    """Sites of one method or field: exact owner, name and descriptor, no hierarchy walk."""
    return call_sites.filter(
        (F.col("target_owner") == owner) & (F.col("target_name") == name) & (F.col("target_desc") == desc)
    )


def usages_of_class(call_sites: DataFrame, owner: str) -> DataFrame:
    """Type uses, calls and field accesses owned by a class (a bag, nothing merged)."""
    return call_sites.filter(F.col("target_owner") == owner)


def usages_of_members(call_sites: DataFrame, targets: DataFrame) -> DataFrame:
    """Batch form: ``targets(target_owner, target_name, target_desc)`` against all sites.

    Both sides shuffle on the member, unless Spark measures the targets to be small; AQE splits the
    partitions of much-used members.
    """
    keys = ["target_owner", "target_name", "target_desc"]
    wanted = targets.select(*keys).distinct()
    return call_sites.join(wanted, keys, "left_semi")


def usage_filter(sites: DataFrame, text: str = "", families: list[str] | None = None) -> DataFrame:
    """Filter bar: text inside the dotted caller class, and the switched-on kind families."""
    out = sites
    if text:
        out = out.filter(F.lower(S.dotted(F.col("in_class"))).contains(text.lower()))
    if families is not None:
        out = out.filter(F.col("kind").isin([k for f in families for k in FAMILIES[f]]))
    return out


def with_overriders(usages: DataFrame, overriders: DataFrame) -> DataFrame:
    """Append one row per overriding class to the usages of a method."""
    extra = overriders.select(
        "archive_id",
        F.col("internal_name").alias("in_class"),
        F.lit("(override)").alias("in_method"),
        F.col("desc").alias("in_desc"),
        F.lit("INVOKE_SPECIAL").alias("kind"),
        F.col("declaring").alias("target_owner"),
        F.col("name").alias("target_name"),
        F.col("desc").alias("target_desc"),
        F.lit(0).alias("line"),
        F.lit(0).cast("long").alias("site_idx"),
    )
    return usages.unionByName(extra)


def usage_rollup(usages: DataFrame) -> DataFrame:
    """Counts per archive, class and method, per class, per archive, and overall (nulls mark the rolled-up levels).

    Sites are first counted per method, so the roll-up expands counts instead of sites.
    """
    per_method = usages.groupBy("archive_id", "in_class", "in_method", "in_desc").agg(F.count("*").alias("n"))
    signature = F.concat("in_method", "in_desc").alias("in_member")
    return (
        per_method.select("archive_id", "in_class", signature, F.struct("archive_id", "in_class").alias("class"), "n")
        .rollup("archive_id", "in_class", "in_member")
        .agg(F.sum("n").alias("sites"), F.count_distinct("class").alias("classes"))
        .orderBy(
            F.col("archive_id").asc_nulls_first(), F.lower("in_class").asc_nulls_first(), F.lower("in_member").asc_nulls_first(),
            "in_class", "in_member",
        )
    )


def enrich_classes(nodes: DataFrame, classes: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """Add access, method and field counts to ``nodes(archive_id, internal_name)``; 0 when outside.

    A name that an archive holds several times takes all three from the class that defines it (``definitions``).
    """
    key = ["archive_id", "internal_name"]
    known = definitions(with_class_id(classes, "internal_name"), "access", "class_id")

    def counted(members: DataFrame, out: str) -> DataFrame:
        told = class_key(members, classes.withColumnRenamed("internal_name", "owner"))
        per_class = members.groupBy(*told).agg(F.count("*").cast("int").alias(out)).withColumnRenamed("owner", "internal_name")
        return per_class.join(known.select("archive_id", "class_id"), ["archive_id", "class_id"], "left_semi").drop("class_id") if "class_id" in told else per_class

    joined = (
        nodes.join(known.drop("class_id"), key, "left")
        .join(counted(methods, "method_count"), key, "left")
        .join(counted(fields, "field_count"), key, "left")
    )
    counts = ["access", "method_count", "field_count"]
    return joined.select(*key, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def external_references(call_sites: DataFrame, classes: DataFrame) -> DataFrame:
    """Referenced owners that the archive does not hold, with their number of sites."""
    counted = call_sites.groupBy("archive_id", "target_owner").agg(F.count("*").alias("sites"))
    known = classes.select("archive_id", F.col("internal_name").alias("target_owner"))
    return counted.join(known, ["archive_id", "target_owner"], "left_anti")


def match_native_symbols(symbols: DataFrame, classes: DataFrame) -> DataFrame:
    """Parse native symbols and flag those whose class the corpus holds (unmatched symbols stay)."""
    parsed = symbols.withColumn("p", S.jni_parse(F.col("symbol"))).filter(F.col("p").isNotNull())
    flat = parsed.select("archive_id", "symbol", "p.class_fqn", "p.method", "p.desc")
    known = classes.select("archive_id", F.col("name").alias("class_fqn"), F.lit(True).alias("known")).distinct()
    return flat.join(known, ["archive_id", "class_fqn"], "left").select(
        "archive_id", "symbol", "class_fqn", "method", "desc",
        F.coalesce("known", F.lit(False)).alias("matches_workspace_class"),
    )
