"""String-decryptor candidates and the calls that feed them literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.functions.access import bit
from codelode.operators.detect import DECRYPTOR_DESCS
from codelode.operators.identity import method_key
from codelode.operators.usage import with_current_line
from codelode.session import dealt

# --- fixed values: owners whose calls are neither rewarded nor penalised -----------------------
NEUTRAL_OWNERS = ["java/lang/StringBuilder", "java/lang/Integer", "java/lang/Character"]
ARITHMETIC = [130, 126, 128, 122, 124, 120, 96, 100]


def decrypt_candidates(methods: DataFrame, instructions: DataFrame) -> DataFrame:
    """Static string-to-string methods of 5 to 600 nodes with a positive score.

    ``methods`` carries ``real_count`` and ``jump_label_count``.  Calls to files, network or reflection
    rule a method out.  Only instructions that score are shuffled, one small row per method after
    the map side has combined them.
    """
    own_id = [c for c in ("class_id",) if c in methods.columns and c in instructions.columns]
    key = ["archive_id", *own_id, "owner", "name", "desc"]
    op, owner, called = F.col("opcode"), F.col("ref_owner"), F.col("ref_name")
    is_call = op.between(182, 185)
    on_string = is_call & (owner == "java/lang/String")
    barred = is_call & (
        S._any([owner.startswith(p) for p in ("java/io/", "java/net/", "java/nio/")])
        | owner.isin("java/lang/Runtime", "java/lang/reflect/Method")
        | ((owner == "java/lang/Class") & (called == "forName"))
    )
    points = (
        F.when(op == 188, 1)
        .when(on_string, 1)
        .when(is_call & owner.isin(NEUTRAL_OWNERS), 0)
        .when(is_call & owner.startswith("java/"), -1)
        .when(is_call, -2)
        .otherwise(0)
    )
    scored = (
        instructions.filter(F.col("desc").isin(DECRYPTOR_DESCS) & (is_call | op.isin(188, *ARITHMETIC)))
        .withColumnRenamed("method", "name")
        .groupBy(*key)
        .agg(
            F.sum(points).alias("points"),
            F.bool_or(op.isin(ARITHMETIC)).alias("arithmetic"),
            F.bool_or(on_string & (called == "<init>")).alias("makes_string"),
            F.bool_or(barred).alias("barred"),
        )
    )
    score = F.col("points") + F.when(F.col("arithmetic"), 3).otherwise(0) + F.when(F.col("makes_string"), 2).otherwise(0)
    nodes = F.col("real_count") + F.col("jump_label_count")
    shaped = methods.filter(
        bit(F.col("access"), "static", "method") & F.col("desc").isin(DECRYPTOR_DESCS) & nodes.between(5, 600)
    )
    # Without a scoring instruction the score is 0, so the join may drop those methods.
    return (
        shaped.join(scored.filter(~F.col("barred")), key)
        .select(*key, nodes.cast("int").alias("nodes"), score.cast("int").alias("score"))
        .filter(F.col("score") > 0)
    )


def encrypted_call_sites(instructions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Static calls of candidates whose string argument is a literal just before the call.

    The walk back is short (7 nodes for the string, 5 or 11 where an integer is involved) and stops at
    any instruction that is not a constant push, so it is a fixed window over the ordered method.
    """
    own = method_key(instructions)
    op, idx = F.col("opcode"), F.col("idx")
    is_text = op.isin(18, 19) & (F.col("const_kind") == "string")
    is_any_ldc = op.isin(18, 19, 20)
    is_push = op.isin(16, 17) | op.between(2, 8)
    is_number = is_push | (op.isin(18, 19) & (F.col("const_kind") == "int"))
    node = F.struct(
        idx.alias("idx"),
        F.when(op < 0, "skip").when(is_text, "text").when(is_push, "push").when(is_number, "int").when(is_any_ldc, "ldc").otherwise("other").alias("kind"),
        F.col("const_str").alias("text"),
        F.when(op.between(2, 8), op - 3).when(is_number, F.col("const_long").try_cast("int")).alias("number"),
    )
    wanted = candidates.select(
        "archive_id", F.col("owner").alias("ref_owner"), F.col("name").alias("ref_name"), F.col("desc").alias("ref_desc")
    ).distinct()
    shaped = (op == 184) & F.col("ref_desc").isin(DECRYPTOR_DESCS)
    called = ["archive_id", "ref_owner", "ref_name", "ref_desc"]
    # Methods without a decryptor-shaped static call need no window at all.  Candidates and callers are unique, so they are hashed and rows need no sort.
    callers = instructions.filter(shaped).join(wanted.hint("shuffle_hash"), called, "left_semi").select(*own).distinct()
    # Only what a walk looks at is sorted: what a row refers to counts in calls, a text where it is loaded.
    slim = instructions.select(
        *own, "idx", "opcode", "const_kind", F.when(is_text, F.col("const_str")).alias("const_str"), "const_long", "pseudo_kind",
        F.when(F.col("pseudo_kind") == "LINE", F.col("line")).alias("line"), *[F.when(shaped, F.col(c)).alias(c) for c in called[1:]],
    )
    near = Window.partitionBy(*own).orderBy("idx").rowsBetween(-11, -1)
    rows = with_current_line(dealt(slim, *own).join(callers.hint("shuffle_hash"), own, "left_semi")).withColumn(
        "before", F.reverse(F.collect_list(node).over(near))
    )
    calls = rows.filter(shaped)
    before = F.col("before")

    def first(nodes: Column, passing: list[str]) -> Column:
        """The nearest node that is not one of the kinds walked over."""
        return F.get(F.filter(nodes, lambda x: ~x["kind"].isin(passing)), 0)

    text_of = lambda n: F.when(n["kind"] == "text", n["text"])
    number_of = lambda n: F.when(n["kind"].isin("push", "int"), n["number"])
    reach = lambda nodes, n: F.filter(nodes, lambda x: x["idx"] >= idx - n)
    plain = text_of(first(reach(before, 7), ["skip", "push"]))
    # Integer before the string: go past the nearest constant load, then take what is before it.
    load_at = first(before, ["skip", "push", "other"])["idx"]
    ahead = number_of(first(F.filter(before, lambda x: x["idx"] < load_at), ["skip"]))
    last_number = first(reach(before, 5), ["skip"])
    number_at = first(before, ["skip"])
    text_before = text_of(first(F.filter(before, lambda x: x["idx"] < number_at["idx"]), ["skip"]))
    desc = F.col("ref_desc")
    literal = (
        F.when(desc == DECRYPTOR_DESCS[2], F.when(number_at["kind"].isin("push", "int"), text_before)).otherwise(plain)
    )
    number = F.when(desc == DECRYPTOR_DESCS[1], ahead).when(desc == DECRYPTOR_DESCS[2], number_of(last_number))
    sites = (
        calls.select(
            *[c for c in own if c in ("archive_id", "class_id")], F.col("owner").alias("in_class"), F.col("method").alias("in_method"), F.col("desc").alias("in_desc"),
            F.col("ref_owner").alias("target_owner"), F.col("ref_name").alias("target_name"), desc.alias("target_desc"),
            F.col("current_line").cast("int").alias("line"), F.col("idx"), literal.alias("encrypted"), number.alias("int_arg"),
        )
        .filter(F.col("encrypted").isNotNull())
    )
    target = wanted.select("archive_id", F.col("ref_owner").alias("target_owner"), F.col("ref_name").alias("target_name"), F.col("ref_desc").alias("target_desc"))
    return sites.join(target.hint("shuffle_hash"), target.columns, "left_semi").select(*sites.columns)
