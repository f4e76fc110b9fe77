"""Rewrite rules over fact tables.

Every pass takes fact tables and gives the rewritten table and its counters ``(pass, counter, n)``; a
pass only shuffles the columns it decides on, and only for methods it can touch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.functions.access import bit
from codelode.operators.identity import class_key, definitions, method_key
from codelode.operators.ordered import number_rows
from codelode.session import cut_lineage, dealt, small_batches

KOTLIN = "Lkotlin/Metadata;"

# --- fixed values: opcodes after which control never falls through -----------------------------
TERMINATORS = [172, 173, 174, 175, 176, 177, 191, 167, 170, 171]
CONDITIONAL = [*range(153, 167), 198, 199]


def _flow(instructions: DataFrame) -> WindowSpec:
    """One method in instruction order: at most 65 535 bytes of code, so always a small window."""
    return Window.partitionBy(*method_key(instructions)).orderBy("idx")


def _before(instructions: DataFrame) -> WindowSpec:
    return _flow(instructions).rowsBetween(Window.unboundedPreceding, -1)


def counter(rows: DataFrame, pass_name: str, name: str | Column, amount: Column | None = None) -> DataFrame:
    """Counter rows of a pass; nothing is counted where nothing happened."""
    label = F.lit(name) if isinstance(name, str) else name
    n = F.count("*") if amount is None else F.sum(amount)
    return (
        rows.groupBy(label.alias("counter"))
        .agg(n.cast("long").alias("n"))
        .filter(F.col("n") > 0)
        .select(F.lit(pass_name).alias("pass"), "counter", "n")
    )


def run_passes(facts: dict[str, DataFrame], passes: list) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """Apply passes in order; each maps ``facts`` to ``(changed tables, counters)``."""
    totals = None
    for step in passes:
        changed, counts = step(facts)
        facts = {**facts, **changed}
        totals = counts if totals is None else totals.unionByName(counts)
    return facts, totals


# --- names -------------------------------------------------------------------------------------


def illegal_name_mapping(classes: DataFrame, methods: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapping that gives illegal or reserved names the stand-ins C_n, m_n, f_n, numbered per archive."""
    blank = F.lit("")
    bad = lambda c: ~S.is_legal_identifier(c) | S.is_java_word(c)
    package = F.regexp_extract("internal_name", r"^(.*/)[^/]*\z", 1)
    place = lambda facts, own: (F.col("class_id") if "class_id" in facts.columns else F.col(own)).alias("class_id")
    named = (
        classes.filter(bad(S.simple_name(F.col("internal_name"))))
        .select("archive_id", F.lit("class").alias("kind"), F.col("internal_name").alias("owner"), place(classes, "internal_name"), F.lit(0).alias("ordinal"),
                blank.alias("name"), blank.alias("desc"), F.concat(package, F.lit("C_")).alias("stem"))
        .unionByName(
            methods.filter(~F.col("name").startswith("<") & bad(F.col("name"))).select(
                "archive_id", F.lit("method").alias("kind"), "owner", place(methods, "owner"), "ordinal", "name", "desc", F.lit("m_").alias("stem"))
        )
        .unionByName(
            fields.filter(bad(F.col("name"))).select(
                "archive_id", F.lit("field").alias("kind"), "owner", place(fields, "owner"), "ordinal", "name", "desc", F.lit("f_").alias("stem"))
        )
    )
    if all("class_id" in facts.columns for facts in (classes, methods, fields)):
        # A name that an archive holds several times gets one stand-in, so renamed references stay whole.
        item = ["archive_id", "kind", "owner", "name", "desc", "stem"]
        named = named.groupBy(*item).agg(F.min(F.struct("class_id", "ordinal")).alias("at")).select(*item, "at.*")
    numbered = number_rows(named, ["archive_id", "kind"], ["owner", "class_id", "ordinal", "name", "desc"], "n")
    mapping = numbered.select(
        "archive_id", "kind", "owner", "name", "desc", F.concat("stem", F.col("n").cast("string")).alias("target")
    )
    plural = F.when(F.col("kind") == "class", "classes").otherwise(F.concat("kind", F.lit("s")))
    return mapping, counter(mapping, "illegal-name-mapping", F.concat(plural, F.lit("-renamed")))


def rename_in_class(
    fields: DataFrame, instructions: DataFrame, renames: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Apply field renames ``(archive_id, owner, old_name, new_name)`` inside the declaring class only."""
    key = class_key(fields, instructions, renames)
    new_fields = fields.join(
        renames.withColumnRenamed("old_name", "name"), [*key, "name"], "left"
    ).withColumn("name", F.coalesce("new_name", "name")).select(*fields.columns)
    own_ref = F.col("opcode").between(178, 181) & (F.col("ref_owner") == F.col("owner"))
    tagged = instructions.withColumn("old_name", F.when(own_ref, F.col("ref_name")))
    new_code = tagged.join(renames, [*key, "old_name"], "left").withColumn(
        "ref_name", F.coalesce("new_name", "ref_name")
    ).select(*instructions.columns)
    return new_fields, new_code


def enum_constant_names(classes: DataFrame, fields: DataFrame, instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames ``(archive_id, owner, old_name, new_name)`` of enum constants from their name literals.

    In the class initialiser: NEW self, DUP, a string, then — before any other NEW — the constructor
    call and the store to a static field.
    """
    key = class_key(instructions, fields, classes.withColumnRenamed("internal_name", "owner"))
    enums = classes.filter(bit(F.col("access"), "enum", "class")).withColumnRenamed("internal_name", "owner").select(*key)
    code = (
        instructions.filter((F.col("method") == "<clinit>") & (F.col("desc") == "()V") & (F.col("opcode") >= 0))
        .select(*method_key(instructions), "idx", "opcode", "ref_owner", "ref_name", "const_kind", "const_str")
        .join(enums, key, "left_semi")
    )
    own = F.col("ref_owner") == F.col("owner")
    op = F.col("opcode")
    ahead = _flow(instructions).rowsBetween(3, Window.unboundedFollowing)
    after = lambda c, n=1: F.lead(c, n).over(_flow(instructions))
    built = own & (op == 183) & (F.col("ref_name") == "<init>")
    stored = F.when((after("opcode") == 179) & (after("ref_owner") == F.col("owner")), after("ref_name"))
    marked = code.withColumn("event", F.when(built | (op == 187), F.struct(built.alias("built"), stored.alias("field"))))
    found = (
        marked.withColumn("next", F.first("event", ignorenulls=True).over(ahead))
        .withColumn("dup", after("opcode") == 89)
        .withColumn("literal", F.when((after("opcode", 2).isin(18, 19)) & (after("const_kind", 2) == "string"), after("const_str", 2)))
        .filter((op == 187) & own & F.col("dup") & F.col("literal").isNotNull() & F.col("next.built") & F.col("next.field").isNotNull())
        .select(*key, "idx", F.col("next.field").alias("old_name"), F.col("literal").alias("new_name"))
        .filter(F.col("new_name").rlike(r"^\p{javaJavaIdentifierStart}\p{javaJavaIdentifierPart}*\z") & (F.col("new_name") != F.col("old_name")))
    )
    known = fields.select(*key, F.col("name").alias("old_name")).distinct()
    first_use = found.join(known, [*key, "old_name"], "left_semi").groupBy(*key, "new_name").agg(
        F.min(F.struct("idx", "old_name")).alias("s")
    )
    renames = first_use.groupBy(*key, F.col("s.old_name").alias("old_name")).agg(F.max_by("new_name", "s.idx").alias("new_name"))
    return renames, counter(renames, "enum-name-restoration", "fields-renamed")


def kotlin_classes(annotations: DataFrame) -> DataFrame:
    """Classes that carry the Kotlin marker in a visible annotation."""
    return annotations.filter(
        (F.col("target_kind") == "class") & (F.col("desc") == KOTLIN) & F.col("visible")
    ).select("archive_id", "owner").distinct()


def kotlin_marker_count(annotations: DataFrame) -> DataFrame:
    return counter(kotlin_classes(annotations), "kotlin-name-restoration", "kotlin-classes-detected")


def kotlin_singletons(annotations: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames of companion and singleton fields to Companion and INSTANCE in Kotlin classes.

    The first fitting static final field is renamed unless the class has a field of that name.  Companions come first; a field
    that fits both ends as INSTANCE, and both renames count.  The counters also tell how many classes were looked at.
    """
    access, name = F.col("access"), F.col("name")
    marked = kotlin_classes(annotations)
    rows = fields.join(marked, ["archive_id", "owner"], "left_semi")
    static_final = bit(access, "static", "field") & bit(access, "final", "field")
    type_name = F.regexp_extract("desc", r"^L(.*);\z", 1)
    first = lambda fits: F.min(F.when(static_final & fits, F.struct("ordinal", "name")))
    picks = rows.groupBy("archive_id", "owner").agg(
        F.bool_or(name == "Companion").alias("has_companion"), first(type_name.endswith("$Companion")).alias("companion"),
        F.bool_or(name == "INSTANCE").alias("has_instance"), first(type_name == F.col("owner")).alias("instance"),
    )
    to_companion = ~F.col("has_companion") & F.col("companion").isNotNull()
    # A field called INSTANCE that became the companion leaves its name free.
    freed = to_companion & (F.col("companion.name") == "INSTANCE")
    to_instance = (~F.col("has_instance") | freed) & F.col("instance").isNotNull()
    rename = lambda done, old, new: F.when(done, F.struct(old.alias("old_name"), F.lit(new).alias("new_name")))
    both = F.array_compact(F.array(
        rename(to_companion, F.col("companion.name"), "Companion"), rename(to_instance, F.col("instance.name"), "INSTANCE")
    ))
    events = picks.select("archive_id", "owner", F.explode(both).alias("e")).select("archive_id", "owner", "e.*")
    out = events.groupBy("archive_id", "owner", "old_name").agg(F.max("new_name").alias("new_name")).filter("old_name <> new_name")
    label = F.when(F.col("new_name") == "Companion", "companion-fields-restored").otherwise("instance-fields-restored")
    pass_name = "kotlin-data-class-restoration"
    return out, counter(marked, pass_name, "kotlin-classes-seen").unionByName(counter(events, pass_name, label))


def component_accessor_count(accessors: DataFrame) -> DataFrame:
    """The counter of the rows of ``component_accessors``."""
    return counter(accessors, "kotlin-data-class-restoration", "component-accessors-mapped")


def component_accessors(annotations: DataFrame, instructions: DataFrame) -> DataFrame:
    """``componentN`` methods of Kotlin classes that just return a field, per class and number."""
    number = F.regexp_extract("method", r"^component(\d+)\z", 1)
    code = (
        instructions.filter((number != "") & F.col("desc").startswith("()") & (F.col("opcode") >= 0))
        .join(kotlin_classes(annotations), ["archive_id", "owner"], "left_semi")
        .select(*method_key(instructions), "idx", "opcode", "ref_owner", "ref_name", "const_long", F.row_number().over(_flow(instructions)).alias("at"))
        .filter(F.col("at") <= 3)
    )
    op, at = F.col("opcode"), F.col("at")
    good = (
        F.when(at == 1, (op == 25) & (F.col("const_long") == 0))
        .when(at == 2, (op == 180) & (F.col("ref_owner") == F.col("owner")))
        .otherwise(op.between(172, 176))
    )
    checked = code.groupBy(*method_key(instructions)).agg(
        F.count_if(F.coalesce(good, F.lit(False))).alias("good"), F.max(F.when(at == 2, F.col("ref_name"))).alias("field")
    )
    return checked.filter(F.col("good") == 3).select(
        "archive_id", "owner", F.regexp_extract("method", r"(\d+)\z", 1).try_cast("int").alias("component"), "field"
    ).filter(F.col("component").isNotNull()).groupBy("archive_id", "owner", "component").agg(F.max("field").alias("field"))


def source_files(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fill missing or odd source file names with ``Outermost.java``."""
    base = F.substring_index(S.simple_name(F.col("internal_name")), "$", 1)
    valid = F.coalesce(F.lower("source_file").rlike(r"\.(java|kt|scala|groovy)\z"), F.lit(False))
    changed = ~valid & (base != "")
    out = classes.withColumn("source_file", F.when(changed, F.concat(base, F.lit(".java"))).otherwise(F.col("source_file")))
    return out, counter(classes.filter(changed), "source-name-restoration", "source-files-set")


# --- attributes --------------------------------------------------------------------------------


def clean_annotations(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = S.annotation_desc_valid(F.col("desc"))
    return annotations.filter(valid), counter(
        annotations.filter(~valid), "remove-illegal-annotations", "annotations-removed"
    )


def drop_frames(instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    frame = F.coalesce(F.col("pseudo_kind") == "FRAME", F.lit(False))
    return instructions.filter(~frame), counter(instructions.filter(frame), "stack-frame-removal", "frames-removed")


# --- fixed values: attributes that have no business on a field ---------------------------------
CODE_ATTRIBUTES = [
    "Code", "LineNumberTable", "LocalVariableTable", "LocalVariableTypeTable", "StackMapTable", "Exceptions",
]


def strip_field_attributes(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = F.filter("attrs", lambda a: ~a.isin(CODE_ATTRIBUTES))
    removed = F.size("attrs") - F.size(kept)
    return fields.withColumn("attrs", kept), counter(
        fields.filter(removed > 0), "strip-code-on-field", "attributes-stripped", removed
    )


# --- constants ---------------------------------------------------------------------------------


def push_form(kind: Column, number: Column, real: Column) -> Column:
    """``struct(opcode, mnemonic)`` of the shortest instruction pushing a constant."""
    small = number.cast("int")
    form = lambda op, name: F.struct(op.cast("int").alias("opcode"), name.alias("mnemonic"))
    fixed = lambda op, name: form(F.lit(op), F.lit(name))
    load = fixed(18, "LDC")
    as_int = (
        F.when(number == -1, fixed(2, "ICONST_M1"))
        .when(number.between(0, 5), form(small + 3, F.concat(F.lit("ICONST_"), number.cast("string"))))
        .when(number.between(-128, 127), fixed(16, "BIPUSH"))
        .when(number.between(-32768, 32767), fixed(17, "SIPUSH"))
        .otherwise(load)
    )
    as_long = F.when(number == 0, fixed(9, "LCONST_0")).when(number == 1, fixed(10, "LCONST_1")).otherwise(load)
    as_float = (
        F.when(real == 0, fixed(11, "FCONST_0")).when(real == 1, fixed(12, "FCONST_1")).when(real == 2, fixed(13, "FCONST_2"))
        .otherwise(load)
    )
    as_double = F.when(real == 0, fixed(14, "DCONST_0")).when(real == 1, fixed(15, "DCONST_1")).otherwise(load)
    return (
        F.when(kind == "int", as_int).when(kind == "long", as_long).when(kind == "float", as_float)
        .when(kind == "double", as_double).when(kind == "null", fixed(1, "ACONST_NULL")).otherwise(load)
    )


def _inline(instructions: DataFrame, constants: DataFrame, on: list[str], applies: Column, pass_name: str, label: str):
    """Replace the instructions that name a known constant by the push of its value."""
    values = constants.select(
        *on, F.struct("const_kind", "const_str", "const_long", "const_double").alias("_value")
    )
    # Only the instructions that can match are shuffled by what they name, unless Spark measures the values to be small.
    can = F.coalesce(applies, F.lit(False))
    hits = instructions.filter(can).join(values, on, "left").select(*instructions.columns, "_value")
    rest = instructions.filter(~can).withColumn("_value", F.lit(None).cast(values.schema["_value"].dataType))
    joined = hits.unionByName(rest)
    value = F.col("_value")
    done = value.isNotNull()
    push = push_form(value["const_kind"], value["const_long"], value["const_double"])
    new = {
        "opcode": push["opcode"], "mnemonic": push["mnemonic"], "const_kind": value["const_kind"],
        "const_str": value["const_str"], "const_long": value["const_long"], "const_double": value["const_double"],
        "ref_owner": F.lit(None), "ref_name": F.lit(None), "ref_desc": F.lit(None),
    }
    out = joined.select(
        *[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in instructions.columns]
    )
    return out, counter(joined.filter(done), pass_name, label)


def inline_static_values(
    instructions: DataFrame, fields: DataFrame, classes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Reads of static final constants, in any class of the archive, become pushes.

    Fields with a ``class_id`` count in the class that defines the name: by ``classes``, or the first by path without them.
    """
    access = F.col("access")
    if "class_id" in fields.columns:
        # Who refers to a name that an archive holds several times means its first class.
        first = fields.groupBy("archive_id", "owner").agg(F.min("class_id").alias("class_id")) if classes is None else definitions(classes, "class_id").withColumnRenamed("internal_name", "owner")
        fields = fields.join(first, ["archive_id", "owner", "class_id"], "left_semi")
    constants = fields.filter(
        bit(access, "static", "field") & bit(access, "final", "field") & F.col("const_kind").isNotNull()
    ).select(
        "archive_id", F.col("owner").alias("ref_owner"), F.col("name").alias("ref_name"), F.col("desc").alias("ref_desc"),
        "const_kind", "const_str", "const_long", "const_double",
    )
    return _inline(
        instructions, constants, ["archive_id", "ref_owner", "ref_name", "ref_desc"], F.col("opcode") == 178,
        "static-value-inlining", "constants-inlined",
    )


RETURN_KINDS = {172: ["int"], 173: ["long"], 174: ["float"], 175: ["double"], 176: ["string", "null"]}


def constant_methods(instructions: DataFrame, methods: DataFrame) -> DataFrame:
    """Static methods without parameters whose body is one constant push and the fitting return."""
    access = F.col("access")
    able = methods.filter(
        bit(access, "static", "method") & ~bit(access, "abstract", "method") & ~bit(access, "native", "method")
        & F.col("desc").startswith("()")
    ).withColumnRenamed("name", "method")
    own = method_key(instructions, able)
    real = instructions.filter((F.col("opcode") >= 0) & F.col("desc").startswith("()"))
    ends = real.groupBy(*method_key(instructions)).agg(
        F.count("*").alias("n"),
        F.min(F.struct("idx", "opcode", "const_kind", "const_str", "const_long", "const_double")).alias("a"),
        F.max(F.struct("idx", "opcode")).alias("b"),
    )
    op = F.col("a.opcode")
    kind = F.when(op == 1, "null").otherwise(F.col("a.const_kind"))
    pushes = op.between(1, 20)
    fits = S._any([(F.col("b.opcode") == ret) & F.col("kind").isin(kinds) for ret, kinds in RETURN_KINDS.items()])
    return (
        ends.filter((F.col("n") == 2) & pushes)
        .withColumn("kind", kind)
        .filter(fits)
        .join(able, own, "left_semi")
        .select(
            *[c for c in own if c not in ("method", "desc")], F.col("method").alias("ref_name"), F.col("desc").alias("ref_desc"),
            F.col("kind").alias("const_kind"), F.col("a.const_str").alias("const_str"),
            F.col("a.const_long").alias("const_long"), F.col("a.const_double").alias("const_double"),
        )
    )


def inline_call_results(instructions: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of constant methods of the same class become pushes."""
    applies = (F.col("opcode") == 184) & (F.col("ref_owner") == F.col("owner"))
    return _inline(
        instructions, constant_methods(instructions, methods), [*class_key(instructions, methods), "ref_name", "ref_desc"], applies,
        "call-result-inlining", "calls-inlined",
    )


# --- control flow ------------------------------------------------------------------------------


def simplify_opaque_predicates(instructions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IFEQ/IFNE behind a literal 0 or 1: always taken becomes GOTO, never taken goes away.

    The node just before the jump goes too.  Removing a pair can put a literal in front of the next
    jump, so rounds repeat on the methods that changed until none does.
    """
    op, key = F.col("opcode"), method_key(instructions)
    last_real = F.last(F.when(op >= 0, op), ignorenulls=True).over(_before(instructions))
    work = dealt(instructions.select(*key, "idx", "opcode"), *key)
    changes: list[DataFrame] = []
    while True:
        seen = work.withColumn("literal", F.when(last_real.isin(3, 4), last_real - 3))
        decided = F.when(op.isin(153, 154) & F.col("literal").isNotNull(), (op == 153) == (F.col("literal") == 0))
        step = (
            seen.withColumn("taken", decided)
            .withColumn("eaten", F.lead("taken").over(_flow(instructions)).isNotNull())
            .withColumn("change", F.when(F.col("taken"), "GOTO").when(~F.col("taken"), "DROP").when(F.col("eaten"), "EATEN"))
            .drop("literal", "eaten")
        )
        # Only methods that changed are written, and dealt anew.
        touched = F.bool_or(F.col("change").isNotNull()).over(Window.partitionBy(*key))
        step = cut_lineage(step.withColumn("touched", touched).filter("touched").drop("touched"))
        if step.isEmpty():
            break
        changes.append(step.filter(F.col("change").isNotNull()).select(*key, "idx", "change"))
        left = step.filter(F.col("change").isNull() | (F.col("change") == "GOTO"))
        work = dealt(left.select(*key, "idx", F.when(F.col("change") == "GOTO", 167).otherwise(op).alias("opcode")), *key, like=step)
    if not changes:
        none = instructions.limit(0).select(F.lit("").alias("pass"), F.lit("").alias("counter"), F.lit(0).cast("long").alias("n"))
        return instructions, none
    edits = changes[0]
    for more in changes[1:]:
        edits = edits.unionByName(more)
    joined = instructions.join(edits.hint("shuffle_hash"), [*key, "idx"], "left")
    is_goto = F.col("change") == "GOTO"
    out = joined.filter(F.col("change").isNull() | is_goto).select(
        *[
            F.when(is_goto, F.lit({"opcode": 167, "mnemonic": "GOTO"}[c])).otherwise(F.col(c)).alias(c)
            if c in ("opcode", "mnemonic") else F.col(c)
            for c in instructions.columns
        ]
    )
    name = F.when(F.col("change") == "GOTO", "branches-forced-taken").otherwise("branches-dropped")
    counted = edits.filter(F.col("change") != "EATEN")
    return out, counter(counted, "opaque-predicate-simplification", name)


def _referenced_labels(instructions: DataFrame, try_catch: DataFrame) -> DataFrame:
    """Labels that code or handlers refer to, and the first label of each method."""
    jumps = instructions.filter(F.size("jump_targets") > 0).select(*method_key(instructions), F.explode("jump_targets").alias("label"))
    handlers = try_catch.select(*method_key(instructions), F.explode(F.array("start_label", "end_label", "handler_label")).alias("label"))
    first = (
        instructions.filter(F.col("label").isNotNull()).groupBy(*method_key(instructions)).agg(F.min_by("label", "idx").alias("label"))
    )
    return jumps.unionByName(handlers).unionByName(first).distinct()


def strip_after_terminators(instructions: DataFrame, try_catch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop what stands between a return, throw, goto or switch and the next referenced label.

    Line markers stay.  Whether a row is dead is told by the last terminator or referenced label before it.
    """
    used = _referenced_labels(instructions, try_catch).withColumn("used", F.lit(True))
    # Only label rows are joined; whole rows then pass through the one window, so nothing is joined back.
    labels = instructions.filter(F.col("label").isNotNull()).join(used, [*method_key(instructions), "label"], "left").select(
        *instructions.columns, F.coalesce("used", F.lit(False)).alias("used")
    )
    others = instructions.filter(F.col("label").isNull()).withColumn("used", F.lit(False))
    event = F.when(F.col("opcode").isin(TERMINATORS), "dead").when(F.col("used"), "live")
    after_end = F.coalesce(F.last(event, ignorenulls=True).over(_before(instructions)) == "dead", F.lit(False))
    goes = F.col("dead") & ~F.col("used") & (F.coalesce("pseudo_kind", F.lit("")) != "LINE")
    judged = labels.unionByName(others).withColumn("dead", after_end)
    return judged.filter(~goes).select(*instructions.columns), counter(
        judged.filter(goes), "unreachable-after-terminator", "instructions-removed"
    )


def _unreached(rows: list[dict], handlers: list[dict]) -> list[int]:
    """Positions of one method that control never gets to; none where its flow is not known."""
    rows.sort(key=lambda r: r["idx"])
    labels = {r["label"]: i for i, r in enumerate(rows) if r["label"] is not None}
    spans = [(labels.get(h["start_label"]), labels.get(h["end_label"], len(rows)), labels.get(h["handler_label"])) for h in handlers]
    if any(start is None or to is None for start, _, to in spans):
        return []
    reached, open_ = bytearray(len(rows)), [0]
    while open_:
        first = at = open_.pop()
        while at < len(rows) and not reached[at]:
            reached[at] = 1
            for label in rows[at]["jump_targets"] or ():
                if label not in labels:
                    return []
                open_.append(labels[label])
            at += 1
            if rows[at - 1]["ends"]:
                break
        else:
            if at == len(rows):
                return []
        # A handler is entered once anything it covers is.
        covers = [max(start, first) < min(end, at) for start, end, _ in spans]
        if any(covers):
            open_ += [to for (_, _, to), c in zip(spans, covers) if c]
            spans = [s for s, c in zip(spans, covers) if not c]
    return [r["idx"] for i, r in enumerate(rows) if not reached[i] and not r["marker"]]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, handlers = batch.column("rows"), batch.column("handlers")
        removed = [_unreached(rows[i].as_py(), handlers[i].as_py()) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(batch.num_columns - 2)], pa.array(removed, pa.list_(pa.int64()))],
            names=[*batch.schema.names[:-2], "removed"],
        )


def remove_dead_code(instructions: DataFrame, try_catch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop instructions unreachable over flow and handler edges; labels and lines stay.

    Methods that can have dead code are gathered, one row each, which 65 535 bytes of code bound, and searched where they are: instructions
    and handlers meet in one shuffle, and no round goes over all methods.  Methods whose flow runs into a missing label or off the end, or
    whose handlers lack a start or a handler, stay as they are.
    """
    key = method_key(instructions, try_catch)
    op = F.col("opcode")
    ends, real = F.coalesce(op.isin(TERMINATORS), F.lit(False)), F.coalesce(op >= 0, F.lit(False))
    row = F.struct(
        F.col("idx").cast("long").alias("idx"), "label", F.when(real & (F.size("jump_targets") > 0), F.col("jump_targets")).alias("jump_targets"),
        ends.alias("ends"), F.coalesce(F.col("pseudo_kind").isin("LABEL", "LINE"), F.lit(False)).alias("marker"),
    )
    handler = F.struct("start_label", "end_label", "handler_label")
    small_batches(instructions.sparkSession)
    both = instructions.select(
        *key, row.alias("row"), F.when(ends, F.col("idx")).alias("stop"), F.when(real, F.col("idx")).alias("real"), F.lit(None).alias("handler")
    ).unionByName(
        try_catch.select(*key, F.lit(None).alias("row"), F.lit(None).alias("stop"), F.lit(None).alias("real"), handler.alias("handler"))
    )
    methods = dealt(both, *key, like=instructions).groupBy(*key).agg(
        F.min("stop").alias("stop"), F.max("real").alias("last"), F.collect_list("row").alias("rows"), F.collect_list("handler").alias("handlers")
    ).filter(F.col("stop") < F.col("last")).select(*key, "rows", "handlers")
    types = {c: instructions.schema[c].dataType.simpleString() for c in key}
    dead = methods.mapInArrow(_searched, ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", removed array<bigint>")
    dead = dead.filter(F.size("removed") > 0)
    kept = instructions.join(dead.hint("shuffle_hash"), key, "left").filter(F.col("removed").isNull() | ~F.array_contains("removed", F.col("idx").cast("long")))
    return kept.select(*instructions.columns), counter(dead, "dead-code-removal", "instructions-removed", F.size("removed"))
