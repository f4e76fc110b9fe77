"""Structural patterns over classes, methods and fields, built from Python predicates.

A pattern compiles to Columns.  What needs another table — instruction contents, annotations, member
quantifiers — becomes one boolean flag per condition, computed for all conditions of a table in a
single aggregation over just the rows that meet one of them, and joined to the target once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.functions.access import bit

# --- fixed values: opcodes that patterns can name; any other is opcode_<number> ----------------
NAMED_OPCODES = {
    "nop": 0, "aconst_null": 1, "ireturn": 172, "lreturn": 173, "freturn": 174, "dreturn": 175, "areturn": 176,
    "return": 177, "athrow": 191, "monitorenter": 194, "monitorexit": 195, "arraylength": 190, "checkcast": 192,
    "instanceof": 193, "tableswitch": 170, "lookupswitch": 171, "new": 187, "newarray": 188, "anewarray": 189,
    "invokevirtual": 182, "invokespecial": 183, "invokestatic": 184, "invokeinterface": 185, "invokedynamic": 186,
    "ifeq": 153, "ifne": 154, "goto": 167, "ifnull": 198, "ifnonnull": 199,
}
FIELD_OPCODES = {"getstatic": 178, "putstatic": 179, "getfield": 180, "putfield": 181}


# --- text matchers -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Text:
    """Literal equality, regex *find*, or anything."""

    value: str | None = None
    is_regex: bool = False

    def on(self, c: Column) -> Column:
        if self.value is None:
            return F.lit(True)
        hit = c.rlike(self.value) if self.is_regex else c == self.value
        return F.coalesce(hit, F.lit(False))

    def on_name(self, internal: Column) -> Column:
        """Match a class name in its internal or dotted form."""
        return self.on(internal) | self.on(S.dotted(internal))


ANY = Text()


def literal(value: str) -> Text:
    return Text(value)


def regex(value: str) -> Text:
    return Text(value, True)


def _text(value: Text | str) -> Text:
    return value if isinstance(value, Text) else Text(value)


# --- instruction conditions --------------------------------------------------------------------


def ldc(value: Text | str) -> Column:
    """A constant load whose value reads as the text."""
    kind = F.col("const_kind")
    shown = (
        F.when(kind.isin("int", "long"), F.col("const_long").cast("string"))
        .when(kind == "float", F.col("const_double").cast("float").cast("string"))
        .when(kind == "double", F.col("const_double").cast("string"))
        .otherwise(F.col("const_str"))
    )
    return F.col("opcode").isin(18, 19, 20) & _text(value).on(shown)


def invoke(owner: Text | str, name: Text | str) -> Column:
    """A call by owner (internal or dotted) and name, any descriptor; dynamic calls do not count."""
    return F.col("opcode").between(182, 185) & _text(owner).on_name(F.col("ref_owner")) & _text(name).on(F.col("ref_name"))


def field_access(op: str, owner: Text | str, name: Text | str) -> Column:
    return (F.col("opcode") == FIELD_OPCODES[op]) & _text(owner).on_name(F.col("ref_owner")) & _text(name).on(F.col("ref_name"))


def new(owner: Text | str) -> Column:
    return (F.col("opcode") == 187) & _text(owner).on_name(F.col("ref_owner"))


def opcode(name: str) -> Column:
    low = name.lower()
    if low in NAMED_OPCODES:
        return F.col("opcode") == NAMED_OPCODES[low]
    number = low.removeprefix("opcode_")
    known = not low.startswith("opcode_") or not number.isdigit() or int(number) in NAMED_OPCODES.values()
    return F.lit(False) if known else F.col("opcode") == int(number)


# --- predicates --------------------------------------------------------------------------------


class Predicate:
    """Something a class, method or field can satisfy; where it does not apply it is false."""

    def compile(self, scope: _Scope) -> Column:
        raise NotImplementedError

    def __or__(self, other: Predicate) -> Predicate:
        return Either([self, other])

    def __invert__(self) -> Predicate:
        return Negated(self)


@dataclass
class _Scope:
    """One target being matched, with the flags its predicates ask for."""

    target: str
    conditions: list[Column] = field(default_factory=list)
    annotations: list[Text] = field(default_factory=list)
    quantified: list[tuple[str, str, list[Predicate]]] = field(default_factory=list)

    def flag(self, kind: str, bucket: list, item) -> Column:
        bucket.append(item)
        return F.col(f"_{kind}{len(bucket) - 1}")


@dataclass
class Name(Predicate):
    text: Text

    def compile(self, scope):
        return self.text.on_name(F.col("internal_name")) if scope.target == "class" else self.text.on(F.col("name"))


@dataclass
class Access(Predicate):
    flag: str

    def compile(self, scope):
        return bit(F.col("access"), self.flag, scope.target)


@dataclass
class Extends(Predicate):
    text: Text

    def compile(self, scope):
        if scope.target != "class":
            return F.lit(False)
        return F.col("super_name").isNotNull() & self.text.on_name(F.col("super_name"))


@dataclass
class Implements(Predicate):
    text: Text

    def compile(self, scope):
        return F.exists("interfaces", self.text.on_name) if scope.target == "class" else F.lit(False)


@dataclass
class Annotated(Predicate):
    text: Text

    def compile(self, scope):
        return scope.flag("ann", scope.annotations, self.text)


@dataclass
class Desc(Predicate):
    text: Text

    def compile(self, scope):
        return F.lit(False) if scope.target == "class" else self.text.on(F.col("desc"))


_COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


@dataclass
class Count(Predicate):
    """``methods``, ``fields`` (of a class) or ``instructions`` (of a method) compared with a number."""

    what: str
    op: str
    value: int

    def compile(self, scope):
        wanted = {"methods": "class", "fields": "class", "instructions": "method"}[self.what]
        if scope.target != wanted:
            return F.lit(False)
        number = {
            "methods": F.col("method_count"),
            "fields": F.col("field_count"),
            # Labels that code jumps to count; line markers do not.
            "instructions": F.col("real_count") + F.col("jump_label_count"),
        }[self.what]
        return _COMPARE[self.op](F.coalesce(number, F.lit(0)), F.lit(self.value))


@dataclass
class Contains(Predicate):
    condition: Column

    def compile(self, scope):
        return scope.flag("insn", scope.conditions, self.condition) if scope.target == "method" else F.lit(False)


@dataclass
class Nested(Predicate):
    """``any``, ``all`` or ``none`` of the class's methods or fields."""

    quantifier: str
    target: str
    predicates: list[Predicate]

    def compile(self, scope):
        if scope.target != "class":
            return F.lit(False)
        return scope.flag("nest", scope.quantified, (self.quantifier, self.target, self.predicates))


@dataclass
class Either(Predicate):
    alternatives: list[Predicate]

    def compile(self, scope):
        return reduce(lambda a, b: a | b, [p.compile(scope) for p in self.alternatives])


@dataclass
class Negated(Predicate):
    """Negation, which also turns "does not apply" into true."""

    inner: Predicate

    def compile(self, scope):
        return ~self.inner.compile(scope)


def name(text: Text | str) -> Predicate:
    return Name(_text(text))


def access(flag: str) -> Predicate:
    return Access(flag)


def extends(text: Text | str) -> Predicate:
    return Extends(_text(text))


def implements(text: Text | str) -> Predicate:
    return Implements(_text(text))


def annotated(text: Text | str) -> Predicate:
    return Annotated(_text(text))


def desc(text: Text | str) -> Predicate:
    return Desc(_text(text))


def count(what: str, op: str, value: int) -> Predicate:
    return Count(what, op, value)


def contains(condition: Column) -> Predicate:
    return Contains(condition)


def any_of(target: str, *predicates: Predicate) -> Predicate:
    return Nested("any", target, list(predicates))


def all_of(target: str, *predicates: Predicate) -> Predicate:
    return Nested("all", target, list(predicates))


def none_of(target: str, *predicates: Predicate) -> Predicate:
    return Nested("none", target, list(predicates))


# --- evaluation --------------------------------------------------------------------------------


@dataclass
class Corpus:
    """The fact tables patterns read; ``annotations`` only when a pattern asks for them."""

    classes: DataFrame
    methods: DataFrame
    fields: DataFrame
    instructions: DataFrame
    annotations: DataFrame | None = None

    def table(self, target: str) -> DataFrame:
        return {"class": self.classes, "method": self.methods, "field": self.fields}[target]


def _true_flags(names: list[str]) -> list[Column]:
    return [F.coalesce(n, F.lit(False)).alias(n) for n in names]


def _with_flags(corpus: Corpus, rows: DataFrame, scope: _Scope) -> DataFrame:
    member_key = ["archive_id", "owner", "name", "desc"]
    if scope.conditions:
        cond = [F.coalesce(c, F.lit(False)) for c in scope.conditions]
        names = [f"_insn{i}" for i in range(len(cond))]
        # A method is marked at once; rows meeting no condition never leave their task.
        hits = (
            corpus.instructions.filter(reduce(lambda a, b: a | b, cond))
            .groupBy("archive_id", "owner", F.col("method").alias("name"), "desc")
            .agg(*[F.bool_or(c).alias(n) for c, n in zip(cond, names)])
        )
        rows = rows.join(hits, member_key, "left").select(*rows.columns, *_true_flags(names))
    if scope.annotations:
        names = [f"_ann{i}" for i in range(len(scope.annotations))]
        found = corpus.annotations.filter(F.col("target_kind") == scope.target).withColumnRenamed("desc", "ann_desc")
        cond = [t.on(F.col("ann_desc")) for t in scope.annotations]
        key = ["archive_id", "internal_name"] if scope.target == "class" else member_key
        renamed = (
            [F.col("archive_id"), F.col("owner").alias("internal_name")]
            if scope.target == "class"
            else [F.col("archive_id"), F.col("owner"), F.col("member").alias("name"), F.col("member_desc").alias("desc")]
        )
        hits = found.filter(reduce(lambda a, b: a | b, cond)).groupBy(*renamed).agg(
            *[F.bool_or(c).alias(n) for c, n in zip(cond, names)]
        )
        rows = rows.join(hits, key, "left").select(*rows.columns, *_true_flags(names))
    for i, (quantifier, target, predicates) in enumerate(scope.quantified):
        members = _matching(corpus, target, predicates)
        totals = members.groupBy("archive_id", F.col("owner").alias("internal_name")).agg(
            F.count("*").alias("_total"), F.count_if("_match").alias("_hits")
        )
        total, hit = F.coalesce("_total", F.lit(0)), F.coalesce("_hits", F.lit(0))
        verdict = {"any": hit > 0, "all": (total > 0) & (hit == total), "none": hit == 0}[quantifier]
        # Classes without members must stay: none holds for them, all does not.
        rows = rows.join(totals, ["archive_id", "internal_name"], "left").select(*rows.columns, verdict.alias(f"_nest{i}"))
    return rows


def _matching(corpus: Corpus, target: str, predicates: list[Predicate]) -> DataFrame:
    """The target's rows with a boolean ``_match``."""
    scope = _Scope(target)
    match = reduce(lambda a, b: a & b, [p.compile(scope) for p in predicates], F.lit(True))
    return _with_flags(corpus, corpus.table(target), scope).withColumn("_match", F.coalesce(match, F.lit(False)))


def evaluate(corpus: Corpus, target: str, *predicates: Predicate) -> DataFrame:
    """One row per match: ``archive_id, kind, class_name, member, desc``."""
    return _result_rows(_matching(corpus, target, list(predicates)).filter("_match"), target)


def _result_rows(hits: DataFrame, target: str, *extra: str) -> DataFrame:
    is_class = target == "class"
    nothing = F.lit(None).cast("string")
    return hits.select(
        *extra,
        "archive_id",
        F.lit(target.upper()).alias("kind"),
        S.dotted(F.col("internal_name" if is_class else "owner")).alias("class_name"),
        (nothing if is_class else F.col("name")).alias("member"),
        (nothing if is_class else F.col("desc")).alias("desc"),
    )


def evaluate_all(corpus: Corpus, patterns: dict[str, tuple[str, list[Predicate]]]) -> DataFrame:
    """Many named patterns at once: :func:`evaluate` rows with a ``pattern`` column.

    Patterns on the same kind of target share one scan of each table they read.
    """
    out = None
    for target in ("class", "method", "field"):
        named = {n: preds for n, (t, preds) in patterns.items() if t == target}
        if not named:
            continue
        scope = _Scope(target)
        matches = {n: reduce(lambda a, b: a & b, [p.compile(scope) for p in preds], F.lit(True)) for n, preds in named.items()}
        hit = F.filter(F.array(*[F.when(m, F.lit(n)) for n, m in matches.items()]), lambda x: x.isNotNull())
        rows = _with_flags(corpus, corpus.table(target), scope).withColumn("pattern", F.explode(hit))
        found = _result_rows(rows, target, "pattern")
        out = found if out is None else out.unionByName(found)
    return out


def method_counts(instructions: DataFrame, try_catch: DataFrame) -> DataFrame:
    """Node counts per method: real instructions, labels, labels that code refers to, line markers."""
    key = ["archive_id", "owner", "method", "desc"]
    jumps = instructions.filter(F.size("jump_targets") > 0).select(*key, F.explode("jump_targets").alias("label"))
    handlers = try_catch.select(*key, F.explode(F.array("start_label", "end_label", "handler_label")).alias("label"))
    used = jumps.unionByName(handlers).distinct().withColumn("used", F.lit(1))
    labels = instructions.filter(F.col("label").isNotNull()).select(*key, "label").join(used, [*key, "label"], "left_semi")
    referenced = labels.groupBy(*key).agg(F.count("*").cast("int").alias("jump_label_count"))
    pseudo = F.col("pseudo_kind")
    counted = instructions.groupBy(*key).agg(
        F.count_if(F.col("opcode") >= 0).cast("int").alias("real_count"),
        F.count_if(pseudo == "LABEL").cast("int").alias("label_count"),
        F.count_if(pseudo == "LINE").cast("int").alias("line_count"),
    )
    return (
        counted.join(referenced, key, "left")
        .withColumn("jump_label_count", F.coalesce("jump_label_count", F.lit(0)))
        .withColumnRenamed("method", "name")
    )


# --- ready-made patterns -----------------------------------------------------------------------


# --- fixed values: words and sizes that the ready-made patterns look for ------------------------
SECRET_WORDS = ["password", "secret", "token", "apikey"]
BIG_SWITCH = 200


def _calls(*targets: tuple[str, str]) -> Predicate:
    return Either([contains(invoke(owner, method)) for owner, method in targets])


def library() -> dict[str, tuple[str, list[Predicate]]]:
    """Eleven patterns worth running on any corpus: ``name -> (target, predicates)``."""
    return {
        "println callers": ("method", [_calls(("java/io/PrintStream", "println"))]),
        "secret-named fields": ("class", [any_of("field", name(regex("(?i)" + "|".join(SECRET_WORDS))))]),
        "reflection abuse": (
            "method",
            [
                contains(invoke("java/lang/reflect/AccessibleObject", "setAccessible")),
                contains(invoke("java/lang/reflect/Method", "invoke")),
            ],
        ),
        "native loaders": (
            "method",
            [_calls(("java/lang/Runtime", "loadLibrary"), ("java/lang/System", "loadLibrary"), ("java/lang/System", "load"))],
        ),
        "big switch": ("method", [contains(opcode("tableswitch")), count("instructions", ">", BIG_SWITCH)]),
        "hardcoded urls": ("method", [contains(ldc(regex('https?://[^ \t\n"]')))]),
        "crypto": (
            "method",
            [
                _calls(
                    ("javax/crypto/Cipher", "getInstance"),
                    ("java/security/MessageDigest", "getInstance"),
                    ("javax/crypto/spec/SecretKeySpec", "<init>"),
                )
            ],
        ),
        "process start": (
            "method",
            [_calls(("java/lang/Runtime", "exec"), ("java/lang/ProcessBuilder", "<init>"), ("java/lang/ProcessBuilder", "start"))],
        ),
        "custom class loaders": (
            "class",
            [extends(regex("ClassLoader")), any_of("method", contains(invoke(ANY, "defineClass")))],
        ),
        "static final strings": ("field", [access("static"), access("final"), desc("Ljava/lang/String;")]),
        "exit callers": (
            "method",
            [_calls(("java/lang/System", "exit"), ("java/lang/Runtime", "exit"), ("java/lang/Runtime", "halt"))],
        ),
    }
