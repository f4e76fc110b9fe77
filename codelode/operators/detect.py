"""Obfuscator detection: features of every archive in one pass, then scoring expressions.

A detector is a name, a family, and signals ``(condition, score, evidence text, weight)`` over the
feature columns.  All archives are scored in one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import scalars as S
from codelode.functions.access import bit

# --- fixed values: descriptors a string decryptor can have -------------------------------------
DECRYPTOR_DESCS = [
    "(Ljava/lang/String;)Ljava/lang/String;",
    "(ILjava/lang/String;)Ljava/lang/String;",
    "(Ljava/lang/String;I)Ljava/lang/String;",
]
BIG_SWITCH = 50
METHOD = ["archive_id", "owner", "method", "desc"]


def _any_contains(c: Column, *texts: str) -> Column:
    return S._any([c.contains(t) for t in texts])


def _has(cond: Column, alias: str) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False)).alias(alias)


def class_features(classes: DataFrame, own_prefix: str | None = None) -> DataFrame:
    """Name shapes and marker names, per archive; undecodable classes count for names only.

    ``own_prefix`` leaves out the classes of the analysing product itself.
    """
    rows = classes.filter(F.col("runtime_version") == 0)
    if own_prefix:
        rows = rows.filter(~F.col("internal_name").startswith(own_prefix))
    s, n = F.col("simple_name"), F.col("internal_name")
    # Marker names count once per archive however often they are repeated, name shapes once per entry:
    # counting the entries of each name first answers both without distinct aggregates.
    named = rows.groupBy("archive_id", "internal_name", "simple_name").agg(
        F.count("*").alias("n"), F.count_if("decoded").alias("readable")
    )
    entries = lambda cond, alias: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(alias)
    marked = lambda cond, alias: F.count_if(cond).alias(alias)
    return named.groupBy("archive_id").agg(
        F.sum("readable").alias("class_count"),
        entries((F.length(s) <= 2) & s.rlike(r"^[a-zA-Z]+\z"), "short_named"),
        entries(s.rlike(r"^[IlL1]{4,}\z"), "lookalike_named"),
        entries((S.utf16_length(s) > 20) & s.rlike(r"^[IlO01]+\z"), "long_confusable_named"),
        entries(s.rlike(r"[^\x00-\x7F]"), "unicode_named"),
        marked(_any_contains(n, "StringerHelper", "StringerRT", "com/licel/stringer", "stringer/"), "stringer_classes"),
        marked(_any_contains(n, "Skidfuscator", "$SKID", "$skid$", "skidfuscator/"), "skid_classes"),
        marked(_any_contains(n, "paramorphism", "Paramorphism"), "paramorphism_classes"),
        marked(_any_contains(n, "binscure", "Binscure"), "binscure_classes"),
        marked(_any_contains(n, "caesium", "Caesium"), "caesium_classes"),
        marked(_any_contains(n, "QProtect", "qprotect"), "qprotect_classes"),
        marked(n.startswith("kotlin/") | n.startswith("org/jetbrains/kotlin/"), "kotlin_classes"),
    )


def method_features(methods: DataFrame, instructions: DataFrame, try_catch: DataFrame) -> DataFrame:
    """Native classes, decryptor-shaped methods, big switches, and crashing first methods, per archive."""
    op = F.col("opcode")
    body = instructions.groupBy(*METHOD).agg(
        F.count_if(F.coalesce("pseudo_kind", F.lit("")) != "FRAME").alias("nodes"),
        F.bool_or(op.isin(130, 96, 100)).alias("mixes"),
        F.bool_or(
            op.between(182, 185) & (F.col("ref_owner") == "java/lang/String") & (F.col("ref_name") == "<init>")
        ).alias("makes_string"),
        F.coalesce(F.max(F.when(op == 170, F.col("switch_cases"))), F.lit(0)).alias("cases"),
    ).withColumnRenamed("method", "name")
    handlers = try_catch.groupBy(*METHOD).agg(F.count("*").alias("handlers")).withColumnRenamed("method", "name")
    key = ["archive_id", "owner", "name", "desc"]
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = methods.join(body, key, "left").join(handlers, key, "left").select(
        "archive_id", "owner", "ordinal",
        bit(F.col("access"), "native", "method").alias("native"),
        (
            bit(F.col("access"), "static", "method") & F.col("desc").isin(DECRYPTOR_DESCS) & zero("nodes").between(8, 400)
            & F.coalesce(F.col("mixes") & F.col("makes_string"), F.lit(False))
        ).alias("decryptor"),
        (zero("cases") > BIG_SWITCH).alias("big_switch"),
        ((S.utf16_length(F.col("name")) <= 2) & (zero("nodes") > 100) & (zero("handlers") > 3)).alias("crasher"),
    )
    per_class = rows.groupBy("archive_id", "owner").agg(
        F.bool_or("native").alias("native"),
        F.count_if("decryptor").alias("decryptors"),
        F.count_if("big_switch").alias("big_switches"),
        F.min_by("crasher", "ordinal").alias("crasher"),
    )
    return per_class.groupBy("archive_id").agg(
        F.count_if("native").alias("native_classes"),
        F.sum("decryptors").alias("decryptors"),
        F.sum("big_switches").alias("big_switches"),
        F.count_if("crasher").alias("crasher_classes"),
    )


def literal_features(instructions: DataFrame) -> DataFrame:
    """String-literal counts, entropy and markers: each distinct literal of an archive is measured once."""
    literals = (
        instructions.filter(F.col("opcode").isin(18, 19) & (F.col("const_kind") == "string"))
        .groupBy("archive_id", F.col("const_str").alias("s"))
        .agg(F.count("*").alias("n"))
        .withColumn("entropy", S.shannon_entropy(F.col("s")))
    )
    s, low, n, e = F.col("s"), F.lower("s"), F.col("n"), F.col("entropy")
    odd = F.when((e >= 4.5) & (S.utf16_length(s) >= 8), n).otherwise(0) + F.when(S.control_char_heavy(s), n).otherwise(0)
    return literals.groupBy("archive_id").agg(
        F.sum("n").alias("literals"),
        F.sum(odd).alias("encrypted_literals"),
        (F.sum(F.floor(e * 1000) * n) / F.sum("n") / 1000.0).alias("average_entropy"),
        F.count_if(low.contains("skidfuscator") | s.contains("Skidded by")).alias("skid_strings"),
        F.count_if(low.contains("caesium")).alias("caesium_strings"),
        F.count_if(_any_contains(s, "DashO", "PreEmptive")).alias("dasho_strings"),
        F.count_if(low.contains("yguard")).alias("yguard_strings"),
        F.count_if(_any_contains(s, "native-obfuscator", "native_obfuscator") | s.startswith("native0")).alias("native_strings"),
    )


def dynamic_features(instructions: DataFrame) -> DataFrame:
    """Dynamic call sites and the distinct owners of their bootstraps."""
    owners = (
        instructions.filter(F.col("opcode") == 186)
        .groupBy("archive_id", F.col("bsm_owner").alias("o"))
        .agg(F.count("*").alias("n"))
    )
    o = F.col("o")
    return owners.groupBy("archive_id").agg(
        F.sum("n").alias("dynamic_sites"),
        F.count_if(_any_contains(o, "stringer", "licel")).alias("stringer_bootstraps"),
        F.count_if(F.lower(o).contains("qprotect")).alias("qprotect_bootstraps"),
    )


def resource_features(resources: DataFrame) -> DataFrame:
    p = F.col("path")
    kind = S.resource_kind(p) if "kind" not in resources.columns else F.col("kind")
    return resources.withColumn("kind", kind).groupBy("archive_id").agg(
        F.count("*").alias("resource_count"),
        _has(_any_contains(p, "META-INF/proguard", "proguard.txt", "proguard.cfg"), "proguard_config"),
        _has(_any_contains(p, "META-INF/android.arsc", "classes.dex"), "android_files"),
        _has(_any_contains(p, "mapping.txt", "seeds.txt"), "mapping_file"),
        _has(_any_contains(p, "ALLATORI", "allatori"), "allatori_file"),
        _has(_any_contains(p, "dasho.txt", "DashO", "META-INF/DASHO"), "dasho_file"),
        _has(_any_contains(p, "yguard", "yGuard"), "yguard_file"),
        _has(_any_contains(p, "natives/", "native0.so", "native0.dll"), "natives_layout"),
        F.count_if(F.col("kind") == "NATIVE_DLL").alias("dlls"),
        F.count_if(F.col("kind") == "NATIVE_SO").alias("sos"),
        F.count_if(F.col("kind") == "NATIVE_DYLIB").alias("dylibs"),
    )


def variable_features(local_vars: DataFrame) -> DataFrame:
    return local_vars.groupBy("archive_id").agg(
        F.count("*").alias("variables"), F.count_if(F.col("name").rlike(r"^arg\d+\z")).alias("arg_n_variables")
    )


def archive_features(
    classes: DataFrame,
    methods: DataFrame,
    instructions: DataFrame,
    try_catch: DataFrame,
    resources: DataFrame,
    local_vars: DataFrame,
    own_prefix: str | None = None,
) -> DataFrame:
    """One wide feature row per archive; counters default to 0 and markers to false."""
    if own_prefix:
        keep = lambda df: df.filter(~F.col("owner").startswith(own_prefix))
        methods, instructions, try_catch = keep(methods), keep(instructions), keep(try_catch)
        local_vars = keep(local_vars)
    parts = [
        class_features(classes, own_prefix),
        method_features(methods, instructions, try_catch),
        literal_features(instructions),
        dynamic_features(instructions),
        resource_features(resources),
        variable_features(local_vars),
    ]
    wide = reduce(lambda a, b: a.join(b, "archive_id", "full"), parts)
    out = [F.col("archive_id")]
    for f in wide.schema.fields:
        if f.name == "archive_id":
            continue
        blank = {"boolean": F.lit(False), "double": F.lit(0.0)}.get(f.dataType.simpleString(), F.lit(0).cast("long"))
        out.append(F.coalesce(f.name, blank).alias(f.name))
    return wide.select(*out)


# --- scoring -----------------------------------------------------------------------------------


@dataclass
class Signal:
    when: Column
    score: Column
    text: Column
    weight: Column


@dataclass
class Detector:
    name: str
    family: str
    signals: list[Signal]
    limit: Callable[[Column], Column] | None = None

    def result(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(s.when, s.score).otherwise(F.lit(0.0)) for s in self.signals])
        if self.limit:
            total = self.limit(total)
        evidence = F.filter(
            F.array(*[F.when(s.when, F.struct(s.text.alias("description"), s.weight.cast("double").alias("weight"))) for s in self.signals]),
            lambda x: x.isNotNull(),
        )
        return F.struct(
            F.lit(self.name).alias("name"),
            F.lit(self.family).alias("family"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("confidence"),
            evidence.alias("evidence"),
        )


def _signal(when: Column, score, text, weight) -> Signal:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return Signal(when, col(score), col(text), col(weight))


def detectors() -> list[Detector]:
    """The twelve detectors, in report order."""
    c = F.col
    ratio = lambda n: F.when(c("class_count") == 0, F.lit(0.0)).otherwise(c(n) / c("class_count"))
    share = lambda r, rest: F.format_string("%.0f%% " + rest, r * 100)
    some = lambda n: c(n) > 0
    told = lambda n, rest: F.concat(c(n).cast("string"), F.lit(rest))
    cap = lambda top, x: F.least(F.lit(top), x)

    short, lookalike = ratio("short_named"), ratio("lookalike_named")
    confusable, unicode = ratio("long_confusable_named"), ratio("unicode_named")
    libs = c("dlls") + c("sos") + c("dylibs")
    hard = c("natives_layout") | some("native_strings")
    arg_n = F.when(c("variables") > 0, c("arg_n_variables") / c("variables")).otherwise(0.0)
    return [
        Detector("ProGuard / R8", "NAME_STRIPPER", [
            _signal(short > 0.25, cap(0.6, short), share(short, "of class names are one or two characters long"), short),
            _signal(c("proguard_config"), 0.35, "a shrinker configuration lies under META-INF", 0.9),
            _signal(c("android_files"), 0.1, "files of an Android build", 0.3),
            _signal(c("mapping_file"), 0.2, "a mapping or seeds file is packed along", 0.7),
        ]),
        Detector("ZKM (Zelix KlassMaster)", "STRING_ENCRYPTION", [
            _signal(lookalike > 0.15, cap(0.55, lookalike * 1.3), share(lookalike, "of class names are made of look-alike letters"), lookalike),
            _signal(c("decryptors") >= 5, cap(0.35, c("decryptors") / 80.0),
                    told("decryptors", " static methods are shaped like string decryptors"), cap(1.0, c("decryptors") / 30.0)),
            _signal(some("big_switches"), cap(0.25, c("big_switches") / 40.0),
                    told("big_switches", " methods dispatch over more than 50 cases"), cap(1.0, c("big_switches") / 10.0)),
            _signal((c("average_entropy") > 5.5) & (c("literals") > 50), 0.15,
                    F.format_string("literals average %.1f bits a character", c("average_entropy")), 0.5),
        ]),
        Detector("Allatori", "NAME_STRIPPER", [
            _signal(confusable > 0.1, cap(0.6, confusable * 1.5), share(confusable, "of class names are long runs of look-alike characters"), confusable),
            _signal(c("allatori_file"), 0.4, "a resource is named after the tool", 0.95),
            _signal((unicode > 0.15) & (unicode < 0.9), 0.2, share(unicode, "of class names leave ASCII"), unicode),
        ]),
        Detector("native-obfuscator (radioegor146)", "NATIVE", [
            _signal(libs > 0, cap(0.25, libs / 12.0),
                    F.concat(F.lit("native libraries: "), told("dlls", " dll, "), told("sos", " so, "), told("dylibs", " dylib")), cap(1.0, libs / 4.0)),
            _signal(c("natives_layout"), 0.5, "libraries are numbered under natives/", 0.95),
            _signal(some("native_classes"), cap(0.15, c("native_classes") / 60.0), told("native_classes", " classes hold native methods"),
                    cap(1.0, c("native_classes") / 10.0)),
            _signal(some("native_strings"), 0.35, "literals name the tool's libraries", 0.85),
            _signal((c("kotlin_classes") > 100) & ~hard, -0.6,
                    told("kotlin_classes", " Kotlin classes and no mark of the tool: ordinary native code"), -0.6),
        ], lambda total: F.when(hard, total).otherwise(cap(0.4, total))),
        Detector("Stringer (Licel)", "STRING_ENCRYPTION", [
            _signal(some("stringer_classes"), 0.6, told("stringer_classes", " classes are named like the tool's helpers"), 0.95),
            _signal(some("stringer_bootstraps"), 0.4, told("stringer_bootstraps", " dynamic calls are bootstrapped by the tool"), 0.9),
            _signal((c("dynamic_sites") > 50) & (c("encrypted_literals") > 20), 0.2,
                    F.concat(told("dynamic_sites", " dynamic calls beside "), told("encrypted_literals", " literals that look encrypted")), 0.6),
        ]),
        Detector("Skidfuscator", "FLOW_OBFUSCATION", [
            _signal(some("skid_classes"), 0.7, told("skid_classes", " classes bear the tool's mark"), 0.98),
            _signal(some("skid_strings"), 0.35, told("skid_strings", " literals mention the tool"), 0.98),
            _signal((c("big_switches") > 10) & (c("dynamic_sites") > 30), 0.15, "many wide switches together with dynamic calls", 0.4),
        ]),
        Detector("Paramorphism", "ANTI_ANALYSIS", [
            _signal((c("variables") > 50) & (arg_n > 0.4), cap(0.7, arg_n), share(arg_n, "of local variables are called arg and a number"), arg_n),
            _signal(some("paramorphism_classes"), 0.4, "class names bear the tool's mark", 0.95),
        ]),
        Detector("Binscure", "ANTI_ANALYSIS", [
            _signal(some("binscure_classes"), 0.55, "class names bear the tool's mark", 0.95),
            _signal((c("crasher_classes") > c("class_count") * 0.3) & (c("class_count") > 20), 0.35,
                    told("crasher_classes", " classes are built to crash readers"), 0.7),
        ]),
        Detector("Caesium", "FLOW_OBFUSCATION", [
            _signal(some("caesium_classes"), 0.8, told("caesium_classes", " classes bear the tool's mark"), 0.95),
            _signal(some("caesium_strings"), 0.3, "literals mention the tool", 0.8),
        ]),
        Detector("QProtect", "OTHER", [
            _signal(some("qprotect_classes"), 0.7, told("qprotect_classes", " classes bear the tool's mark"), 0.95),
            _signal(some("qprotect_bootstraps"), 0.35, told("qprotect_bootstraps", " dynamic calls are bootstrapped by the tool"), 0.95),
        ]),
        Detector("DashO", "NAME_STRIPPER", [
            _signal(c("dasho_file"), 0.7, "resources left by the tool", 0.9),
            _signal(some("dasho_strings"), 0.3, "literals mention the tool or its maker", 0.8),
        ]),
        Detector("yGuard", "NAME_STRIPPER", [
            _signal(c("yguard_file"), 0.7, "a resource mentions the tool", 0.9),
            _signal(some("yguard_strings"), 0.3, "literals mention the tool", 0.85),
        ]),
    ]


def level(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "HIGH").when(confidence >= 0.3, "MEDIUM").when(confidence > 0, "LOW").otherwise("NONE")


def detect(features: DataFrame, using: list[Detector] | None = None) -> DataFrame:
    """One row per archive and detector: ``position, name, family, confidence, level, evidence``."""
    results = F.array(*[d.result() for d in using or detectors()])
    return features.select("archive_id", F.posexplode(results).alias("position", "d")).select(
        "archive_id", "position", "d.name", "d.family", "d.confidence", level(F.col("d.confidence")).alias("level"), "d.evidence"
    )


def ranked(detections: DataFrame) -> DataFrame:
    """Detections by level, then falling confidence; what was not detected is left out."""
    order = F.array_position(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), F.col("level"))
    return detections.filter(F.col("level") != "NONE").orderBy(
        "archive_id", order, F.col("confidence").desc(), "position"
    )


def undetected(detections: DataFrame) -> DataFrame:
    """What was looked for and not found: ``(archive_id, position, name)``."""
    return detections.filter(F.col("level") == "NONE").select("archive_id", "position", "name")


def top_detection(detections: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """The surest detector per archive (first on ties) with its first evidence as the reason.

    With the ``features (archive_id, class_count, ...)`` they were made from, an archive without classes is told apart.
    """
    seen = F.col("level") != "NONE"
    best = F.max_by(
        F.struct("name", "confidence", F.get("evidence", 0)["description"].alias("reason")),
        F.when(seen, F.struct("confidence", -F.col("position"))),
    )
    d = F.col("d")
    per_archive = detections.groupBy("archive_id").agg(best.alias("d"))
    if features is not None:
        empty = features.filter(F.coalesce("class_count", F.lit(0)) == 0).select("archive_id")
        none = empty.select("archive_id", F.lit("None").alias("name"), F.lit(0.0).alias("confidence"), F.lit("the archive has no classes").alias("reason"))
        return top_detection(detections.join(empty, "archive_id", "left_anti")).unionByName(none)
    return per_archive.select(
        "archive_id",
        F.coalesce(d["name"], F.lit("None / Unknown")).alias("name"),
        F.coalesce(d["confidence"], F.lit(0.0)).alias("confidence"),
        F.when(d.isNull(), "nothing points to an obfuscator")
        .otherwise(F.coalesce(d["reason"], F.lit("its weights alone")))
        .alias("reason"),
    )
