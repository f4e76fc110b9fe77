"""Personal data replaced by keyed surrogates of the same kind and format, in DataFrame operations only."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import stored

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MALE, _FEMALE = r"(?:Mr|Herr|Monsieur|Señor|Sr|Г-н|Κύριος)", r"(?:Mrs|Ms|Miss|Frau|Madame|Señora|Sra|Г-жа|Κυρία)"
_TITLED = rf"(?:{_MALE}|{_FEMALE})\.? "
#: Kinds in order of precedence; the first that matches a span names it.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "person": rf"(?<!\p{{L}}){_TITLED}\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|gh[pousr])[_-][0-9A-Za-z_-]{16,})(?![0-9A-Za-z])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "card": r"(?<!\w)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these holds nothing that PATTERN finds.
HINT = rf"\d|@|{_TITLED}|[A-F]{{32}}|[a-f]{{32}}|AKIA|(?:sk|pk|gh[pousr])[_-]"
#: Letters that stand for one another in names, per script: vowels, consonants, endings of male and female names.
SCRIPTS = {
    "[a-z]": ("aeiou", "bcdfghklmnprstvw", "n", "a"),
    "[а-я]": ("аеиоу", "бвгдзклмнпрст", "н", "а"),
    "[α-ω]": ("αειου", "βγδζκλμνπρτ", "ν", "α"),
}
#: Draws that keep a name's ending, and draws of the same length; after them a replacement is one letter or digit longer each time.
STRICT, SAME_LENGTH = 3, 5


def _alphabets() -> list[tuple[str, str]]:
    """The small letters of every script that has capitals, by code point, and those that stand for them."""
    by: dict[str, str] = {}
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Ll" and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c:
            script = unicodedata.name(c).split(" SMALL ")[0].split(" LETTER ")[0]
            by[script] = by.get(script, "") + c
    own = {"LATIN": "aeiou", "CYRILLIC": "".join(SCRIPTS["[а-я]"][:2]), "GREEK": "".join(SCRIPTS["[α-ω]"][:2])}
    return [(by[s], own.get(s, by[s] if len(by[s]) > 4 else own["LATIN"])) for s in sorted(by, key=lambda s: (s not in own, s))]


ALPHABETS = _alphabets()


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(out)
    return out


def norm_of(kind: Column, entity: Column) -> Column:
    """What two spellings of one entity share: digits of numbers, lower case, a name's gender and words without title."""
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    title = F.regexp_replace(entity, rf"^{_TITLED}", "")
    gender = F.when(F.regexp_like(entity, F.lit(rf"^{_FEMALE}\.? ")), F.lit("f ")).otherwise(F.lit("m "))
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "person", F.concat(gender, F.lower(title)))
        .when(kind == "secret", entity)
        .otherwise(F.lower(entity))
    )


def _bytes(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """As many keyed pseudo-random bytes as ``norm`` has characters, as an array of 0..255."""
    def digest(i):
        return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), i.cast("string"), norm).cast("binary"), 256)

    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 32).cast("int")), digest), "")
    return F.transform(F.sequence(F.lit(1), F.length(norm)), lambda i: F.conv(F.substr(stream, 2 * i - F.lit(1), F.lit(2)), 16, 10).cast("int"))


def _pick(letters: str, value: Column) -> Column:
    return F.substr(F.lit(letters), (value % len(letters) + 1).cast("int"), F.lit(1))


def _luhn(digits: Column) -> Column:
    """Sum of the card check over an array of digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _longer(kind: Column, norm: Column, by: Column) -> Column:
    """``norm`` with ``by`` more characters to be drawn: before an address, at the end of anything else."""
    fill = F.when(kind == "person", F.substr(norm, F.length(norm), F.lit(1))).otherwise(F.lit("0"))
    return F.when(kind == "email", F.concat(F.repeat(F.lit("a"), by), norm)).otherwise(F.concat(norm, F.repeat(fill, by)))


def _with_surrogate(named: DataFrame, key: str) -> DataFrame:
    """``named (kind, norm, attempt, ...)`` with ``new``, the replacement of the normalised entity, itself normalised.

    Each step is a column of its own, so nothing is worked out once per character.
    """
    kind, norm, rnd, chars, more = F.col("kind"), F.col("_long"), F.col("_rnd"), F.col("_chars"), F.col("_more")
    value = lambda i: F.get(rnd, i)
    steps = named.withColumn("_more", F.greatest(F.col("attempt") - F.lit(SAME_LENGTH - 1), F.lit(0)).cast("int"))
    steps = steps.withColumn("_long", _longer(kind, F.col("norm"), more))
    steps = steps.withColumn("_rnd", _bytes(key, kind, norm, F.col("attempt"))).withColumn("_chars", F.split(norm, ""))
    steps = steps.withColumn("_hex", (kind == "secret") & F.regexp_like(norm, F.lit("^[0-9a-fA-F]+$")))
    low, up = F.lit("[a-z]"), F.lit("[A-Z]")
    steps = steps.withColumn(
        "_mapped",
        F.transform(
            chars,
            lambda c, i: F.when(F.regexp_like(c, F.lit("[0-9]")), _pick("0123456789", value(i)))
            .when(F.regexp_like(c, low), F.when(F.col("_hex"), _pick("abcdef", value(i))).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", value(i))))
            .when(F.regexp_like(c, up), F.when(F.col("_hex"), _pick("ABCDEF", value(i))).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", value(i))))
            .otherwise(c),
        ),
    ).withColumn("_plain", F.array_join("_mapped", ""))
    # A card stays valid, or invalid: its last digit is set anew.
    digits = lambda a: F.transform(a, lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    steps = steps.withColumn("_sum", _luhn(digits(F.split(F.col("norm"), ""))) % 10)
    steps = steps.withColumn("_body", _luhn(F.concat(digits(F.slice("_mapped", 1, F.size("_mapped") - 1)), F.array(F.lit(0)))) % 10)
    card = F.concat(F.substr("_plain", F.lit(1), F.length("_plain") - 1), ((F.col("_sum") + 10 - F.col("_body")) % 10).cast("string"))
    # An address keeps its last label, a name its script, length, words and gender.
    mail = F.concat(F.regexp_replace("_plain", r"\.[^.]*$", ""), F.regexp_extract(norm, r"(\.[^.]*)$", 1))
    ip = F.concat_ws(".", (F.get(rnd, F.lit(0)) % 223 + 1).cast("string"), *[F.get(rnd, F.lit(i)).cast("string") for i in (1, 2, 3)])
    ip = F.when(more == 0, ip).otherwise(F.concat_ws(".", ip, F.array_join(F.slice(rnd, 5, more).cast("array<string>"), ".")))
    steps = steps.withColumn("_female", F.regexp_like(norm, F.lit("^f ")))

    def letter(c, i):
        last = (F.col("attempt") < STRICT) & ((i == F.size(chars) - 1) | (F.get(chars, i + 1) == " "))
        out = F.when(F.regexp_like(c, F.lit(r"\p{L}")), _pick("aeiou", value(i))).otherwise(c)
        for letters, stand in reversed(ALPHABETS):
            out = F.when(F.instr(F.lit(letters), c) > 0, _pick(stand, value(i))).otherwise(out)
        plain = F.when(last, F.when(F.col("_female"), F.lit("a")).otherwise(F.lit("n"))).otherwise(_pick("aeiou", value(i)))
        out = F.when(F.regexp_like(c, F.lit(r"\p{IsLatin}")), plain).otherwise(out)
        for script, (vowels, consonants, male, female) in SCRIPTS.items():
            inner = F.when(F.regexp_like(c, F.lit(f"[{vowels}]")), _pick(vowels, value(i))).otherwise(_pick(consonants, value(i)))
            ending = F.when(F.col("_female"), F.lit(female)).otherwise(F.lit(male))
            out = F.when(F.regexp_like(c, F.lit(script)), F.when(last, ending).otherwise(inner)).otherwise(out)
        return F.when(i < 2, c).otherwise(out)

    new = (
        F.when(kind == "card", card).when(kind == "email", mail).when(kind == "ip", ip)
        .when(kind == "person", F.array_join(F.transform(chars, letter), "")).otherwise(F.col("_plain"))
    )
    return steps.withColumn("new", new).select(*named.columns, "new")


def laid_out(kind: Column, entity: Column, replacement: Column) -> Column:
    """A normalised replacement in the spelling of ``entity``: its separators, title and capitals."""
    chars = F.split(entity, "")
    before = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), "[^0-9]", ""))
    number = F.transform(chars, lambda c, i: F.when(F.regexp_like(c, F.lit("[0-9]")), F.substr(replacement, before(i), F.lit(1))).otherwise(c))
    # What a lengthened replacement has more.
    number = F.concat(F.array_join(number, ""), F.substr(replacement, before(F.length(entity)) + 1))
    name = F.concat(F.regexp_extract(entity, rf"^({_TITLED})", 1), F.initcap(F.substr(replacement, F.lit(3))))
    head = F.length(replacement) - F.length(entity)
    part = lambda i: F.substr(replacement, head + i + 1, F.lit(1))
    cased = F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(part(i))).otherwise(part(i)))
    return (
        F.when(kind.isin("phone", "card", "ssn"), number).when(kind == "person", name)
        .when(kind == "email", F.concat(F.substr(replacement, F.lit(1), head), F.array_join(cased, ""))).otherwise(replacement)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, new`` for distinct ``entities (kind, norm)``, no two of a kind with one replacement and none with a real entity's.

    Of several with one replacement the smallest norm keeps it; the others, and those that read like a real one, are drawn again.
    A format may hold fewer replacements than the data has entities, or none: draws first give up a name's ending, then the length.
    Each draw that is one longer has at least five times the replacements of the last, so the rest always finds one.
    """
    now = stored(_with_surrogate(entities.withColumn("attempt", F.lit(0)), key), "entities")
    while True:
        holder = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "norm"))["norm"].alias("holder"))
        real = now.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real"))
        told = now.join(holder, ["kind", "new"]).join(real, ["kind", "new"], "left")
        told = told.withColumn("clash", (F.col("norm") != F.col("holder")) | F.col("real").isNotNull())
        if not told.where("clash").take(1):
            return now.select("kind", "norm", "new")
        again = _with_surrogate(told.where("clash").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), key)
        now = stored(told.where("not clash").select("kind", "norm", "attempt", "new").unionByName(again), "entities")


def pseudonymise(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """``docs (doc_id, text, ...)`` with every detected entity in ``text`` replaced, and ``n_entities``.

    Mail and network addresses, phone, card and social security numbers, secrets and titled names are found by one pattern.  A replacement is
    drawn from the SHA-256 of the key, the kind and the normalised entity, so an entity reads the same wherever it stands and
    however it is spelled, and keeps its format: separators, capitals, length, top-level label, validity of a card's check
    digit, a name's title, script, words and gender; where a format has no replacement left, its length grows.
    The distinct entities, a small table beside the texts, are checked for replacements that
    two share or that are someone's real data, and those are drawn again.

    Only texts with an entity are shuffled.  The pieces between entities are kept byte for byte.  Null stays null; a text without
    entities, empty or not, is returned as it is.  Equal rows give equal rows, the result does not depend on their order, and
    an empty table gives an empty result.
    """
    text = F.col("text")
    found = F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    looked = docs.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    clean = looked.where(F.size("_found") == 0).drop("_found").withColumn("n_entities", F.lit(0))
    cased = looked.where(F.size("_found") > 0).withColumn("_digest", F.sha2(text, 256))
    spots = stored(cased.select("_digest", F.posexplode("_found").alias("pos", "entity")).distinct(), "spots")
    named = spots.select("entity").distinct().withColumn("kind", kind_of(F.col("entity")))
    named = stored(named.withColumn("norm", norm_of(F.col("kind"), F.col("entity"))), "named")
    drawn = named.join(surrogates(named.select("kind", "norm").distinct(), key), ["kind", "norm"])
    drawn = stored(drawn.select("entity", laid_out(F.col("kind"), F.col("entity"), F.col("new")).alias("new")), "drawn")
    news = spots.join(drawn, "entity").groupBy("_digest").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("_news"))
    # A text has one piece more than it has entities.
    whole = F.concat(
        F.get("_pieces", F.lit(0)),
        F.array_join(F.zip_with("_news", F.slice("_pieces", 2, F.size("_news")), lambda a, b: F.concat(a["new"], b)), ""),
    )
    joined = cased.withColumn("_pieces", F.split(text, PATTERN, -1)).join(news, "_digest")
    done = joined.select(*[whole.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.size("_news").alias("n_entities"))
    return clean.unionByName(done)
