"""Benchmark decontamination by spaced seeds, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import stored

#: Positions that each mask reads; whichever two of WINDOW words are substituted, one of the masks still fits between them.
MASKS = ((0, 1, 4, 7, 8, 9), (0, 1, 3, 4, 5, 6))
#: For items that MASKS fit, but of fewer than COVERED words: the first at an item's start, the second at its end; one word replaced spares one of them.
SHORT, COVERED = ((0, 1, 2), (0, 1, 2, 3)), 10
_EVERY = MASKS + SHORT
_LEAST = 1 + min(m[-1] for m in MASKS)
WINDOW, SUBSTITUTIONS = 13, 2
_BEFORE = WINDOW - 1 - min(m[-1] for m in MASKS)
_SPAN = _BEFORE + WINDOW


def _hashes(text: Column) -> Column:
    """Hashes of the words of a text: runs of letters and digits in lower case."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def _seed(h: str, mask: int, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(F.col(h), at + o) for o in _EVERY[mask]])


def _starts(h: str, mask: int) -> Column:
    last = F.size(h) - 1 - _EVERY[mask][-1]
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _item_starts(h: str, mask: int) -> Column:
    """Where an item is read under a mask."""
    if mask < len(MASKS):
        return _starts(h, mask)
    at = F.lit(0) if mask == len(MASKS) else F.size(h) - len(_EVERY[mask])
    return F.when(F.size(h).between(_LEAST, COVERED - 1), F.array(at)).otherwise(F.array().cast("array<int>"))


def _around(h: str, at: Column, blank: int) -> Column:
    """The words of every window that contains the seed at ``at``; ``blank`` stands for words beyond the text."""
    padded = F.concat(F.array_repeat(F.lit(blank).cast("long"), _BEFORE), F.col(h), F.array_repeat(F.lit(blank).cast("long"), WINDOW))
    return F.slice(padded, at + 1, _SPAN)


def _slot(key: Column, probe: int, bits: int) -> Column:
    return F.shiftrightunsigned(key, probe * bits).bitwiseAND(F.lit((1 << bits) - 1))


def _sieve(keys: DataFrame, bits: int) -> DataFrame:
    """One row with a bit per hash slot, set at each key's two slots: ``bits`` fixes its size, whatever the keys."""
    probes = keys.select(F.explode(F.array(*[_slot(F.col("key"), p, bits) for p in range(2)])).alias("slot"))
    slot = F.col("slot")
    word = F.shiftright(slot, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    marks = probes.groupBy(word.alias("id")).agg(F.bit_or(bit).alias("mark"))
    every = keys.sparkSession.range(1 << (bits - 6)).join(marks, "id", "left")
    rows = F.sort_array(F.collect_list(F.struct("id", F.coalesce("mark", F.lit(0).cast("long")).alias("mark"))))
    return every.agg(F.transform(rows, lambda r: r["mark"]).alias("marks")).withColumn("every", F.lit(1))


def overlaps(docs: DataFrame, benchmark: DataFrame, bits: int = 20) -> DataFrame:
    """``doc_id, item_id, hits, first_word``: the documents of ``docs (doc_id, text, ...)`` that hold WINDOW consecutive words of an item of
    ``benchmark (item_id, text, ...)`` with at most SUBSTITUTIONS of them replaced.

    A seed hashes the words that a mask reads and skips the others, so a substitution under a gap leaves it alike.  Every position
    of every document is hashed under each mask and looked up in a bit table of fixed size that the items' seeds have set;
    what passes is joined to the items by the full hash, carrying its surroundings along, and the words of
    the windows around are counted off.  A word beyond an end counts as replaced.  Items of fewer than WINDOW words must be held whole, with
    substitutions in proportion; items of fewer than COVERED words are also looked up by their first three and last four words, under masks
    that documents are hashed with only if there are such items.  Items shorter than the masks that fit them nowhere match nothing, as chance would.

    Words are compared without case and punctuation.  Null and empty texts, and rows without doc_id or item_id, match nothing.  Items of equal text are
    one, under their smallest id; rows that repeat a document raise ``hits``.  An empty table on either side gives an empty result.
    """
    items = benchmark.where("item_id is not null").select("item_id", _hashes(F.col("text")).alias("h"))
    items = items.groupBy("h").agg(F.min("item_id").alias("item_id"))
    seeds = None
    masks = range(len(_EVERY) if items.where(F.size("h").between(_LEAST, COVERED - 1)).take(1) else len(MASKS))
    for m in masks:
        one = items.select("item_id", "h", F.explode(_item_starts("h", m)).alias("at")).select(
            "item_id", F.size("h").alias("n"), _seed("h", m, F.col("at")).alias("key"), F.col("at").alias("item_at"), _around("h", F.col("at"), -1).alias("theirs")
        )
        seeds = one if seeds is None else seeds.unionByName(one)
    seeds = stored(seeds, "seeds")
    # One row of 2**bits bits: its size is proven, however large the benchmark; a full table only lets more through.
    sieve = F.broadcast(stored(_sieve(seeds, bits), "sieve"))

    def passes(key: Column) -> Column:
        out = F.lit(True)
        for p in range(2):
            slot = _slot(key, p, bits)
            mark = F.get("marks", F.shiftright(slot, 6).cast("int"))
            out = out & (F.call_function("shiftright", mark, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    hashed = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), _hashes(F.col("text")).alias("h"), F.lit(1).alias("every")
    )
    hashed = hashed.join(sieve, "every")

    def found(m: int) -> Column:
        hit = F.filter(_starts("h", m), lambda i: passes(_seed("h", m, i)))
        return F.transform(hit, lambda i: F.struct(_seed("h", m, i).alias("key"), i.alias("at"), _around("h", i, 0).alias("ours")))

    met = hashed.select("doc_id", F.explode(F.concat(*[found(m) for m in masks])).alias("s")).select("doc_id", "s.*").join(seeds, "key")
    same = F.zip_with("ours", "theirs", lambda a, b: (a == b).cast("int"))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(0), F.lit(_BEFORE)),
            lambda s: F.aggregate(F.slice("same", s + 1, WINDOW), F.lit(0), lambda t, x: t + x),
        )
    )
    need = F.when(F.col("n") >= WINDOW, WINDOW - SUBSTITUTIONS).otherwise(F.col("n") - F.floor(F.col("n") * SUBSTITUTIONS / WINDOW))
    sure = met.withColumn("same", same).where(best >= need)
    return sure.groupBy("doc_id", "item_id").agg(F.count("*").alias("hits"), F.min("at").cast("long").alias("first_word"))
