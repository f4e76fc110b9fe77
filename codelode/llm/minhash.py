"""Near-duplicate documents by b-bit MinHash with exact confirmation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import components, forget, measured_joins, stored
from codelode.llm.hashing import FACTORS, lists, mix, shingles, text_bytes, word_hashes

#: Signature: HASHES minima, of which BITS low bits are kept; BANDS bands of ROWS whole minima name candidates.
HASHES, BITS, BANDS, ROWS = 512, 2, 32, 4
_MULTIPLY = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
_LOW = 0x5555555555555555
_WORDS = HASHES * BITS // 64


def least_matches(percent: int, sigmas: float = 5.0) -> int:
    """Equal signature fields below which a pair at the threshold is ``sigmas`` deviations off.

    Minima that differ still agree in their low bits with chance 2**-BITS, so the expected share of equal fields
    is corrected for it: ``share = c + (1 - c) * similarity``.
    """
    chance = 2.0**-BITS
    share = chance + (1 - chance) * percent / 100
    return math.floor(HASHES * share - sigmas * math.sqrt(HASHES * share * (1 - share)))


def matches(a: str, b: str) -> Column:
    """Equal fields of two packed signatures ``{a}0..`` and ``{b}0..``, by bit counts."""
    differ = []
    for i in range(_WORDS):
        x = F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))
        differ.append(F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LOW))))
    return F.lit(HASHES) - reduce(lambda p, q: p + q, differ)


def estimate(a: str, b: str) -> Column:
    """Estimated similarity of two signatures, corrected for chance agreement."""
    chance = 2.0**-BITS
    return (matches(a, b) / F.lit(HASHES) - F.lit(chance)) / F.lit(1 - chance)


def _row_sets(data: np.ndarray, offsets: np.ndarray, size: int, fold: bool) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, bounds = word_hashes(data, offsets, fold)
    grams = shingles(hashes, size)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if high - low >= size:
            found = np.sort(grams[low : high - size + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        elif high > low:
            yield shingles(hashes[low:high], high - low)
        else:
            yield np.zeros(0, np.uint64)


def _sketcher(size: int, fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, packed, bands = [], [], [], []
            for found in _row_sets(*text_bytes(batch.column(1)), size, fold):
                counts.append(len(found))
                if not len(found):
                    digests.append(None)
                    packed.append(np.zeros(_WORDS, np.uint64))
                    bands.append(np.zeros(0, np.uint64))
                    continue
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(found), 512):
                    np.minimum(least, (found[i : i + 512, None] * _MULTIPLY).min(axis=0), out=least)
                least = mix(least)
                keys = (least[: BANDS * ROWS].reshape(BANDS, ROWS) * FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64)
                bands.append(mix(keys + np.arange(BANDS, dtype=np.uint64) * FACTORS[200]))
                low = (least.reshape(_WORDS, -1) & np.uint64((1 << BITS) - 1)) << np.arange(0, 64, BITS, dtype=np.uint64)
                packed.append(np.bitwise_or.reduce(low, axis=1))
            sig = np.array(packed, np.uint64).reshape(-1, _WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 *[pa.array(sig[:, i]) for i in range(_WORDS)],
                 lists(np.concatenate(bands) if bands else np.zeros(0, np.uint64), [len(b) for b in bands])],
                names=["doc_id", "n_shingles", "digest", *[f"s{i}" for i in range(_WORDS)], "bands"],
            )

    return run


def sketch(docs: DataFrame, size: int, fold: bool) -> DataFrame:
    """``doc_id, n_shingles, digest`` of the shingle set, the packed signature ``s0..`` and the band keys."""
    schema = "doc_id long, n_shingles long, digest binary, " + ", ".join(f"s{i} long" for i in range(_WORDS))
    return docs.select("doc_id", "text").mapInArrow(_sketcher(size, fold), f"{schema}, bands array<long>")


def shingle_sets(docs: DataFrame, size: int, fold: bool) -> DataFrame:
    """``node, grams``: the distinct shingle hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_row_sets(*text_bytes(batch.column(1)), size, fold))
            every = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(every, [len(x) for x in found])], names=["node", "grams"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "node long, grams array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of components: the ends ``ca, cb`` of the pairs ``a, b`` of nodes whose full sets reach the threshold."""
    joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = F.size(F.array_intersect("x", "y"))
    return joined.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _signed(nodes: DataFrame, classes: DataFrame, side: str) -> DataFrame:
    """``nodes`` with the size and signature of the class ``side``."""
    sig = ["n", *[f"s{i}" for i in range(_WORDS)]]
    return nodes.join(classes.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in sig]), side)


def _star_pairs(members: DataFrame, classes: DataFrame, percent: int, salt: list[str]) -> DataFrame:
    """Each member of a bucket against the bucket's centre, where size and signature allow a link.

    Centres are the members with the smallest hash of the node and ``salt``.  Without salt one text is the centre of most
    buckets it is in, and a group of copies brings about one pair per member rather than one per bucket.  With
    the key as salt, a member meets a centre of its own in each of its buckets.  Members of the centre's component are passed over.
    """
    centres = members.groupBy("key").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", *salt)).alias("c"))
    pairs = (
        members.join(centres, "key").where(F.col("component") != F.col("c.component"))
        .select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("component").alias("ca"), F.col("c.component").alias("cb")).distinct()
    )
    return _signed(_signed(pairs, classes, "a"), classes, "b").where(_may_link(percent)).select("a", "b", "ca", "cb")


def _open(members: DataFrame) -> DataFrame:
    """The rows of ``members (key, node, component, ...)`` in buckets that hold several components."""
    spread = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return members.join(spread.where("low < high").select("key"), "key")


def _joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (node, component)`` after ``links (a, b)`` of components."""
    top = components(links).toDF("component", "top")
    return labels.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def _may_link(percent: int) -> Column:
    sizes = (100 * F.least("a_n", "b_n")) >= (percent * F.greatest("a_n", "b_n"))
    return sizes & (matches("a_s", "b_s") >= least_matches(percent))


def _rest_links(rest: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All links between different components that meet in a bucket of ``rest (key, node, component)``, as ``a, b`` of components.

    Where a bucket joins a large component to others, only the others look for partners, and pairs within a component are
    never formed.  Size, signature and the full sets are tried inside the join, at the first bucket that a pair has in
    common, so what leaves it are links.  A row holds one set, however long: the join's memory does not grow with a bucket.
    """
    shares = rest.groupBy("key", "component").agg(F.count("*").alias("k"))
    major = shares.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("major"))
    sig = ["n", *[f"s{i}" for i in range(_WORDS)], "earlier", "grams"]
    signed = classes.select("node", "bands", *sig[:-2])
    full = rest.join(major, "key").join(signed, "node").join(sets, "node").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band")))
    a = full.where("component <> major").select(
        F.col("key").alias("a_key"), "major", F.col("node").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in sig]
    )
    b = full.select(F.col("key").alias("b_key"), F.col("node").alias("b"), F.col("component").alias("cb"), *[F.col(c).alias(f"b_{c}") for c in sig])
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    once = ~F.arrays_overlap("a_earlier", "b_earlier")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    linked = 100 * both >= percent * (F.col("a_n") + F.col("b_n") - both)
    met = a.join(b, (F.col("a_key") == F.col("b_key")) & apart & _may_link(percent) & once & linked)
    return met.select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, fold: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs (doc_id, text, ...)``.

    Documents are linked when ``100 * common >= percent * all`` over their sets of ``size``-word shingles (the whole
    text as one, if it has fewer words), and ``component_id`` is the smallest doc_id reachable over links.

    Equal sets are one class, so exact copies cost one row each.  Classes meet in buckets of equal bands (a link at
    the threshold is missed with chance (1 - 0.8**4)**32 < 1e-7); each is tried against its bucket's centre,
    first by packed low bits, then on the full sets.  Buckets that still hold several components
    elect centres of their own, and those that even then hold several are searched completely.  No group is paired with itself.

    A null or empty text, or one of blanks, has no shingles and stands alone.  A row without doc_id links with
    nothing, has no component_id and is kept.  Rows that repeat a doc_id are one document's and share its component.  Other
    columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stored(sketch(docs, size, fold), "sketch")
    sig = [f"s{i}" for i in range(_WORDS)]
    classes = stored(
        sketched.where("doc_id is not null and digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), *[F.first(s).alias(s) for s in sig], F.first("bands").alias("bands")),
        "classes",
    )
    slots = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = slots.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    with measured_joins(docs.sparkSession):
        members = stored(slots.join(shared, "key"), "members")
    nodes = members.select("node").distinct()
    sets = stored(
        shingle_sets(docs.join(nodes, docs["doc_id"] == nodes["node"], "left_semi"), size, fold), "sets"
    )
    alone = nodes.select("node", F.col("node").alias("component"))
    links = stored(_confirmed(_star_pairs(members.withColumn("component", F.col("node")), classes, percent, []), sets, percent), "links")
    first = stored(_joined_by(alone, links), "labels")
    unsettled = stored(_open(members.join(first, "node")), "open")
    more = stored(_confirmed(_star_pairs(unsettled, classes, percent, ["key"]), sets, percent), "links")
    second = stored(_joined_by(first, more), "labels")
    rest = stored(_open(unsettled.drop("component").join(second, "node")), "rest")
    last = stored(_rest_links(rest, sets, classes, percent), "links")
    final = stored(_joined_by(second, last), "components")
    by_digest = (
        classes.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    )
    out = stored(
        sketched.join(by_digest, "digest", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))),
        "near",
    )
    forget(sketched, classes, members, sets, links, first, unsettled, more, second, rest, last, final)
    return out
