"""Repeated passages by a sparse suffix array over content-selected positions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import forget, stored
from codelode.llm.hashing import anchors, lists, shingles, text_bytes, word_hashes
from codelode.llm.substring import _blocker

#: Words per block, and blocks of context on either side of a position that the order looks at.
BLOCK, SIDE = 8, 6
_RIGHT, _LEFT = [f"r{i}" for i in range(SIDE)], [f"l{i}" for i in range(SIDE)]


def _selected(column: pa.Array, length: int):
    """Word hashes of each row, and the positions selected in it."""
    hashes, bounds = word_hashes(*text_bytes(column))
    grams = shingles(hashes, BLOCK)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = grams[low : max(low, high - BLOCK + 1)] if high - low >= length else grams[:0]
        # Two thirds of a passage hold a selected position, so at least a third of it lies to the right.
        yield hashes[low:high], own, np.unique(anchors(own, 2 * length // 3 - BLOCK + 1))


def _positions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(own[at]) for _, own, at in _selected(batch.column(1), length)]
            every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(every, [len(k) for k in keys])], names=["doc_id", "keys"])

    return run, "doc_id long, keys array<long>"


def _suffixes(length: int):
    """A row per selected position whose first block is shared: hashes of the blocks to its right and left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2)
            for i, (own, grams, at) in enumerate(_selected(batch.column(1), length)):
                at = at[np.isin(grams[at], wanted[i].values.to_numpy().view(np.uint64))]
                if not len(at):
                    continue
                pad = np.zeros(BLOCK * (SIDE + 1), np.uint64)
                blocks = shingles(np.concatenate([pad, own, pad]), BLOCK).view(np.int64)
                mid = at + len(pad)
                columns = [blocks[mid + BLOCK * k] for k in range(SIDE)] + [blocks[mid - BLOCK * (k + 1)] for k in range(SIDE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), ids[i], np.int64)), pa.array(at), *map(pa.array, columns)],
                    names=["doc_id", "pos", *_RIGHT, *_LEFT],
                )

    return run, "doc_id long, pos long, " + ", ".join(f"{c} long" for c in [*_RIGHT, *_LEFT])


def _extender(length: int):
    """Follow each diagonal of a pair both ways as far as the words agree; runs of ``length`` or more are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, a_bounds = word_hashes(*text_bytes(batch.column("text_a")))
            b, b_bounds = word_hashes(*text_bytes(batch.column("text_b")))
            rows = []
            for i in range(batch.num_rows):
                x, y = a[a_bounds[i] : a_bounds[i + 1]], b[b_bounds[i] : b_bounds[i + 1]]
                for d in batch.column("shifts")[i].as_py():
                    low, high = max(0, d), min(len(x), len(y) + d)
                    same = np.concatenate([[False], x[low:high] == y[low - d : high - d], [False]]).astype(np.int8)
                    edge = np.flatnonzero(np.diff(same))
                    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        if e - s >= length:
                            rows.append((batch.column("a")[i].as_py(), low + s, e - s, batch.column("b")[i].as_py(), low + s - d))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                names=["doc_id", "start", "length", "other_id", "other_start"],
            )

    return run, "doc_id long, start long, length long, other_id long, other_start long"


def _equal_run(columns: list[str], other: str):
    """How many leading blocks of two rows are equal."""
    total, so_far = F.lit(0), F.lit(True)
    for c in columns:
        so_far = so_far & (F.col(c) == F.col(f"{other}.{c}"))
        total = total + F.when(so_far, 1).otherwise(0)
    return total


def _holders(docs: DataFrame, met: DataFrame, length: int) -> DataFrame:
    """``x, y (doc_id, pos)``: each document that holds a window of ``length`` words with the first document that holds it.

    The smallest 8-word hash of a window is the smallest of some two thirds of it, so equal windows stand at shared
    positions.  The windows of a position are one block; of equal blocks only one is taken apart.
    """
    run, schema = _blocker(length, BLOCK)
    blocks = stored(docs.join(met, "doc_id").mapInArrow(run, schema), "blocks")
    place = F.struct("doc_id", "start")
    same = stored(
        blocks.groupBy("anchor", "block").agg(F.min(place).alias("low"), F.max("doc_id").alias("high"), F.first("seqs").alias("seqs")), "same"
    )
    places = stored(blocks.drop("seqs"), "places")
    forget(blocks)
    windows = same.select("anchor", "block", "low", "high", F.posexplode("seqs").alias("k", "seq"))
    at = F.struct(F.col("low.doc_id").alias("doc_id"), (F.col("low.start") + F.col("k")).cast("long").alias("pos"))
    equal = Window.partitionBy("anchor", "seq")
    first = windows.select("anchor", "block", "k", F.min(at).over(equal).alias("y"), F.max("high").over(equal).alias("last")).where("y.doc_id < last")
    # Windows of a block that lead to one place of one document along one shift are one candidate.
    shift = F.col("y.pos") - F.col("k")
    known = first.groupBy("anchor", "block", F.col("y.doc_id").alias("first_id"), shift.alias("shift")).agg(F.min("k").alias("k"))
    known = stored(known, "holders")
    forget(same)
    met_at = places.join(known, ["anchor", "block"]).where("doc_id <> first_id")
    pos = (F.col("start") + F.col("k")).cast("long")
    out = stored(
        met_at.select(
            F.struct("doc_id", pos.alias("pos")).alias("x"),
            F.struct(F.col("first_id").alias("doc_id"), (F.col("shift") + F.col("k")).cast("long").alias("pos")).alias("y"),
        ),
        "held",
    )
    forget(places, known)
    return out


def repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Maximal repeats of ``length`` or more words between two of ``docs (doc_id, text, ...)``: ``doc_id, start, length`` (words) of the
    later and ``other_id, other_start`` of the earlier document.

    Only suffixes at content-selected positions are kept: the smallest 8-word hash of each two thirds of ``length`` words, the same in every copy of a
    passage.  Those whose first block only one document has go at once.  The others are sorted by
    the blocks to their right, then by those to their left; equal contexts are one entry, whose documents are matched with its first.
    Entries are compared with their neighbours, and where agreeing blocks leave room for ``length`` words the two documents are extended
    left and right, word by word, along that shift.  Neighbours alone miss passages whose positions lie in a part that many others share, so
    each holder of a window of ``length`` words is also matched with the first document that holds it: a repeated
    passage is found in each document that holds it, whatever sorts between.  Not every pair of holders is listed.

    The sort is by range, so a passage that a third of all documents hold is spread; neighbours across two ranges are
    met through the ranges' ends.  Null, empty and short texts hold no repeat; rows without doc_id take no part; rows that
    repeat a doc_id count as one document and are not matched with each other.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    run, schema = _positions(length)
    slots = stored(docs.mapInArrow(run, schema).select("doc_id", F.explode("keys").alias("key")), "positions")
    shared = slots.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    met = stored(slots.join(shared, "key").groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "met")
    run, schema = _suffixes(length)
    suffixes = stored(docs.join(met, "doc_id").mapInArrow(run, schema), "suffixes")
    forget(slots)
    order = [*_RIGHT, *_LEFT]
    at = F.struct("doc_id", "pos")
    context = suffixes.groupBy(*order).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("copies"))
    placed = stored(context.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sorted")

    # Each entry against the one before it, within a range and across its start.
    entry = F.struct(*order, "first", "last")
    inside = placed.withColumn("before", F.lag(entry).over(Window.partitionBy("part").orderBy(*order)))
    ends = placed.groupBy("part").agg(F.min(entry).alias("head"), F.max(entry).alias("tail"))
    across = ends.select("head", F.lag("tail").over(Window.orderBy("part")).alias("before")).select("head.*", "before")
    pairs = inside.select(*order, "first", "last", "before").unionByName(across.select(*order, "first", "last", "before")).where("before is not null")
    right, left = _equal_run(_RIGHT, "before"), _equal_run(_LEFT, "before")
    room = F.when((right == SIDE) | (left == SIDE), F.lit(length)).otherwise((right + 1) * BLOCK - 1 + (left + 1) * BLOCK - 1)
    close = pairs.where((right > 0) & (room >= length))
    # Of two neighbouring entries, a holder of one and a holder of the other that differ, if there are any.
    neighbours = close.select(
        F.col("first").alias("x"), F.when(F.col("first.doc_id") != F.col("before.first.doc_id"), F.col("before.first")).otherwise(F.col("before.last")).alias("y")
    ).unionByName(close.select(F.col("last").alias("x"), F.col("before.first").alias("y")))
    several = placed.where("first.doc_id < last.doc_id").select(*[F.col(c).alias(f"_{c}") for c in order], "first")
    equal = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_{c}") for c in order])
    copies = suffixes.join(several, equal).select(at.alias("x"), F.col("first").alias("y"))
    near = stored(neighbours.unionByName(copies), "near")
    # What the suffix order took is gone before windows are taken apart.
    forget(suffixes, placed)
    held = _holders(docs, met, length)
    found = near.unionByName(held).where("x.doc_id <> y.doc_id").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    tried = stored(
        found.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.collect_set(F.col("x.pos") - F.col("y.pos")).alias("shifts")),
        "tried",
    )
    forget(near, held, met)
    run, schema = _extender(length)
    joined = tried.join(docs.toDF("a", "text_a"), "a").join(docs.toDF("b", "text_b"), "b")
    return joined.mapInArrow(run, schema).distinct()

