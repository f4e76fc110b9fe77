"""Substring dedup by seed and extend: winnowed anchors, windows around shared ones, maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import forget, stored
from codelode.llm.hashing import FACTORS, anchors, as_longs, lists, mix, shingles, text_bytes, word_hashes, word_spans


def _grams(hashes: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Per row: its first word, gram hashes, and the anchor (by position among the grams) of each window of ``length`` words."""
    every = shingles(hashes, gram)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        grams = every[low : max(low, high - gram + 1)] if high - low >= gram else every[:0]
        yield low, grams, anchors(grams, length - gram + 1)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words of the given spans, joined by one space."""
    if not len(starts):
        return b""
    size = ends - starts + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    first = np.cumsum(size) - size
    for i in range(0, len(starts), 1 << 16):
        s, e, f = starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], first[i : i + (1 << 16)]
        n = e - s
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(f, n) + at] = data[np.repeat(s, n) + at]
    return out[:-1].tobytes()


def _seeder(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = word_hashes(*text_bytes(batch.column(1)))
            keys = [np.unique(grams[at]) for _, grams, at in _grams(hashes, bounds, length, gram)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(np.concatenate(keys) if keys else np.zeros(0, np.uint64), [len(k) for k in keys])],
                names=["doc_id", "anchors"],
            )

    return run, "doc_id long, anchors array<long>"


def _blocker(length: int, gram: int):
    """The windows of each shared anchor as one block: ``doc_id, anchor, start`` (of the first), ``seqs`` (a hash of each
    window's words) and ``block`` (a hash of them all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = word_hashes(*text_bytes(batch.column(1)))
            whole = shingles(hashes, length)
            ids, rows = batch.column(0).to_pylist(), batch.column(2)
            for i, (low, grams, at) in enumerate(_grams(hashes, bounds, length, gram)):
                shared = np.sort(rows[i].values.to_numpy().view(np.uint64))
                keys = grams[at]
                where = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
                start = np.flatnonzero(shared[where] == keys)
                if not len(start):
                    continue
                first = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(at[start]) != 0)))
                sizes = np.diff(np.append(first, len(start)))
                seqs = whole[low + start]
                place = np.arange(len(start)) - np.repeat(first, sizes)
                block = mix(np.add.reduceat(seqs * FACTORS[place], first) + sizes.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), ids[i], np.int64)), as_longs(keys[start[first]]),
                     pa.array(start[first].astype(np.int32)), lists(seqs, sizes.tolist()), as_longs(block)],
                    names=["doc_id", "anchor", "start", "seqs", "block"],
                )

    return run, "doc_id long, anchor long, start int, seqs array<long>, block long"


def _cutter(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            starts, ends, bounds = word_spans(data, offsets)
            counts, removed, digests, spans = [], [], [], []
            for i in range(batch.num_rows):
                low, high = int(bounds[i]), int(bounds[i + 1])
                at = np.sort(batch.column(2)[i].values.to_numpy())
                cover = np.zeros(high - low + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                keep = np.flatnonzero(~gone) + low
                counts.append(high - low)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(_joined(data, starts[keep], ends[keep])).hexdigest())
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
            )

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,length:long>>"


def repeated_spans(docs: DataFrame, length: int = 13, gram: int = 5) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, spans``, one row per row of ``docs (doc_id, text, ...)``: the words covered by a
    window of ``length`` words whose sequence also starts in a document with a smaller doc_id, as maximal runs ``spans (start, length)``.

    Seeds are the winnowed anchors: the smallest of each window's ``gram``-word hashes (the rightmost of equals).  Equal windows have equal
    anchors, so only documents that meet at an anchor can share a window.  Around each shared anchor the match is
    extended both ways, to the block of all windows the anchor stands for; each distinct block is taken apart once, and the sequence of each
    window is looked up with the smallest document that has it; covered words merge to maximal repeats.  Windows are joined by value, never document by document, so
    a passage that a third of all documents hold costs a row per holder.

    A null, empty or blank text has no words; texts shorter than ``length`` lose nothing.  A row without doc_id lends and loses nothing.
    Rows that repeat a doc_id are judged alike, against smaller ids only.  An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seed, schema = _seeder(length, gram)
    seeded = stored(docs.where("doc_id is not null").mapInArrow(seed, schema), "seeded")
    slots = seeded.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = slots.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared = stored(shared, "shared")
    met = stored(slots.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "met")
    forget(seeded, shared)
    block, schema = _blocker(length, gram)
    blocks = stored(docs.join(met, "doc_id").mapInArrow(block, schema), "blocks")
    forget(met)
    # Copies of a passage have equal blocks, so only distinct blocks are taken apart into windows.
    same = stored(
        blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("seqs").alias("seqs")), "same"
    )
    places = stored(blocks.drop("seqs"), "places")
    forget(blocks)
    equal = Window.partitionBy("anchor", "seq")
    windows = same.select("anchor", "block", "low", "high", F.posexplode("seqs").alias("k", "seq"))
    known = windows.select("anchor", "block", "k", F.min("low").over(equal).alias("first"), F.max("high").over(equal).alias("last")).where("first < last")
    known = stored(known.groupBy("anchor", "block").agg(F.collect_list(F.struct("k", "first")).alias("known")), "known")
    forget(same)
    earlier = F.transform(F.filter("known", lambda w: w["first"] < F.col("doc_id")), lambda w: F.col("start") + w["k"])
    hits = places.join(known, ["anchor", "block"]).select("doc_id", earlier.alias("starts")).where(F.size("starts") > 0)
    covered = stored(hits.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")), "covered")
    forget(places, known)
    cut, schema = _cutter(length)
    none = F.array().cast("array<int>")
    return docs.join(covered, "doc_id", "left").withColumn("starts", F.coalesce("starts", none)).mapInArrow(cut, schema)
