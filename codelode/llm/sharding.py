"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import running_sum, stored

#: Groups per cell at the bottom, and partial partitions per cell above: what one differencing run holds.
CELL, FAN_IN = 8192, 2048


def difference(parts: np.ndarray) -> np.ndarray:
    """Combine ``parts`` (rows: partial partitions, columns: their sums) into one partition.

    The two rows of largest spread are combined, the largest sums of one with the smallest of the other, until one row
    is left.  Returns, for each row and column, the column of the result that it went to.
    """
    count, shards = parts.shape
    home = np.tile(np.arange(shards), (count, 1))
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = np.take_along_axis(parts, order, axis=1)
    home = np.empty_like(home)
    np.put_along_axis(home, order, np.tile(np.arange(shards), (count, 1)), axis=1)
    heap = [(-(int(s[0]) - int(s[-1])), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    live: dict[int, np.ndarray] = {i: sums[i] for i in range(count)}
    left: dict[int, tuple] = {}
    new = count
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = live.pop(a) + live.pop(b)[::-1]
        turn = np.argsort(-both, kind="stable")
        rank = np.empty_like(turn)
        rank[turn] = np.arange(shards)
        live[new] = both[turn]
        # A slot of a goes where its sum ranks; a slot of b was turned round first.
        left[new] = (a, b, rank)
        heapq.heappush(heap, (-(int(live[new][0]) - int(live[new][-1])), new))
        new += 1
    where = {new - 1: np.arange(shards)} if count else {}
    for node in range(new - 1, count - 1, -1):
        a, b, rank = left[node]
        to = where.pop(node)
        where[a] = to[rank]
        where[b] = to[rank[::-1]]
    return np.stack([where[i][home[i]] for i in range(count)]) if count else np.zeros((0, shards), np.int64)


def _level(shards: int):
    """Difference each cell's partial partitions; one row per cell with the combined sums and each member's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = [m["name"] for m in row["members"]]
                parts = np.array([m["sums"] for m in row["members"]], np.int64).reshape(len(names), -1)
                if parts.shape[1] < shards:
                    parts = np.pad(parts, ((0, 0), (0, shards - parts.shape[1])))
                to = difference(parts)
                sums = np.zeros(shards, np.int64)
                np.add.at(sums, to.ravel(), parts.ravel())
                yield pa.RecordBatch.from_pylist(
                    [{"cell": row["cell"], "sums": sums.tolist(), "homes": [{"name": n, "to": t.tolist()} for n, t in zip(names, to)]}],
                    schema=pa.schema([("cell", pa.int64()), ("sums", pa.list_(pa.int64())),
                                      ("homes", pa.list_(pa.struct([("name", pa.int64()), ("to", pa.list_(pa.int64()))])))]),
                )

    return run, "cell long, sums array<long>, homes array<struct<name:long,to:array<long>>>"


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """``name, shard`` for ``groups (name long, bytes long)``: indivisible groups, near equal sums of bytes.

    Groups are dealt into cells of bounded size by a hash of their name; each cell is differenced in one task into a
    partial partition of ``shards`` sums, and these are differenced in turn, level by level, until one is left.
    Differencing lets sums of any cells be opposed, so the levels keep its balance.  The columns are then followed down again.
    """
    run, schema = _level(shards)
    count = groups.count()
    cells = max(1, -(-count // CELL))
    # The largest first, so that no cell's order depends on how its rows arrived.
    rows = groups.select("name", F.array(F.col("bytes")).alias("sums"))
    levels = []
    while True:
        members = F.sort_array(F.collect_list(F.struct("name", "sums")))
        told = rows.withColumn("cell", F.pmod(F.xxhash64("name"), F.lit(cells).cast("long")))
        done = stored(told.groupBy("cell").agg(members.alias("members")).mapInArrow(run, schema), "cells")
        levels.append(done)
        if cells == 1:
            break
        rows = done.select(F.col("cell").alias("name"), "sums")
        cells = max(1, -(-cells // FAN_IN))
    # From the top: which shard each column of a cell went to.
    top = levels.pop()
    homes = top.select(F.explode("homes").alias("h")).select(F.col("h.name").alias("name"), F.col("h.to").alias("to"))
    while levels:
        below = levels.pop().select("cell", F.explode("homes").alias("h")).select("cell", F.col("h.name").alias("low"), F.col("h.to").alias("at"))
        above = homes.select(F.col("name").alias("cell"), "to")
        homes = below.join(above, "cell").select(
            F.col("low").alias("name"), F.transform("at", lambda i: F.get("to", i.cast("int"))).alias("to")
        )
    return homes.select("name", F.get("to", F.lit(0)).cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = 24, overhead: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs (doc_id, text, ...)``.

    The law is ``bytes``: rows of equal text form an indivisible group, and shards are near equal in bytes of UTF-8 text plus
    ``overhead`` a row, as far as the largest group allows.  ``slot`` numbers a shard's rows from 0 without gaps, in
    the order of a hash of their group, so that equal texts stand together.  ``grown_shard`` is null: this law promises nothing
    about another number of shards.

    A null text has no bytes and no checksum and forms a group with its like; an empty text is a group of its own.  Rows
    that repeat a document are rows of one group.  Groups are counted before they are shuffled, and no group's rows are
    gathered.  An empty table gives an empty result.
    """
    text = F.col("text").cast("binary")
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
                    F.crc32(text).alias("text_crc32"), F.coalesce(F.md5(text), F.lit("null")).alias("_digest")),
        "rows",
    )
    # 60 bits of the digest name a group: a clash would only keep two texts together.
    name = F.conv(F.substring(F.md5(F.col("_digest").cast("binary")), 1, 15), 16, 10).cast("long")
    rows = rows.withColumn("_name", name)
    groups = rows.groupBy(F.col("_name").alias("name")).agg(F.sum("size").alias("bytes"))
    homes = stored(assign(stored(groups, "groups"), shards), "homes")
    dealt = rows.join(homes.withColumnRenamed("name", "_name"), "_name")
    slots = running_sum(dealt, ["shard"], ["_name", "doc_id"], F.lit(1), "slot")
    out = slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
    return out
