"""Alignment of two tokenizers over the same bytes: common ends by galloping, overlaps by rank differences, corpus-wide links."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.chunks import Bytes, Pieces, cut, distinct, flat, give_back, slices, spaced
from codelode.llm.common import arrow_rows, stored
from codelode.llm.hashing import text_bytes

#: Bytes of text in a block of documents.
BLOCK_BYTES = 3 << 20
#: Rows that a task takes from Spark at a time; blocks are cut from them by bytes.
ARROW_ROWS = 1000
#: Neighbouring elements that one cursor of the search takes in turn.
LANE = 64
#: Groups with more links than this are counted by distinct ids instead of link by link.
DENSE_LINKS = 1 << 12


def _reach(ends: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """From each cursor the first position whose end is not below ``wanted``: doubling steps, then halving the last one."""
    last = len(ends) - 1
    low, step = at.copy(), np.ones(len(at), np.int64)
    open_ = np.flatnonzero(ends[np.minimum(low, last)] < wanted)
    high = low.copy()
    while len(open_):
        probe = np.minimum(low[open_] + step[open_], last + 1)
        below = np.where(probe > last, False, ends[np.minimum(probe, last)] < wanted[open_])
        high[open_] = probe
        grown = open_[below]
        low[grown] = probe[below]
        step[grown] *= 2
        open_ = grown
    # ends[low] < wanted <= ends[high], or low = high.
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = ends[middle] < wanted[open_]
        low[open_[below]] = middle[below]
        high[open_[~below]] = middle[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two strictly growing lists of ends agree: the indices in ``a`` and in ``b``.

    The shorter list drives.  It is dealt to lanes of ``LANE`` neighbours; each lane's cursor gallops through the longer
    list from where it stands to the next element, all lanes at once.
    """
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(a) > len(b):
        at_b, at_a = common_ends(b, a)
        return at_a, at_b
    heads = np.arange(0, len(a), LANE)
    cursor = np.searchsorted(b, a[heads])
    place = np.empty(len(a), np.int64)
    for k in range(min(LANE, len(a))):
        live = np.flatnonzero(heads + k < len(a))
        mine = heads[live] + k
        cursor[live] = _reach(b, cursor[live], a[mine])
        place[mine] = cursor[live]
    at = np.flatnonzero(b[np.minimum(place, len(b) - 1)] == a)
    return at, place[at]


class _Table:
    """The bytes and the printed number of every id of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        digits = [str(i).encode() for i in range(len(tokens))]
        self.digits = np.array([len(d) for d in digits], np.int64)
        self.wide = int(self.digits.max()) + 1
        self.printed = np.frombuffer(b"".join(d.ljust(self.wide) for d in digits), np.uint8).reshape(len(tokens), self.wide)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.data[np.repeat(self.first[ids], size) + at]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    ahead = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return ahead[bounds[1:]] - ahead[bounds[:-1]]


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given sizes, each element's run and its place in the run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Aligner:
    """Distinct chunks under both tokenizers: groups, printed form and linked id pairs of each chunk."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Bytes(path_a, plain_specials=True), Pieces(path_b)
        self.table_a, self.table_b = _Table(self.a.token_bytes()), _Table(self.b.token_bytes())
        self.separators = self.a.separators & self.b.separators

    def align(self, texts: pa.Array) -> dict:
        data, offsets = text_bytes(texts)
        ids_a, n_a = flat(self.a.encode, self.table_a.size, texts)
        ids_b, n_b = flat(self.b.encode, self.table_b.size, texts)
        fine = self._equal(self.table_a, ids_a, n_a, data, offsets) & self._equal(self.table_b, ids_b, n_b, data, offsets)
        del data
        ids_a, ids_b = ids_a[np.repeat(fine, n_a)], ids_b[np.repeat(fine, n_b)]
        n_a, n_b = np.where(fine, n_a, 0), np.where(fine, n_b, 0)
        ends_a, ends_b = np.cumsum(self.table_a.size[ids_a]), np.cumsum(self.table_b.size[ids_b])
        at_a, at_b = common_ends(ends_a, ends_b)
        # Ranks of the common ends: their differences are the sizes of the groups on both sides.
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        bounds = np.searchsorted(at_a, np.concatenate([[0], np.cumsum(n_a)]) - 1, "right")
        bounds[0] = 0
        printed, cuts = self._print(ids_a, ids_b, at_a, at_b, size_a, size_b)
        ends = cuts[bounds]
        pairs, weights, owner = self._links(ids_a, ids_b, at_a, at_b, size_a, size_b, bounds)
        return {
            "fine": fine, "n_a": n_a, "n_b": n_b, "n_groups": np.diff(bounds), "n_links": _sums(size_a * size_b, bounds),
            "printed": [printed[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())],
            "pairs": pairs, "weights": weights, "owner": owner,
        }

    @staticmethod
    def _equal(table: _Table, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chunks whose token bytes, joined, are the chunk."""
        bounds = np.concatenate([[0], np.cumsum(counts)])
        size = np.diff(offsets)
        fine = _sums(table.size[ids], bounds) == size
        kept = np.repeat(fine, size)
        differs = table.joined(ids[np.repeat(fine, counts)]) != data[kept]
        wrong = np.repeat(np.arange(len(size)), size)[kept][differs]
        fine[wrong] = False
        return fine

    def _print(self, ids_a, ids_b, at_a, at_b, size_a, size_b) -> tuple[bytes, np.ndarray]:
        """All groups as text, each ended by ``;``, and where each group begins in it."""
        group_a, _ = _spread(size_a)
        group_b, _ = _spread(size_b)
        ahead_b = np.concatenate([[0], np.cumsum(size_b)])
        ahead_a = np.cumsum(size_a)
        slot_a = np.arange(len(ids_a)) + ahead_b[group_a]
        slot_b = np.arange(len(ids_b)) + ahead_a[group_b]
        total = len(ids_a) + len(ids_b)
        wide = max(self.table_a.wide, self.table_b.wide)
        form, digits = np.zeros((total, wide), np.uint8), np.empty(total, np.int64)
        form[slot_a, : self.table_a.wide], digits[slot_a] = self.table_a.printed[ids_a], self.table_a.digits[ids_a]
        form[slot_b, : self.table_b.wide], digits[slot_b] = self.table_b.printed[ids_b], self.table_b.digits[ids_b]
        mark = np.full(total, ord(","), np.uint8)
        mark[slot_a[at_a]], mark[slot_b[at_b]] = ord("|"), ord(";")
        form[np.arange(total), digits] = mark
        text = form[np.arange(wide)[None, :] <= digits[:, None]].tobytes()
        ends = np.cumsum(digits + 1)
        return text, np.concatenate([[0], ends[slot_b[at_b]]]) if total else np.zeros(1, np.int64)

    def _links(self, ids_a, ids_b, at_a, at_b, size_a, size_b, bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs per chunk: ``pair`` (a times the number of pieces, plus b), number of links, chunk."""
        first_a, first_b = at_a - size_a + 1, at_b - size_b + 1
        chunk = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        links = size_a * size_b
        pieces = len(self.table_b.size)
        few = np.flatnonzero(links <= DENSE_LINKS)
        run, place = _spread(links[few])
        g = few[run]
        del run
        key = ids_a[first_a[g] + place // size_b[g]].astype(np.int64) * pieces
        key += ids_b[first_b[g] + place % size_b[g]]
        keys, owners, weights = [key], [chunk[g]], [np.ones(len(g), np.int64)]
        del place, g, key
        for g in np.flatnonzero(links > DENSE_LINKS).tolist():
            a, times_a = np.unique(ids_a[first_a[g] : at_a[g] + 1], return_counts=True)
            b, times_b = np.unique(ids_b[first_b[g] : at_b[g] + 1], return_counts=True)
            keys.append((a.astype(np.int64)[:, None] * pieces + b[None, :]).ravel())
            owners.append(np.full(len(a) * len(b), chunk[g]))
            weights.append((times_a[:, None] * times_b[None, :]).ravel())
        key, owner, weight = np.concatenate(keys), np.concatenate(owners), np.concatenate(weights)
        order = np.lexsort((key, owner))
        key, owner, weight = key[order], owner[order], weight[order]
        new = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(owner) != 0))) if len(key) else np.zeros(0, np.int64)
        return key[new], np.add.reduceat(weight, new) if len(new) else weight, owner[new]


@lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str, *changed: int) -> _Aligner:
    """One for all tasks of a worker: what the library sets aside per loaded vocabulary and thread is never returned, so a load per task adds up."""
    # A task has one core.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return _Aligner(path_a, path_b)


_BLOCK = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks array<int>, times array<int>, pairs array<long>, held array<int>, chunk_of array<int>, pair_of array<int>, links_of array<long>"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_TYPES = dict(zip(_NAMES, [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 3 + [pa.list_(pa.int64())]))


def _batch(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, _TYPES[c]) for c in _NAMES], names=_NAMES)


def _row(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def _encoder(path_a: str, path_b: str, block_bytes: int):
    """Blocks of documents: a row per document with its chunks, then one row with the block's chunks, pairs and holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b, *[os.stat(p).st_mtime_ns for p in (path_a, path_b)])
        task = TaskContext.get()
        block = (task.partitionId() if task else 0) << 32
        for batch in slices(batches, 1, block_bytes):
            rows = batch.num_rows
            data, offsets = spaced(*text_bytes(batch.column(1)))
            starts, bounds = cut(data, offsets, aligner.separators)
            index, texts = distinct(data, starts)
            found = aligner.align(texts)
            row = np.repeat(np.arange(rows), np.diff(bounds))
            whole = _sums(~found["fine"][index], bounds) == 0
            index, row = index[whole[row]], row[whole[row]]
            bounds = np.searchsorted(row, np.arange(rows + 1))
            out = {c: pa.array(_sums(found[c][index], bounds)) for c in ("n_a", "n_b", "n_groups", "n_links")}
            printed, digests = found["printed"], []
            order = index.tolist()
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                text = b"".join([printed[i] for i in order[low:high]])
                digests.append(hashlib.sha256(text[:-1]).hexdigest() if high > low else "")
            key, times = np.unique(row.astype(np.int64) * max(1, len(texts)) + index, return_counts=True)
            holder, chunk = key // max(1, len(texts)), key % max(1, len(texts))
            lists = pa.array(np.searchsorted(holder, np.arange(rows + 1)).astype(np.int32))
            yield _batch(
                rows, block=pa.array(np.full(rows, block)), doc_id=batch.column(0), groups_sha256=pa.array(digests, pa.string()), **out,
                chunks=pa.ListArray.from_arrays(lists, pa.array(chunk.astype(np.int32))), times=pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32))),
            )
            pairs, pair_of = np.unique(found["pairs"], return_inverse=True)
            yield _batch(
                1, block=pa.array([block]), pairs=_row(pairs, pa.int64()), held=_row(_held(holder, chunk, found["owner"], pair_of, len(pairs), len(texts)), pa.int32()),
                chunk_of=_row(found["owner"], pa.int32()), pair_of=_row(pair_of, pa.int32()), links_of=_row(found["weights"], pa.int64()),
            )
            block += 1
            del data, starts, index, texts, row, found, printed, order, key, holder, chunk, pair_of, out, lists, times, digests
            give_back()
        # The worker stays for later tasks.
        batch = None
        give_back()

    return run


def _held(holder: np.ndarray, chunk: np.ndarray, owner: np.ndarray, pair_of: np.ndarray, pairs: int, chunks: int) -> np.ndarray:
    """For each pair the number of rows that hold it in any of their chunks; rows are taken a few at a time."""
    first = np.searchsorted(owner, np.arange(chunks + 1))
    size = np.diff(first)[chunk]
    out = np.zeros(pairs, np.int64)
    ahead = np.cumsum(size)
    low = 0
    while low < len(chunk):
        high = int(np.searchsorted(ahead, (ahead[low - 1] if low else 0) + (1 << 18), "right"))
        high = int(np.searchsorted(holder, holder[max(low, high - 1)], "right"))  # whole rows only
        run, place = _spread(size[low:high])
        if len(run):
            each = np.sort(holder[low:high][run] * pairs + pair_of[first[chunk[low:high]][run] + place])
            out += np.bincount(each[np.append(True, np.diff(each) != 0)] % pairs, minlength=pairs)
        low = high
    return out


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks == 1 else pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _weigh(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one block with the sums over their links, from the corpus-wide counts of the block's pairs."""
    whole = left.filter(pa.compute.is_valid(left["pairs"]))
    docs = left.filter(pa.compute.is_valid(left["chunks"]))
    pairs, chunk_of, pair_of, links_of = (_numbers(_column(whole, c)) for c in ("pairs", "chunk_of", "pair_of", "links_of"))
    n, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    place = right["place"].to_numpy()
    n[place], best[place] = right["n"].to_numpy(), right["best"].to_numpy()
    lists = _column(docs, "chunks")
    chunk, times = _numbers(lists), _numbers(_column(docs, "times"))
    bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    chunks = int(max(chunk.max(initial=-1), chunk_of.max(initial=-1))) + 1
    per_chunk = lambda values: _sums(values, np.searchsorted(chunk_of, np.arange(chunks + 1)))
    sums = [pa.array(_sums(times * per_chunk(links_of * v[pair_of])[chunk], bounds)) for v in (best, n)]
    return pa.table(
        [docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_links"], *sums, docs["groups_sha256"]],
        names=[c.split()[0] for c in _RESULT.split(", ")],
    )



def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two results over ``docs (doc_id, text, ...)``.

    Per row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.  A is byte-level (``.json``), B sentence pieces
    (``.model``); both encode a space and the whole text.  Bytes where tokens of both end cut them into groups; each A token of a
    group is linked with each of its B tokens.  Per linked id pair: ``a, b, n, best``, the number of rows that hold it linked and whether no
    other piece has a higher number with the same A id.

    Rows are taken in blocks of ``block_bytes`` of text.  A block's distinct chunks are encoded and aligned once: the shorter list
    of ends gallops through the longer, rank differences between common ends give the groups.  Only a block's distinct pairs are counted over the
    corpus (summed before the shuffle) and looked up again, so a pair in every document costs a row per block.

    Null and empty texts, and texts whose tokens do not spell them (B writes a space for U+2581), have no tokens: zeros and an empty
    digest.  Each row counts as a document, also one that repeats a doc_id or has none.  A very long text is a block of
    its own.  Other columns are ignored, whatever their names.  An empty table gives empty results.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        coded = stored(texts.mapInArrow(_encoder(path_a, path_b, block_bytes), _BLOCK), "coded", compression="zstd")
    pieces = len(Pieces(path_b).pieces)
    uses = coded.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "use"))
    uses = uses.select("block", "place", F.col("use.pairs").alias("pair"), F.col("use.held").alias("held"))
    counts = uses.groupBy("pair").agg(F.sum("held").cast("long").alias("n")).where("n > 0")
    # An A id has at most as many pairs as there are pieces, so its rows stay together.
    counts = counts.withColumn("a", F.expr(f"pair div {pieces}")).withColumn("top", F.expr("max(n) over (partition by a)"))
    counts = stored(counts.select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    known = uses.join(counts, "pair").select(F.col("block").alias("of_block"), "place", "n", F.col("best").cast("long").alias("best"))
    rows = coded.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_weigh, _RESULT)
    return rows, counts.select(F.expr(f"pair div {pieces}").alias("a"), F.expr(f"pair % {pieces}").alias("b"), "n", "best")
