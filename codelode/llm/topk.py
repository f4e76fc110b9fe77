"""Exact top-k by inner product with the three-phase uniform threshold method."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import forget, stored

#: Vectors in a strip at least and at most, strips before they grow, queries in a block at most, and scores in memory at once.
STRIP, LONGEST, STRIPS, BLOCK, SCORES = 2048, 1 << 18, 48, 1 << 16, 1 << 22
#: Scaled components beyond this could carry a score out of a long.
LARGEST = 1 << 26


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; missing trailing components are 0."""
    column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _exact_type(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The quickest number type in which no sum of products is rounded: none exceeds the product of the lengths."""
    longest = [np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0) for m in (queries, vectors)]
    bound = longest[0] * longest[1] * 1.001
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def _best_of(parts: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and scores that can be among the ``k`` best of their row, by the partial scores of the lists.

    ``own`` is the column of the row's own vector, or -1.
    """
    count, n = len(parts), parts[0].shape[1]
    rows = np.arange(len(own))
    mine = np.flatnonzero(own >= 0)
    none = np.iinfo(np.int64).min
    lows = []
    for p in parts:
        least, most = (np.iinfo(p.dtype).min, np.iinfo(p.dtype).max) if p.dtype == np.int64 else (-np.inf, np.inf)
        p[mine, own[mine]] = most
        lows.append(p.min(axis=1))
        p[mine, own[mine]] = least
    fine = (own < 0) | (n > 1)
    low = np.array([np.where(fine, x, 0) for x in lows]).astype(np.int64)
    # (1) Each list names its best; the k-th of their scores is reached by k vectors.
    top = min(k + 1, n)
    named = np.sort(np.hstack([np.argpartition(p, n - top, axis=1)[:, n - top :] for p in parts]), axis=1)
    stale = (named == own[:, None]) | np.hstack([np.zeros((len(own), 1), bool), named[:, 1:] == named[:, :-1]])
    score = sum(np.where(stale, 0, p[rows[:, None], named]).astype(np.int64) for p in parts)
    score = np.sort(np.where(stale, none, score), axis=1)
    least = score[:, -k] if score.shape[1] >= k else np.full(len(own), none)
    above = np.where(least == none, 0, least - low.sum(axis=0))
    # (2) Whoever reaches it has an even share of it in some list.
    share = -(-above // count)
    cut = low + share
    found = parts[0] >= cut[0].astype(parts[0].dtype)[:, None]
    for p, c in zip(parts[1:], cut[1:]):
        found |= p >= c.astype(p.dtype)[:, None]
    found[mine, own[mine]] = False
    q, v = np.nonzero(found)
    each = [p[q, v].astype(np.int64) for p in parts]
    # (3) What is known and the most that is not must still reach it; those that do are scored in full.
    seen = [e >= c[q] for e, c in zip(each, cut)]
    bound = sum(np.where(s, e - x[q], np.maximum(share[q] - 1, 0)) for s, e, x in zip(seen, each, low))
    left = bound >= above[q]
    total = sum(e[left] for e in each)
    q, v = q[left], v[left]
    whole = total >= least[q]
    return q[whole], v[whole], total[whole]


def _meet(k: int, lists: int):
    """The ``k`` best vectors of a strip for each query of a block."""

    def run(strip: pa.Table, block: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
        if strip.num_rows and block.num_rows:
            sizes = [t["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=1) for t in (strip, block)]
            width = -(-int(max(sizes)) // lists)
            ids, qids = strip["vec_id"].to_numpy(), block["vec_id"].to_numpy()
            vectors, queries = _matrix(strip["v"], lists * width), _matrix(block["v"], lists * width)
            kind = _exact_type(queries, vectors)
            vectors, queries = vectors.astype(kind), queries.astype(kind)
            order = np.argsort(ids)
            at = order[np.minimum(np.searchsorted(ids, qids, sorter=order), len(ids) - 1)]
            own = np.where(ids[at] == qids, at, -1)
            step = max(1, SCORES // len(ids))
            for i in range(0, len(qids), step):
                some = slice(i, i + step)
                parts = [queries[some, j * width : (j + 1) * width] @ vectors[:, j * width : (j + 1) * width].T for j in range(lists)]
                q, v, score = _best_of(parts, own[some], k)
                by = np.lexsort((ids[v], -score, q))
                q, v, score = q[by], v[by], score[by]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                for column, found in zip(out, (qids[some][q[keep]], ids[v[keep]], score[keep])):
                    column.append(found)
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in out], names=names)

    return run


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)``, for vectors that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.floor(e * F.lit(float(scale))))
    # Not-a-number compares above every number, and null makes the test null.
    whole = F.forall("embedding", lambda e: F.coalesce(F.abs(e.cast("double")) * scale < F.lit(float(LARGEST)), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")
    )


def _every(name: str, count: int) -> Column:
    """``name``: a row for each number below ``count``."""
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)


def top_k(vectors: DataFrame, query_ids: DataFrame, k: int = 10, scale: int = 1024, lists: int = 2) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``vectors (vec_id, embedding, ...)`` for each of
    ``query_ids (vec_id)``, by integer inner product, ties to the smaller vec_id; all, if there are fewer.

    Vectors lie in strips and queries in blocks, and each strip meets each block once; memory is bounded by their sizes.  In a strip the
    dimensions are dealt into ``lists``; a list knows only its part of a score.  (1) Each list names its k best per query; the
    k-th of their scores is one that k vectors reach.  (2) A vector that reaches it must have an even share of it in some list, so
    only those are taken up.  (3) Vectors whose upper bound still reaches the k-th lower bound are scored exactly.  Parts are
    counted from the list's lowest, so that a missing part is never negative.  At most k vectors per query leave a strip.

    Scores are all computed, in the strips: time grows with queries times vectors.  Rows sent and stored do not: up to ``STRIPS`` *
    ``LONGEST`` vectors there are at most ``STRIPS`` strips, beyond that one per ``LONGEST``.

    A vector that is null, holds null or a non-finite component, has a null vec_id, or a scaled component of 2**26 or more takes
    no part; missing trailing components count as 0.  Rows that repeat a vec_id are one vector, the smallest.  A query never finds its own vec_id.  An empty table gives an empty result.
    """
    whole = scaled(vectors, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    every = stored(whole.select("vec_id", F.col("v").cast("array<int>").alias("v")), "vectors")
    wanted = query_ids.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    queries = stored(every.join(wanted, "vec_id", "left_semi"), "queries")
    n = every.count()
    strips = max(1, min(STRIPS, -(-n // STRIP)), -(-n // LONGEST))
    blocks = max(1, -(-queries.count() // BLOCK))
    home = lambda salt, count: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    keys = ["strip", "block"]
    dealt = lambda df, strip, block: df.select("vec_id", "v", strip.alias("strip"), block.alias("block")).repartition(2 * strips * blocks, *keys)
    left = dealt(every, home(1, strips), _every("block", blocks))
    right = dealt(queries, _every("strip", strips), home(2, blocks))
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(k, lists), "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = stored(met.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    forget(every, queries)
    return out
