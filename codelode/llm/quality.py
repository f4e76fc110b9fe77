"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import stored
from codelode.llm.hashing import NOT_LETTERS, lists, text_bytes, word_hashes

#: Labelled documents that the classifier is fitted on at most, words it looks at per question, and shape features per document.
SAMPLE, WORDS, SHAPE = 8000, 400, 8
HEADS = ("quality", "toxic")


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per document: its shape, and the hashes of its distinct words (runs of letters in lower case)."""
    data, offsets = text_bytes(column)
    plain, bounds = word_hashes(data, offsets)
    letters, letter_bounds = word_hashes(data, offsets, True, NOT_LETTERS)
    for i in range(len(column)):
        raw = data[offsets[i] : offsets[i + 1]]
        own = plain[bounds[i] : bounds[i + 1]]
        found = np.unique(letters[letter_bounds[i] : letter_bounds[i + 1]])
        n, size = max(1, len(own)), max(1, len(raw))
        _, counts = np.unique(own, return_counts=True)
        symbols = np.count_nonzero(NOT_LETTERS[raw] & (raw > 32) & ~((raw >= 48) & (raw < 58)) & (raw != 46) & (raw != 44))
        in_row = np.count_nonzero(own[1:] == own[:-1])
        yield np.array(
            [np.log1p(len(own)), len(counts) / n, counts.max(initial=0) / n, symbols / size, min(1.0, symbols / n),
             np.count_nonzero((raw >= 48) & (raw < 58)) / size, in_row / n, np.log(size / n)]
        ), found


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(_features(batch.column(0)))
        words = [f for _, f in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s.tolist() for s, _ in rows], pa.list_(pa.float64())),
             lists(np.concatenate(words) if words else np.zeros(0, np.uint64), [len(w) for w in words]),
             batch.column(1), batch.column(2)],
            names=["shape", "words", *HEADS],
        )


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.2) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _solved(shape: np.ndarray, sizes: np.ndarray, flat: np.ndarray, labels: list[np.ndarray], most: int) -> list[tuple]:
    """``mean, scale, vocabulary, weights`` per question: words chosen by how their presence separates the labels, then a ridge fit."""
    mean, scale = shape.mean(axis=0), shape.std(axis=0) + 1e-6
    shape = (shape - mean) / scale
    doc = np.repeat(np.arange(len(sizes)), sizes)
    vocabulary, at = np.unique(flat, return_inverse=True)
    out = []
    for y in labels:
        ones = np.bincount(at, weights=y[doc], minlength=len(vocabulary))
        every = np.bincount(at, minlength=len(vocabulary))
        share = (y.sum() + 1) / (len(y) + 2)
        gain = (ones - every * share) ** 2 / (every * share * (1 - share) + 1e-9)
        gain[every < 5] = 0
        best = np.sort(np.argsort(-gain, kind="stable")[: min(most, int((gain > 0).sum()))])
        column = np.full(len(vocabulary), -1)
        column[best] = np.arange(len(best))
        x = np.zeros((len(sizes), len(best)))
        has = column[at] >= 0
        x[doc[has], column[at[has]]] = 1
        out.append((mean, scale, vocabulary[best], _logistic(np.hstack([shape, x]), y)))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> dict:
    """A logistic model per question, fitted on at most ``sample`` labelled documents, those with the smallest hashed ids.

    Words are chosen by how their presence separates the labels.  One task fits the bounded sample; the driver sees the model only.
    Without labels the model has no evidence and says 0.
    """
    heads = [F.max(F.col(h).cast("int")).alias(h) for h in HEADS]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*heads).na.drop()
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    told = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(chosen, "_id").select("text", *HEADS)
    shapes = told.mapInArrow(_shapes, "shape array<double>, words array<long>, quality int, toxic int").limit(2 * sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        column = lambda c: pa.concat_arrays(rows[c].chunks)
        flat = column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        shape = column("shape").flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPE)
        found = _solved(shape, sizes, flat, [column(h).to_numpy(zero_copy_only=False).astype(np.float64) for h in HEADS], words)
        of = lambda i, kind: pa.array([np.asarray(f[i]).view(np.int64 if i == 2 else np.float64).tolist() for f in found], pa.list_(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array(HEADS), of(0, pa.float64()), of(1, pa.float64()), of(2, pa.int64()), of(3, pa.float64())],
            names=["head", "mean", "scale", "vocabulary", "weights"],
        )

    # After a limit there is one partition, hence one task and at most one model.
    schema = "head string, mean array<double>, scale array<double>, vocabulary array<long>, weights array<double>"
    model: dict = {"mean": np.zeros(SHAPE), "scale": np.ones(SHAPE), "heads": {h: (np.zeros(0, np.uint64), np.zeros(SHAPE + 1)) for h in HEADS}}
    for r in shapes.mapInArrow(run, schema).collect():
        model["mean"], model["scale"] = np.array(r["mean"]), np.array(r["scale"])
        model["heads"][r["head"]] = (np.array(r["vocabulary"], np.int64).view(np.uint64), np.array(r["weights"]))
    return model


def evidence(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """``quality_logit, toxic_logit`` of each document's own text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.select(*carry).schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {h: [] for h in HEADS}
            for shape, found in _features(batch.column(0)):
                shape = (shape - model["mean"]) / model["scale"]
                for h in HEADS:
                    vocabulary, w = model["heads"][h]
                    score = shape @ w[:SHAPE] + w[-1]
                    if len(vocabulary):
                        place = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
                        score += w[SHAPE:-1][place[vocabulary[place] == found]].sum()
                    out[h].append(float(np.clip(score, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(out[h], pa.float64()) for h in HEADS]],
                names=[*carry, *[f"{h}_logit" for h in HEADS]],
            )

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return docs.select("text", *carry).mapInArrow(run, f"{schema}, quality_logit double, toxic_logit double")


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, total: str) -> float:
    """Prior sample size by the method of moments: how alike the means of ``groups`` are beyond chance."""
    rows = groups.where(F.col(n) >= 2).agg(
        F.count("*"), F.sum(n), F.sum(total), F.sum(F.col(total) * F.col(total) / F.col(n)), F.sum(F.col(n) * F.col(n))
    ).first()
    k, every, ones, squares, sizes = (float(x or 0) for x in rows)
    if k < 2 or every <= k:
        return 100.0
    mean = ones / every
    within = mean * (1 - mean) + 1e-9
    spread = max(0.0, (squares - every * mean * mean) - (k - 1) * within)
    between = spread / max(1e-9, every - sizes / every)
    return float(min(1e6, max(5.0, within / max(between, 1e-9) - 1)))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, host, path``, the document's own ``*_logit``, the posteriors ``p_quality`` and ``p_toxic``, and ``kept``,
    one row per row of ``docs (doc_id, text, ...)``; ``host`` and ``path`` default to the columns source and lang.

    A model fitted on a bounded sample gives each document's own evidence.  Paths and hosts then hold counts and sums of
    evidence, from all documents.  A host's rate is drawn to the corpus's, a path's to its host's, by as many pseudo-documents as
    the spread of rates suggests, so sparse sites fall back on what is above them; a document's own evidence is taken out of its
    site's.  Its posterior shifts its log-odds by how its path's rate differs from the corpus's.  Kept: quality at least even, toxic at most.

    Groups are summed before they are shuffled, so a host with a third of all documents costs one row a task.  Null hosts and
    paths are sites of their own; null and empty texts are judged by their (empty) shape; repeated rows count each; without
    labels nothing is rejected; an empty table gives an empty result.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit(docs, labels, sample)
    rows = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    own = stored(evidence(rows, model, ["doc_id", "host", "path"]), "evidence")
    p = {h: 1 / (1 + F.exp(-F.col(f"{h}_logit"))) for h in HEADS}
    paths = stored(own.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(p[h]).alias(h) for h in HEADS]), "paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(h).alias(f"h_{h}") for h in HEADS]), "hosts")
    count, *sums = hosts.agg(F.sum("hn"), *[F.sum(f"h_{h}") for h in HEADS]).first()
    sites = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    # Stored, so that a few sites are known to be few: by the estimate of their join the documents' evidence would be broadcast instead.
    sites = stored(sites.withColumnsRenamed({"host": "_host", "path": "_path"}), "sites")
    met = own.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    out = {}
    for h, total in zip(HEADS, sums):
        base = float(total or 0) / max(1, count or 0)
        k_host, k_path = _strength(hosts, "hn", f"h_{h}"), _strength(paths, "n", h)
        at_host = (F.col(f"h_{h}") - p[h] + k_host * base) / (F.col("hn") - 1 + k_host)
        at_path = (F.col(h) - p[h] + k_path * at_host) / (F.col("n") - 1 + k_path)
        out[h] = F.col(f"{h}_logit") + _logit(at_path) - _logit(F.lit(base))
    return met.select(
        "doc_id", "host", "path", "quality_logit", "toxic_logit", *[(1 / (1 + F.exp(-out[h]))).alias(f"p_{h}") for h in HEADS],
        ((out["quality"] >= F.lit(-1e-6)) & (out["toxic"] <= F.lit(1e-6))).alias("kept"),
    )
