"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.chunks import counter, cut, distinct, slices, spaced
from codelode.llm.hashing import text_bytes

#: Bytes of text that are encoded at a time.
BATCH_BYTES = 8 << 20
#: Chunks whose counts a task remembers between its batches.
REMEMBERED = 1 << 19


def _counter(path: str, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, separators, space = counter(path)
        known: dict[str, int] = {}
        for batch in slices(batches, 1, batch_bytes):
            data, offsets = text_bytes(batch.column(1))
            size = np.diff(offsets)
            if space:
                data, offsets = spaced(data, offsets)
            starts, bounds = cut(data, offsets, separators)
            index, texts = distinct(data, starts)
            texts = texts.to_pylist()
            new = [t for t in texts if t not in known]
            if len(known) + len(new) > REMEMBERED:
                known = {}
                new = texts
            found = dict(zip(new, count(new)))
            if len(new) <= REMEMBERED:
                known.update((t, n) for t, n in found.items() if len(t) < 256)
            lengths = np.array([found[t] if t in found else known[t] for t in texts], np.int64)
            ahead = np.concatenate([[0], np.cumsum(lengths[index])]) if len(index) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), pa.array(ahead[bounds[1:]] - ahead[bounds[:-1]], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run, "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, path: str, limit: int = 4096, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row per row of ``docs (doc_id, text, ...)``: the tokens of the whole text as the
    library of the file at ``path`` counts them (``.json``: tokenizers, ``.model``: sentencepiece), without begin, end or other added tokens.

    The file is read by each task, so ``path`` must name it on every machine.  Texts go to the library ``batch_bytes`` at a time, so a
    batch of long texts needs no more memory than one of short texts.  Before they go, they are cut where tokens cannot
    reach across (before white space after a word; in longer stretches between characters that no piece holds together), equal chunks
    are encoded once, and the counts of a text's chunks add up to the count of the text.  Nothing is shuffled.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows that repeat a doc_id and rows without one are counted like any other.  Very long
    texts are cut as above; a stretch without any place to cut is encoded whole.  Other columns are ignored, whatever their
    names.  An empty table gives an empty result.
    """
    run, schema = _counter(path, batch_bytes)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
