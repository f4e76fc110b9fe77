"""Byte-level analytics over binary columns.

Histograms of bytes are numpy work on the Arrow batch a task already holds: one row in, a few numbers
out.  Turning each byte into a row would shuffle the corpus a byte at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelode.session import small_batches


def _bits(hist: np.ndarray) -> np.ndarray:
    """Shannon entropy of each histogram row."""
    hist = hist.astype("float64")
    total = hist.sum(axis=1, keepdims=True)
    p = np.divide(hist, total, out=np.zeros_like(hist), where=total > 0)
    logs = np.log2(p, out=np.zeros_like(p), where=p > 0)
    return -(p * logs).sum(axis=1) + 0.0


def _histogram(content: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(content, dtype=np.uint8), minlength=256)


@F.pandas_udf(T.DoubleType())
def _entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for contents in batches:
        hist = [_histogram(c or b"") for c in contents]
        yield pd.Series(_bits(np.vstack(hist)) if hist else [], dtype="float64")


def entropy(content: Column | str) -> Column:
    """Bits per byte of the whole content; 0 when empty."""
    small_batches(SparkSession.active())
    return _entropy(content)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _windowed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for contents, widths in batches:
        out = []
        for content, width in zip(contents, widths):
            data = np.frombuffer(content or b"", dtype=np.uint8)
            if not len(data) or width <= 0:
                out.append([])
                continue
            count = -(-len(data) // width)
            cells = np.arange(len(data)) // width * 256 + data
            out.append(_bits(np.bincount(cells, minlength=count * 256).reshape(count, 256)).tolist())
        yield pd.Series(out)


def suggested_window(size: Column) -> Column:
    """About 200 windows per file, each between 64 and 65 536 bytes."""
    return F.greatest(F.lit(64), F.least(F.lit(65536), F.floor(size / 200))).cast("int")


def windowed_entropy(files: DataFrame, window: Column | int | None = None) -> DataFrame:
    """``(keys..., window_no, entropy)`` for fixed-size windows; the last one may be short."""
    small_batches(files.sparkSession)
    width = suggested_window(F.length("content")) if window is None else (
        F.lit(window) if isinstance(window, int) else window
    )
    keys = [c for c in files.columns if c != "content"]
    return files.select(*keys, _windowed("content", width.cast("int")).alias("w")).select(
        *keys, F.posexplode("w").alias("window_no", "entropy")
    )


def parse_needle(text: str, mode: str = "Auto") -> bytes | None:
    """Bytes to look for: hex, ASCII, UTF-16 (little endian), or Auto (hex when it reads as hex)."""
    if not text:
        return None
    if mode == "ASCII":
        return text.encode("ascii", "replace")
    if mode == "UTF-16":
        return text.encode("utf-16-le")
    digits = "".join(text.split()).replace(",", "").replace("0x", "").replace("0X", "")
    try:
        as_hex = bytes.fromhex(digits) if digits and len(digits) % 2 == 0 else None
    except ValueError:
        as_hex = None
    if mode == "Hex" or as_hex is not None:
        return as_hex
    return text.encode("ascii", "replace")


def find_bytes(files: DataFrame, needle: bytes | None) -> DataFrame:
    """Every offset of the needle in each file, overlapping matches included."""
    keys = [c for c in files.columns if c != "content"]
    if not needle:
        return files.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)

    small_batches(files.sparkSession)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def offsets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in batches:
            found = []
            for content in contents:
                at, hits = -1, []
                while (at := (content or b"").find(needle, at + 1)) >= 0:
                    hits.append(at)
                found.append(hits)
            yield pd.Series(found)

    # The JVM drops files without the needle before anything is sent to Python.
    candidates = files.filter(F.contains(F.col("content"), F.lit(needle)))
    return candidates.select(*keys, F.explode(offsets("content")).alias("start")).withColumn(
        "end", F.col("start") + len(needle)
    )


SIDES = np.array(["CHANGED", "SAME", "ONLY_LEFT", "ONLY_RIGHT"], dtype=object)


def _runs(left: bytes, right: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, lengths and sides (as numbers) of the runs of one pair."""
    a, b = np.frombuffer(left or b"", dtype=np.uint8), np.frombuffer(right or b"", dtype=np.uint8)
    common = min(len(a), len(b))
    same = a[:common] == b[:common]
    starts = np.flatnonzero(np.r_[common > 0, same[1:] != same[:-1]]) if common else np.empty(0, dtype=np.int64)
    sides = same[starts].astype(np.int64)
    ends = np.r_[starts[1:], common][: len(starts)]
    if len(a) != len(b):
        starts, sides = np.r_[starts, common], np.r_[sides, 2 if len(a) > len(b) else 3]
        ends = np.r_[ends, max(len(a), len(b))]
    return starts, ends - starts, sides


def byte_diff(pairs: DataFrame) -> DataFrame:
    """Run-length encoded positional diff of ``left`` and ``right``."""
    small_batches(pairs.sparkSession)
    keys = [f for f in pairs.schema.fields if f.name not in ("left", "right")]
    region = [("offset", T.IntegerType()), ("length", T.IntegerType()), ("side", T.StringType())]
    schema = T.StructType(keys + [T.StructField(n, t) for n, t in region])
    names = [f.name for f in keys]

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # A few pairs at a time: one pair can have as many runs as bytes.
            for at in range(0, len(batch), 64):
                part = batch.iloc[at : at + 64]
                runs = [_runs(a, b) for a, b in zip(part["left"], part["right"])]
                rows = part[names].iloc[np.repeat(np.arange(len(part)), [len(r[0]) for r in runs])].reset_index(drop=True)
                offsets, lengths, sides = (np.concatenate([r[i] for r in runs]) for i in range(3))
                yield rows.assign(offset=offsets, length=lengths, side=SIDES[sides.astype(np.int64)])

    return pairs.select(*names, "left", "right").mapInPandas(diff, schema)


def bytes_per_side(regions: DataFrame, keys: list[str]) -> DataFrame:
    return regions.groupBy(*keys, "side").agg(F.sum("length").alias("bytes"))
