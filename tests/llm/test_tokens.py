"""Token counts, cross-tokenizer alignment and collocations against plain Python on awkward rows."""

import random

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codelode.llm import alignment, chunks, collocation, tokencount

SF = "/root/testdata/sf0.001"
A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
PARTS = [
    "a", "b", " ", "  ", "\n", "\r", ";", "\t", " ", " ", "　", "▁", "é", "à", "漢字", "'s", "<s>", "</s>", "<|endoftext|>", "1", "22",
    ".", "\x1c", "\x85", "😀", "\x00", "ing", " the", " token", "\x0b", "\x0c", "ß", "A", "Ǆ",
]
CLASH = ("block", "pairs", "n_a", "n_tokens", "n_bytes", "chunks", "a", "id", "ids", "part", "turn", "words", "n", "k", "word", "rank", "score", "over_limit")


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def table(spark, rows, schema, parts=4):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


@pytest.mark.parametrize("path", [B, A, W])
def test_token_counts(spark, rows, path):
    long = ["w" * 10_000, "x" * 200_000, "漢字" * 60_000, "aG9k" * 40_000, "one two\n" * 60_000]
    texts = [(i, t) for i, t in enumerate(odd_texts(2000) + long)] + [(None, "no id"), (1, "again"), (3, None), (4, ""), (5, " "), (6, "\n")]
    df = table(spark, texts, "doc_id long, text string")
    got = rows(tokencount.token_counts(df, path, limit=100, batch_bytes=20_000))
    if path == B:
        import sentencepiece

        count = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n := count(t or ""), n > 100) for i, t in texts]
    assert got == sorted(want, key=repr)
    assert tokencount.token_counts(df.limit(0), path).count() == 0


def test_long_stretches_are_cut_where_no_piece_reaches():
    pieces = chunks.Pieces(B)
    text = " " + "漢字" * 60_000
    parts = pieces._parts(text)
    assert "".join(parts) == text and max(map(len, parts)) < 2 * chunks.LONG_CHUNK
    assert pieces.encode([text])[0] == pieces.model.encode(text[1:])


def test_common_ends_gallops_like_a_set():
    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (1, 1), (70, 5000), (5000, 70), (3000, 3000), (1, 9000)):
        a, b = (np.unique(rng.integers(0, 4 * max(n, m, 1), k)) for k in (n, m))
        at_a, at_b = alignment.common_ends(a, b)
        assert a[at_a].tolist() == b[at_b].tolist() == np.intersect1d(a, b).tolist()


def test_alignment(spark, rows):
    texts = [(i, t) for i, t in enumerate(odd_texts(1500, 2))] + [(None, "no id here"), (1, "the token"), (3, None), (4, ""), (5, " "), (6, "a" * 20_000)]
    df = table(spark, texts, "doc_id long, text string")
    got, pairs = alignment.align(df, A, B, block_bytes=9_000)
    want, count = brute.alignment(texts, A, B)
    assert rows(got) == sorted(want, key=repr)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == top[p[0]]) for p, n in count.items()}
    got, pairs = alignment.align(df.limit(0), A, B)
    assert got.count() == 0 and pairs.count() == 0


def test_alignment_of_documents(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = brute.alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], A, B)
    assert rows(alignment.align(docs, A, B, block_bytes=100_000)[0]) == sorted(want, key=repr)


def test_a_worker_loads_its_vocabularies_once(monkeypatch):
    import pyarrow as pa

    loads, load = [], alignment.Bytes
    monkeypatch.setattr(alignment, "Bytes", lambda *a, **b: loads.append(a) or load(*a, **b))
    run = alignment._encoder(A, B, 1000)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["one two", "two three"]})
    first, *others = ([b.to_pydict() for b in run(iter([batch]))] for _ in range(3))
    assert len(first) == 2 and all(x == first for x in others)
    assert len(loads) == 1


def test_wide_groups_count_links_without_listing_them(spark, rows, monkeypatch):
    texts = [(1, "漢字 the token"), (2, "token the 漢字 token"), (3, "zz漢字漢字 字")]
    want, _ = brute.alignment(texts, A, B)
    monkeypatch.setattr(alignment, "DENSE_LINKS", 1)
    aligner = alignment._Aligner(A, B)
    import pyarrow as pa

    found = aligner.align(pa.array([" " + t for _, t in texts], pa.large_string()))
    assert found["n_links"].tolist() == [w[4] for w in want] == np.bincount(found["owner"], found["weights"]).astype(int).tolist()


def collocation_rows():
    rnd = random.Random(5)
    words = "New york city of THE big apple is not a fruit été zürich x1 y2".split()
    rows = []
    for i in range(400):
        w = [rnd.choice(words) for _ in range(rnd.randint(0, 25))]
        if i % 3 == 0:
            w += "new York city hall".split()
        if i % 5 == 0:
            w += "to be or not to be or not to be".split()
        rows.append((" ".join(w).replace("is", "is" + rnd.choice([",", "\n", ".", "", "\t"])), rnd.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), ("so so so so " * 200, "fr"), ("\n.,;", "fr"), ("aa bb\vaa bb\faa bb\r" * 40, "it"), ("und one " * 40, "und")]


@pytest.mark.parametrize("least,top,block,parts", [(30, 2000, 1 << 20, 3), (5, 40, 500, 6), (10**6, 10, 1000, 2)])
def test_collocations(spark, rows, least, top, block, parts):
    plain = collocation_rows()
    df = table(spark, plain, "text string, lang string", parts)
    got = rows(collocation.collocations(df, least, 4, top, block_bytes=block))
    assert got == sorted(brute.collocations(plain, least, 4, top), key=repr)


def test_collocations_in_dense_and_sparse_tiles(monkeypatch):
    import pyarrow as pa

    cells = [[0, 5, 5 * 1024 + 3], [5, 1024 * 1024 - 1]]
    tile = pa.table({"lang": ["en", "en"], "part": [0, 1], "turn": [3, 3], "high": pa.array([1, 1], pa.int32()), "low": pa.array([2, 2], pa.int32()),
                     "cells": pa.array(cells, pa.list_(pa.int32())), "times": pa.array([[1, 2, 3], [4, 5]], pa.list_(pa.int64()))})
    sparse = collocation._added(tile).to_pydict()
    monkeypatch.setattr(collocation, "SPARSE", 1 << 20)
    assert collocation._added(tile).to_pydict() == sparse
    assert (sparse["high"], sparse["low"]) == ([1], [2]) and sparse["cells"] == [[0, 5, 5123, 1048575]] and sparse["times"] == [[1, 6, 3, 5]] and sparse["part"] == [0]


def test_collocation_blocks_have_few_rows_however_many_tiles(spark):
    import numpy as np

    words = np.random.default_rng(3).integers(0, 1 << 18, 20_000).tolist()
    block = spark.createDataFrame([("en", 0, 0, words, None)], collocation._SEQUENCES)
    cells = block.mapInArrow(collocation._tiler(1), collocation._COUNTED).collect()
    assert len({(r.of_high, r.of_low, r.slot) for r in cells}) == len(cells) <= 100
    pairs = sorted(zip(words, words[1:]))
    got = []
    for r in cells:
        at = 0
        for high, low, size in zip(r.high, r.low, r.sizes):
            got += [(high * 1024 + c // 1024, low * 1024 + c % 1024) for c, n in zip(r.cells[at : at + size], r.times[at : at + size]) for _ in range(n)]
            at += size
    assert sorted(got) == pairs
    few, _ = collocation._frequent(block.mapInArrow(collocation._tiler(1), collocation._COUNTED), 2)
    twice = {p for p, q in zip(pairs, pairs[1:]) if p == q}
    assert {(r.high, r.low) for r in few.collect()} == twice


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string, lang2 string")
    assert collocation.collocations(df).count() == 0


def test_hashes_of_very_long_words_have_no_period():
    import pyarrow as pa

    from codelode.llm.hashing import text_bytes, word_hashes

    a, b = "a" * 4096, "b" * 4096
    words = [a + b, b + a, a + a, b + b, a + b + a, b + a + a, a + a + b, "ab" * 4096]
    hashes, _ = word_hashes(*text_bytes(pa.array(words)))
    assert len(set(hashes.tolist())) == len(words)
    again, bounds = word_hashes(*text_bytes(pa.array(["x " + w + " y" for w in words])))
    assert again[bounds[:-1] + 1].tolist() == hashes.tolist()
