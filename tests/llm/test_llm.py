"""The training-data operators on small inputs: brute force, awkward rows, empty tables."""

import hashlib
import os
import itertools
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.session import shared_folder
from codelode.llm import decontaminate, linededup, minhash, mixing, pii, quality, sharding, substring, suffixarray, topk

SF = "/root/testdata/sf0.001"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, " ".join(BASE), "a", "en"), (2, " ".join(BASE), "a", "en"), (2, " ".join(BASE), "a", "en"),
    (3, " ".join(BASE[:-1] + ["zz"]), "b", None), (4, None, None, "en"), (5, "", "b", "en"), (6, " \n\t ", "", "de"),
    (7, "one two", "c", "en"), (8, "One\x0btwo", "c", "en"), (9, LONG + " tail", "a", "fr"), (10, "head " + LONG, "b", "fr"),
    (None, " ".join(BASE), "a", "en"), (11, "line one of two words\nline one of two words\nother", "a", "en"),
]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = [F.lit(1).alias(c) for c in ("node", "component", "key", "size", "n", "shard", "words", "pos", "kept", "target")]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(BASE[2:18])), (2, None), (None, LONG), (3, "too short"), (4, " ".join(BASE[2:18]))], "item_id long, text string")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_near_duplicates(spark, docs):
    got = {(r[0], r[1]): (r[2], r[3]) for r in minhash.near_duplicates(docs, 4).collect()}
    want = brute.near_duplicates([r[:2] for r in ROWS if r[0] is not None], 4, 80)
    assert got == {(i, n): (c, i == c) for i, (n, c) in want.items()} | {(None, 17): (None, True)}
    sample = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute.near_duplicates([(r[0], r[1]) for r in sample.select("doc_id", "text").collect()], 5, 80)
    assert {r[0]: (r[1], r[2]) for r in minhash.near_duplicates(sample, 5).collect()} == want


def test_exploded_and_joined_tables_are_not_taken_for_small(spark, monkeypatch):
    plans, threshold = {}, "spark.sql.autoBroadcastJoinThreshold"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    write = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df, label, **options: (plans.update({label: plan(df)}), write(df, label, **options))[1])
    rows = [(i, " ".join(f"w{i % 390}x{j}" for j in range(20)), f"s{i % 7}") for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    told = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    before = spark.conf.get(threshold)
    try:
        # More than Spark takes 400 lists of bands for (some 20 KB), less than they are (some 400 KB).
        spark.conf.set(threshold, 100_000)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(texts, 5).collect()}
        assert spark.conf.get(threshold) == "100000"
        assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
        assert got == {i: i % 390 for i in range(400)}
        assert "Generate posexplode" in plans["members"] and "Broadcast" not in plans["members"]
        # The evidence of all documents is joined to seven sites.
        judged = quality.judge(texts, told)
        assert "BuildRight" in plan(judged) and "BuildLeft" not in plan(judged)
        assert judged.count() == 400
    finally:
        spark.conf.set(threshold, before)


def test_top_k_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)] + [(i, [0.5] * 6) for i in range(100, 130)]
    bad = [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, []), (3, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    fine = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(int)) for i, v in rows + bad[5:]]
    fine = list({i: np.pad(v, (0, 6 - len(v))) for i, v in fine}.items())
    want = []
    for q in (0, 100):
        x = dict(fine)[q]
        best = sorted((-int(v @ x), i) for i, v in fine if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert plain(topk.top_k(df, df.where("vec_id % 100 = 0"), 10)) == sorted(want, key=repr)

def test_top_k_keeps_only_the_best_of_a_strip(spark, monkeypatch):
    monkeypatch.setattr(topk, "STRIP", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(3)
    for size, spread in ((7, 1.0), (5, 6e4)):
        rows = [(i, [float(x) for x in spread * rng.normal(size=size)]) for i in range(300)] + [(i, [0.5] * size) for i in range(300, 400)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        fine = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows if max(map(abs, v)) * 1024 < topk.LARGEST}
        want = []
        for q in (i for i in fine if i % 20 == 0):
            best = sorted(((-int(fine[q] @ v), i) for i, v in fine.items() if i != q))[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
        assert plain(topk.top_k(df, df.where("vec_id % 20 = 0"), 10)) == sorted(want, key=repr)


def test_top_k_lists_take_up_few_vectors():
    rng = np.random.default_rng(4)
    parts = [np.round(rng.normal(size=(8, 5000)) * 1000).astype(np.float32) for _ in range(2)]
    q, v, score = topk._best_of([p.copy() for p in parts], np.full(8, -1), 10)
    assert len(q) < 8 * 5000 // 20
    whole = (parts[0] + parts[1]).astype(np.int64)
    for i in range(8):
        assert sorted(score[q == i])[-10:] == sorted(whole[i])[-10:]

def test_overlaps_find_substitutions(spark, benchmark):
    passage = [w.upper() for w in BASE[2:18]]
    two, three = list(passage), list(passage)
    two[3], two[8] = "x", "y"
    three[3], three[6], three[9] = "x", "y", "z"
    rows = [(1, "pre " + ", ".join(passage)), (2, " ".join(two)), (3, " ".join(three)), (4, None), (5, "too short"), (None, " ".join(passage))]
    found = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (2, 1)}


def test_overlaps_find_every_substitution_of_short_items(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(7, 14)]
    rows, want = [], set()
    for n, text in items:
        for count in range(4):
            for gone in itertools.combinations(range(n), count):
                words = [f"x{k}" if k in gone else w for k, w in enumerate(text.split(" "))]
                rows.append((len(rows), " ".join(["pre", "fix", *words, "post"])))
                if count <= 2 * n // 13:
                    want.add((rows[-1][0], n))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.overlaps(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_mix_reaches_targets(docs):
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - k[1]) < 1 or k[1] == 0 for k, t in by.items())
    assert plain(mixing.taken(docs)) == plain(mixing.taken(docs.repartition(5)))


def test_schedule_is_inverted(spark):
    share = spark.range(11).select((F.col("id") / 10).alias("u"))
    for s in mixing.CURRICULUM:
        for r in share.select("u", mixing._time_of(F.col("u"), s).alias("t")).collect():
            (a, b) = s[0][1], s[1][1]
            assert abs((a * r.t + (b - a) * r.t**2 / 2) / ((a + b) / 2) - r.u) < 1e-9


def test_surrogates(spark):
    text = "Ask Mr. Smith or Frau Anna Maier at a.b@x1.example.com, A.B@x1.example.com, +1 (212) 555-0100, 10.1.2.3, 4111 1111 1111 1111 4111111111111111."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain"), (1, text)], "doc_id long, text string").withColumn("entity", F.lit(1))
    out = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    new = out[1].text
    assert out[2].text is None and out[3].text == "" and out[4].text == "plain" and out[1].n_entities == 8
    old, got = re.findall(r"[\w.]+@\S+?(?=,)|\d[\d ]{14,}\d|\d+\.\d+\.\d+\.\d+", text), re.findall(r"[\w.]+@\S+?(?=,)|\d[\d ]{14,}\d|\d+\.\d+\.\d+\.\d+", new)
    assert not set(old) & set(got) and got[0].lower() == got[1].lower() and new.startswith("Ask Mr. ")
    card = re.search(r"\d{4} \d{4} \d{4} \d{4} (\d{16})", new)
    assert card.group(0)[:19].replace(" ", "") == card.group(1)
    digits = [int(c) for c in card.group(1)]
    assert sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Frau [A-Z]\w+a [A-Z]\w+a at", new)


def test_secrets_without_digits_are_found(spark):
    secrets = ["ghp_" + "abXY" * 9, "sk-" + "abcdWXYZ" * 3, "AKIA" + "QRST" * 4, "abcdef" * 6]
    df = spark.createDataFrame([(i, f"key {s} end") for i, s in enumerate(secrets)], "doc_id long, text string")
    got = pii.pseudonymise(df).collect()
    assert all(r.n_entities == 1 and secrets[r.doc_id] not in r.text for r in got)


def test_surrogates_of_small_formats(spark):
    short = ["Mr " + c + v for c in "BCDFGHKLMNPRSTVW" for v in "aeiou"]
    letters = "abcdefghijklmnopqrstuvwxyz"
    mails = [f"{a}@{b}.co" for a in letters for b in letters]
    others = ["Mr Արմեն", "Mr Անի", "Г-н Її", "_@-.com", "+@-.com"]
    every = short + mails + others
    df = spark.createDataFrame(list(enumerate(f"see {e} there" for e in every)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df).collect()}
    new = [re.fullmatch(r"see (.*) there", got[i].text).group(1) for i in range(len(every))]
    assert all(got[i].n_entities == 1 for i in got) and len(set(new)) == len(every) and not set(new) & set(every)
    assert all(n.startswith("Mr ") for n in new[: len(short)]) and all(re.fullmatch(r"\w+@\w\.co", n) for n in new[len(short) : -len(others)])
    assert re.fullmatch(r"Mr [Ա-Ֆ][ա-ֆ]{4,}", new[-5]) and re.fullmatch(r"Г-н [\u0400-\u04FF]{2,}", new[-3]) and new[-2].endswith("_@-.com")


def test_numbers_grow_when_their_format_is_full(spark):
    kinds = [("ssn", "123-45-6789", "123456789"), ("card", "4111 1111 1111 1111", "4111111111111111"), ("phone", "+1 23 45", "12345"), ("ip", "10.1.2.3", "10.1.2.3")]
    df = spark.createDataFrame([(*k, pii.SAME_LENGTH + 1) for k in kinds], "kind string, entity string, norm string, attempt int")
    laid = pii._with_surrogate(df, "k").select("kind", "new", pii.laid_out(F.col("kind"), F.col("entity"), F.col("new")).alias("out")).collect()
    out = {r.kind: r.out for r in laid}
    assert re.fullmatch(r"\d{3}-\d{2}-\d{6}", out["ssn"]) and re.fullmatch(r"\+\d \d{2} \d{4}", out["phone"]) and re.fullmatch(r"\d+(\.\d+){5}", out["ip"])
    digits = [int(c) for c in out["card"].replace(" ", "")]
    assert len(digits) == 18 and sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_templates(spark):
    rows = [(i, f"user {i} logged in from host\nunique {i * 'x'} thing is here now{i}") for i in range(8)] + [(20, None), (21, "")]
    out = {r.doc_id: r for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_dropped >= 1 and "logged" not in out[i].text for i in range(8)) and out[20].text is None and out[21].text == ""


def test_short_lines_recur_as_they_are(spark):
    rows = [(i, f"Read more\nbody number {'abcdefgh'[i]} stands here alone\n\nPage {i}\n  All rights  reserved.\nMenu\n<*>") for i in range(8)]
    rows += [(30 + i, "Read less\nMenu") for i in range(4)] + [(40, "Read more please"), (41, "Page 3"), (42, None)]
    out = {r.doc_id: r for r in linededup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].text == f"\nPage {i}" for i in range(8))
    assert all(out[30 + i].text == "Read less" for i in range(4)) and (out[40].n_dropped, out[41].n_dropped, out[42].text) == (0, 0, None)
    body = [(i, f"Menu\nText {i * 'x'}y\n\n") for i in range(4)]
    assert all(r.n_dropped == 0 for r in linededup.drop_recurring(spark.createDataFrame(body, "doc_id long, text string")).collect())


def test_shards_are_even_and_keep_groups(docs):
    rows = sharding.shard(docs, shards=3).collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"bytes"}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.text_crc32 == rows[0].text_crc32}) == 1
    parts = np.random.default_rng(0).integers(1, 1000, (500, 1))
    to = sharding.difference(np.pad(parts, ((0, 0), (0, 7))))[:, 0]
    sums = np.bincount(to, weights=parts[:, 0], minlength=8)
    assert sums.max() - sums.min() <= 2


def test_classifier_rejects_on_held_out(spark, docs, labels):
    every, known = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judge(every, known.where("doc_id % 2 = 0")).join(known.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1 and r.toxic == 0) for r in judged)
    assert right / len(judged) > 0.85
    assert quality.judge(docs, labels).count() == len(ROWS)
    assert all(r.kept for r in quality.judge(docs, labels.limit(0)).collect())


def test_repeated_spans(docs):
    got = sorted((r[:4] for r in map(tuple, substring.repeated_spans(docs).collect())), key=repr)
    seen, want = {}, []
    for i, text, *_ in ROWS:
        w = brute.words(text)
        for k in range(len(w) - 12):
            if i is not None:
                seen[tuple(w[k : k + 13])] = min(i, seen.get(tuple(w[k : k + 13]), i))
    for i, text, *_ in ROWS:
        w, gone = brute.words(text), set()
        for k in range(len(w) - 12):
            if i is not None and seen[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_repeats_are_extended(docs):
    assert plain(suffixarray.repeats(docs)) == [(10, 1, 120, 9, 0)]


def test_repeats_behind_a_hot_part_are_found(spark):
    rng = np.random.default_rng(1)
    draw = lambda n: [f"v{k}" for k in rng.integers(0, 10**9, n)]
    hot, rows = draw(33), []
    for pair in range(40):
        own, tail = draw(17), draw(12)
        rows += [(2 * pair + side, " ".join(draw(60) + own + hot + (tail if pair % 2 else []) + draw(60))) for side in (0, 1)]
    rows += [(1000 + i, " ".join(draw(60) + hot + draw(60))) for i in range(400)]
    held, want = {}, set()
    for i, text in rows:
        w = text.split(" ")
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), []).append(i)
    for ids in held.values():
        want |= {(i, ids[0]) for i in ids if i != ids[0]}
    got = {(r.doc_id, r.other_id) for r in suffixarray.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) == 40 and got == want


def test_empty_tables(spark, docs, labels, benchmark):
    none = docs.limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (
        minhash.near_duplicates(none), topk.top_k(vectors, vectors), decontaminate.overlaps(none, benchmark),
        decontaminate.overlaps(docs, benchmark.limit(0)), mixing.taken(none), pii.pseudonymise(none), linededup.drop_recurring(none),
        sharding.shard(none), quality.judge(none, labels), substring.repeated_spans(none), suffixarray.repeats(none),
    ):
        assert out.count() == 0


def test_pipeline_keeps_columns(spark, docs, tmp_path):
    import corpus_pipeline

    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
        if name != "sharding":
            assert rows.columns == docs.columns
    assert rows.count() > 0


@pytest.mark.parametrize("schedule", [((0.0, 1.0), (1.0, 0.0)), ((0.0, 0.0), (0.5, 2.0), (0.5001, 0.1), (1.0, 3.0))])
def test_taken_words_are_what_the_schedule_hands_out(spark, monkeypatch, schedule):
    rows = [(i, " ".join(["w"] * (i * 37 % 211)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    level = {r.doc_id: r.taken for r in mixing.taken(docs, schedules=[mixing.LEVEL]).collect()}
    assert {r.doc_id: r.taken for r in mixing.taken(docs, schedules=[schedule]).collect()} == level
    # Without the integral of the schedule nothing says what a position leaves.
    monkeypatch.setattr(mixing, "_handed_out", lambda at, schedule: F.lit(1.0))
    assert not any(r.taken for r in mixing.taken(docs, schedules=[schedule]).collect())


def test_driver_sees_the_fitted_model_only(spark, labels, docs, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    want = quality.fit(docs, labels)
    assert set(want["heads"]) == set(quality.HEADS) and len(want["heads"]["quality"][1]) == quality.SHAPE + 1
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: pytest.fail("features came to the driver"))
    assert quality.fit(docs, labels)["heads"].keys() == want["heads"].keys()


def _steps(spark):
    return {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if "-" in f}


def test_span_steps_are_dropped(spark, docs):
    before = _steps(spark)
    substring.repeated_spans(docs).count()
    assert {f.split("-")[0] for f in _steps(spark) - before} == {"covered"}


def test_lines_are_split_once(spark):
    lines = spark.createDataFrame([("a 1 b c",), (" \t\x0b ",), ("x y",)], "line string")
    rows = linededup._split(lines.where(F.regexp_like("line", F.lit(linededup.NOT_BLANK))), 4)
    assert [r.tokens for r in rows.collect()] == [["a", "<*>", "b", "c"], ["x", "y"]]
    plan = rows.select(F.size("tokens"), F.hash("tokens"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
