"""The registered queries of the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import alignment, collocation, decontaminate, linededup, minhash, mixing, pii, quality, sharding, substring, suffixarray, tokencount, topk
from codelode.llm.common import table

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"), k=10, scale=1024)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken(table(spark, sf_dir, "documents"), share=1.5, repeats=2, weights=(3, 1, 2))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24, overhead=8)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their posteriors."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.where("kept").select("doc_id", "host", "path", "p_quality", "p_toxic", "kept")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_spans(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_suffixarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.repeats(table(spark, sf_dir, "documents"), length=50)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))[0]


def op12_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000)


def op13_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


PLANS = {
    f.__name__: f
    for f in (
        op1_minhash, op2_topk, op3_decontaminate, op4_mixing, op5_pii, op6_linededup, op7_sharding, op8_quality,
        op9_substring, op10_suffixarray, op11_alignment, op12_collocation, op13_tokencount,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _mask_key(words: str, pos: str, mask: tuple[int, ...]) -> str:
    return " || ' ' || ".join(f"{words}[{pos} + {o}]" for o in mask)


def _seeds(name: str, columns: str, rows: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, {m} AS mask, pos, {_mask_key('w', 'pos', mask)} AS key FROM "
        f"(SELECT *, unnest(range(1, len(w) - {mask[-1]} + 1)) AS pos FROM {rows})"
        for m, mask in enumerate(decontaminate.MASKS)
    )


_SAME = "+".join(f"coalesce((d.w[s.pos + {{0}} + {k}] = i.w[s.item_pos + {{0}} + {k}] AND s.pos + {{0}} + {k} > 0 AND s.item_pos + {{0}} + {k} > 0)::INT, 0)" for k in range(13))

ORACLES = {
    "op1_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(doc_id, top) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.top = e.a)
        SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(top) AS component_id, doc_id = min(top) AS kept
        FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_decontaminate": f"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark) GROUP BY w),
        ds AS ({_seeds('d', 'doc_id', 'd')}), si AS ({_seeds('i', 'item_id', 'i')}),
        s AS (SELECT doc_id, item_id, ds.pos AS pos, si.pos AS item_pos FROM ds JOIN si USING (mask, key)),
        m AS (SELECT s.doc_id, s.item_id, s.pos, len(i.w) AS n, greatest({', '.join(_SAME.format(k - 6) for k in range(7))}) AS same
              FROM s JOIN d USING (doc_id) JOIN i USING (item_id))
        SELECT doc_id, item_id, count(*) AS hits, CAST(min(pos) - 1 AS BIGINT) AS first_word FROM m
        WHERE same >= CASE WHEN n >= 13 THEN 11 ELSE n - floor(n * 2 / 13) END GROUP BY doc_id, item_id""",
    "op4_mixing": f"""
        WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format('text')}) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s),
        o AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
                - coalesce(sum(2 * source_size) OVER b, 0)::DOUBLE AS rest, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS weights
              FROM w WINDOW b AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, rest * weight / weights::DOUBLE > 2 * source_size AS filled FROM o),
        x AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE - coalesce(sum(2 * source_size) FILTER (filled), 0)::DOUBLE AS rest,
                     sum(weight) FILTER (NOT filled) AS weights FROM f),
        t AS (SELECT source, source_size, CASE WHEN filled THEN (2 * source_size)::DOUBLE ELSE least(x.rest * weight / x.weights::DOUBLE, (2 * source_size)::DOUBLE) END AS target FROM f, x),
        p AS (SELECT doc_id, size, source_size, target,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - before - source_size)) AS BIGINT) AS taken
        FROM p""",
    "op9_substring": f"""
        WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
        g AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 12], ' ') AS seq FROM (SELECT *, unnest(range(1, len(w) - 11)) AS pos FROM d)),
        m AS (SELECT seq, min(doc_id) AS low FROM g GROUP BY seq),
        c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos FROM g JOIN m USING (seq) WHERE low < doc_id),
        k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(list_contains(gone, i), FALSE)), lambda i: w[i]), ' '), '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)""",
    "op12_collocation": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
        g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) AS g FROM w),
        f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY lang, g),
        n AS (SELECT lang, sum(a) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE len(g) > 1 AND a >= 30),
        s AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
              FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
        m AS (SELECT lang, g, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM s GROUP BY lang, g, a),
        i AS (SELECT lang, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) AS g, a FROM c WHERE len(g) > 2),
        b AS (SELECT lang, g, max(a) AS a FROM i GROUP BY lang, g),
        o AS (SELECT m.lang, array_to_string(m.g, ' ') AS phrase, m.a, l, r, score FROM m LEFT JOIN b ON b.lang = m.lang AND b.g = m.g
              WHERE b.a IS NULL OR 100::HUGEINT * b.a < 80::HUGEINT * m.a),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM z JOIN n USING (lang) WHERE rank <= 2000""",
}
