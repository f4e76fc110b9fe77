"""Line dedup by log templates: a tree of fixed depth, variable fields generalised, recurring templates dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import forget, stored, words

FIELD = "<*>"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _tokens(min_tokens: int):
    """The tokens of a line in ``plain`` form; of ``min_tokens`` or more, those with digits are variable fields."""
    plain = F.col("plain")
    masked = F.transform(plain, lambda t: F.when(F.regexp_like(t, F.lit("[0-9]")), F.lit(FIELD)).otherwise(t))
    # Most lines have no digit at all, which one look at the line tells.
    return F.when((F.size(plain) < min_tokens) | ~F.regexp_like("line", F.lit("[0-9]")), plain).otherwise(masked)


def _split(lines: DataFrame, min_tokens: int) -> DataFrame:
    return lines.withColumn("plain", words(F.col("line"))).withColumn("tokens", _tokens(min_tokens))


def recurring_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 4, depth: int = 2, constant: float = 0.6) -> DataFrame:
    """``doc_id, line_no, template``: the lines of ``docs (doc_id, text, ...)`` whose template recurs in ``min_docs`` documents.

    A line falls through a tree of fixed depth: by its number of tokens, then by its ``depth`` leading tokens (those with
    digits are variable).  In its leaf, a token stays constant where at least ``min_docs`` lines of documents have it in its
    place; the others are generalised to variable fields.  A line of which less than the share ``constant`` stays
    constant is its own template, and so is a line of fewer than ``min_tokens`` tokens, digits and all, in a leaf of its own.  Equal lines are counted once per document and first of all, so a line that a third of
    all documents hold is one row of its leaf, and leaves too small to recur go before any token is looked at.

    Blank lines have no template.  Null and empty texts have none; rows without doc_id take no part;
    rows that repeat a doc_id count as one document.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Blank lines go by a look at the line; what has tokens is split once, its columns not being merged with those made of them.
    tokens = _split(_lines(docs).where(F.regexp_like("line", F.lit(NOT_BLANK))), min_tokens)
    short = F.size("tokens") < min_tokens
    leaf = F.xxhash64(F.size("tokens"), F.when(short, F.col("tokens")).otherwise(F.slice("tokens", 1, depth)))
    digest = F.unhex(F.md5(F.array_join("tokens", " ").cast("binary")))
    narrow = stored(tokens.select("doc_id", "line_no", leaf.alias("leaf"), digest.alias("digest")), "lines")
    leaves = narrow.select("leaf", "doc_id").distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    held = stored(narrow.join(leaves, "leaf"), "held")
    per_line = held.select("leaf", "digest", "doc_id").distinct().groupBy("leaf", "digest").agg(F.count("*").alias("n"))
    # One holder lends the tokens of each distinct line.
    lender = held.groupBy("digest").agg(F.min(F.struct("doc_id", "line_no")).alias("at")).select("digest", "at.*")
    lent = lender.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "digest")).alias("wanted"))
    taken = (
        docs.join(lent, "doc_id").select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("w"))
        .select("w.digest", F.element_at("all", F.col("w.line_no") + 1).alias("line"))
        .dropDuplicates(["digest"])
    )
    known = stored(_split(taken, min_tokens).select("digest", "tokens").join(per_line, "digest"), "known")
    slots = known.where(F.size("tokens") >= min_tokens).select("leaf", "digest", "n", F.posexplode("tokens").alias("pos", "token"))
    support = slots.where(F.col("token") != FIELD).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("s")).where(F.col("s") >= min_docs)
    fixed = slots.join(support, ["leaf", "pos", "token"]).groupBy("digest").agg(F.collect_list("pos").alias("fixed"))
    general = F.transform("tokens", lambda t, i: F.when(F.array_contains("fixed", i), t).otherwise(F.lit(FIELD)))
    template = F.when(F.size("fixed") >= F.ceil(F.size("tokens") * constant), F.array_join(general, " ")).otherwise(F.array_join("tokens", " "))
    templates = stored(
        known.join(fixed, "digest", "left").withColumn("fixed", F.coalesce("fixed", F.array().cast("array<int>"))).select("digest", template.alias("template")),
        "templates",
    )
    key = F.md5(F.col("template").cast("binary"))
    told = stored(held.join(templates.select("digest", key.alias("key")), "digest").select("doc_id", "line_no", "key", "digest"), "told")
    often = told.select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key")
    names = templates.select(key.alias("key"), "template").distinct()
    out = stored(told.join(often, "key").join(names, "key").select("doc_id", "line_no", "template"), "recurring")
    forget(narrow, held, known, templates, told)
    return out


def drop_recurring(docs: DataFrame, **options) -> DataFrame:
    """``docs (doc_id, text, ...)`` without the lines of recurring templates, with ``n_lines`` and ``n_dropped``.

    A text that keeps no line is empty; a null text stays null with no lines.  Repeated rows lose the same lines.
    """
    gone = recurring_lines(docs, **options).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["_doc"], "left")
    lines = F.split(docs["text"], "\n")
    lost = F.coalesce("_gone", F.array().cast("array<int>"))
    keep = F.filter(lines, lambda line, i: ~F.array_contains(lost, i))
    text = F.when(F.size(lost) > 0, F.array_join(keep, "\n")).otherwise(docs["text"])
    return joined.select(
        *[text.alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.size(lost).alias("n_dropped"),
    )
