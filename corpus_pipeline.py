"""From raw documents to shards: quality, near duplicates, decontamination, mixing, sharding.

Rows without doc_id cannot be told apart by a decision on ids: the filtering stages keep them, and mixing and
sharding treat them like any row.  Every stage works on all rows it is given, ignores columns it does not know
and passes them on (the last returns the sharding), and gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import decontaminate, minhash, mixing, quality, sharding
from codelode.llm.common import stored, table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the documents of ``gone (doc_id)``."""
    return docs.join(gone.select(F.col("doc_id").alias("_gone")).distinct(), F.col("doc_id") == F.col("_gone"), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; if it rejects one row of a document, all its rows go."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return _without(docs, judged.where("not kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows that repeat an id, one."""
    found = minhash.near_duplicates(docs, size=5, percent=80)
    kept = _without(docs, found.where("not kept"))
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if not again.take(1):
        return kept
    return _without(kept, again).unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return _without(docs, decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix in the order of its positions: a document once per pass that takes at least half its words."""
    plan = mixing.mix(docs).where("2 * words >= size").groupBy(F.col("doc_id").alias("_id"), "epoch").agg(F.min("position").alias("_position"))
    met = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")))
    return met.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id").select(*docs.columns)


def shard_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and its slot in it."""
    return sharding.shard(docs, shards=24, overhead=8)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_bytes),
]
#: A fitted classifier and differencing cannot be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
