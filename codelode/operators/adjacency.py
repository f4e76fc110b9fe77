"""Edge tables written once, in both directions, and read from the near end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import shared_folder

#: Edges per bucket that a table aims at, and the most buckets it gets.
BUCKET_EDGES, MOST_BUCKETS = 1_000_000, 4096

#: The end that a walk stands on, by its direction.
NEAR = {"OUT": "src", "IN": "dst"}
FAR = {"OUT": "dst", "IN": "src"}


def _with(edges: DataFrame, made: dict[str, str] | None) -> DataFrame:
    return edges.selectExpr("*", *[f"{how} AS {name}" for name, how in (made or {}).items()])


class Adjacency:
    """``edges (archive_id, src, dst, ...)`` on disk, once per direction, in folders by a hash of the archive and the near end.

    A walk asks for the edges around some nodes.  Only the folders that these nodes hash to are read; which they are is the one
    thing the driver learns, and there are at most ``buckets`` of them.  Building costs a pass over all edges, asking none.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, made: dict[str, str] | None = None) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.edges = _with(spark.read.parquet(f"{path}/buckets={buckets}"), made)
        self.columns = [c for c in self.edges.columns if c not in ("way", "bucket")]

    @classmethod
    def build(cls, edges: DataFrame, path: str, bucket_edges: int = BUCKET_EDGES, made: dict[str, str] | None = None) -> Adjacency:
        """Write ``edges`` below ``path``, a folder that all executors share.

        Columns ``made`` of others (names with SQL expressions) are not written or shuffled but made again when edges are read.
        A hub's edges lie in one folder; AQE spreads writing them over several tasks and files.
        """
        spark = edges.sparkSession
        made = made or {}
        edges.drop(*made).write.parquet(f"{path}/edges")
        edges = spark.read.parquet(f"{path}/edges")
        buckets = max(1, min(MOST_BUCKETS, -(-edges.count() // bucket_edges)))
        both = edges.select("*", F.explode(F.array(F.lit("OUT"), F.lit("IN"))).alias("way"))
        src, dst = (F.expr(made.get(end, end)) for end in ("src", "dst"))
        near = F.when(F.col("way") == "OUT", src).otherwise(dst)
        both = both.withColumn("bucket", cls._bucket(F.col("archive_id"), near, buckets))
        target = f"{path}/buckets={buckets}"
        both.hint("rebalance", "way", "bucket").sortWithinPartitions("way", "bucket", "archive_id", near).write.partitionBy("way", "bucket").parquet(target)
        if not buckets or both.isEmpty():  # an empty table has no folders to take the columns from
            both.write.mode("overwrite").parquet(target)
        return cls(spark, path, buckets, made)

    @classmethod
    def open(cls, spark: SparkSession, path: str, made: dict[str, str] | None = None) -> Adjacency:
        """A table that ``build`` wrote before, with the same ``made``."""
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = [f.getPath().getName() for f in found]
        return cls(spark, path, next(int(n.partition("=")[2]) for n in names if n.startswith("buckets=")), made)

    @staticmethod
    def _bucket(archive: Column, node: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(archive, node), F.lit(buckets)).cast("int")

    def touched(self, nodes: DataFrame) -> list[int]:
        """The folders that ``nodes (archive_id, node)`` hash to: at most ``buckets`` numbers, none for no nodes."""
        bucket = self._bucket(F.col("archive_id"), F.col("node"), self.buckets)
        return sorted(r[0] for r in nodes.select(bucket.alias("bucket")).distinct().collect())

    def around(self, nodes: DataFrame, way: str, buckets: list[int] | None = None) -> DataFrame:
        """``nodes (archive_id, node, ...)`` with each edge that leaves (``OUT``) or enters (``IN``) them."""
        buckets = self.touched(nodes) if buckets is None else buckets
        edges = self.edges.where(F.col("way") == way)
        if len(buckets) < self.buckets:
            edges = edges.where(F.col("bucket").isin(buckets))
        edges = edges.select(F.col("archive_id").alias("of_archive"), *[c for c in self.columns if c != "archive_id"])
        here = (F.col("archive_id") == F.col("of_archive")) & (F.col("node") == F.col(NEAR[way]))
        return nodes.join(edges, here).drop("of_archive")


def stored_edges(edges: DataFrame | Adjacency, make: Callable[[DataFrame], DataFrame], made: dict[str, str] | None = None) -> Adjacency:
    """An edge table as it is; anything else is made into edges and written to the shared folder first.

    Those who ask more than once build the table themselves and pass it.
    """
    if isinstance(edges, Adjacency):
        return edges
    return Adjacency.build(make(edges), f"{shared_folder(edges.sparkSession)}/edges-{uuid.uuid4().hex}", made=made)
