"""What the operators share: tables, stored steps, running offsets, connected components."""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.session import shared_folder

#: A word is a run of bytes other than these ASCII blanks.
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` into the folder all executors share and continue from the files.

    A lost executor re-reads files instead of replaying the plan.  Shuffle files of the finished step go as
    soon as the driver finds their plan dead, so it is told to look.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return back


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Smaller Arrow batches for the steps that are written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def measured_joins(spark: SparkSession):
    """Shuffled joins for the steps that are written inside, which AQE turns into broadcasts where it has measured a small side.

    Spark sizes an exploded table as if each list had one element, so it may take a large one for small and broadcast it.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, own = spark.conf.get(planned), spark.conf.get(measured, None)
    spark.conf.set(measured, before if own is None else own)
    spark.conf.set(planned, -1)
    try:
        yield
    finally:
        spark.conf.set(planned, before)
        if own is None:
            spark.conf.unset(measured)


def forget(*tables: DataFrame) -> None:
    """Delete stored steps that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row, per ``group`` in ``order``; long.

    A group of any size stays spread: rows are range-partitioned by group and order, summed within their partition,
    and shifted by the sums of the partitions before, which are one row per group and partition.  Placement is
    written down first, because range boundaries are sampled.
    """
    placed = stored(
        rows.withColumn("_value", value.cast("long"))
        .repartitionByRange(*group, *order)
        .withColumn("_part", F.spark_partition_id()),
        "placed",
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g) for g in group]
    shifts = (
        placed.groupBy("_part", *group)
        .agg(F.sum("_value").alias("_n"))
        .select(F.col("_part").alias("_p"), *[k.alias(f"_g{i}") for i, k in enumerate(keys)],
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match = match & k.eqNullSafe(F.col(f"_g{i}"))
    return (
        placed.withColumn("_at", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(shifts, match)
        .select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))
    )


def _are_stars(pairs: DataFrame) -> bool:
    """True when every ``u`` of ``pairs (u, v)`` has one ``v``, which is no ``u`` itself; ends are counted before the shuffle."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(pairs.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    places = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not places.agg(F.count_if(F.expr("ups > 1 or (ups = 1 and least = 0)"))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable over ``edges (a, b)``, for every node that has an edge.

    Alternates large and small stars until only stars are left, which takes a number of rounds logarithmic in the
    longest path.  Minima are combined before the shuffle and joined back, so a hub's edges may be split.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # An own minimum keeps its star: its edges all point at it already.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        done = stored(small, "stars")
        forget(pairs)
        pairs = done
    tops = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component"))
    )
