"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings that AQE cannot work out for itself; a cluster's own values win where it names them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Call-site capture costs a millisecond per expression when a plan is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codelode")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Every open checkpoint and broadcast lives in the one local JVM.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share; set here only where the session names none."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Loops call this once per round, so that a round costs one join and a lost executor re-reads
    the written blocks instead of replaying every earlier round.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a task where rows are dealt by a bounded key.
TASK_ROWS = 200_000


def dealt(rows: DataFrame, *key: str, like: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt by ``key`` to tasks of some ``TASK_ROWS``, however large the table; ``like`` has about as many and is cheaper to count.

    AQE joins shuffled partitions by their compressed bytes, which repeated names make few, and cuts none before a window: what a
    task sorts would grow with the table.  For keys with bounded groups, such as methods.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(rows if like is None else like).count() // TASK_ROWS))
    return rows.repartition(tasks, *key)


#: Bytes of content that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on bytes of an Arrow batch for rows that hold whole files; it is read when a query starts.

    Otherwise a worker's memory grows with its partition until 10 000 rows or 64 MB are in one batch, several times over.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` as files in the shared folder, in a folder per value of ``by``.

    Unlike a checkpoint, files are read in as many tasks as their size asks for, those of a value alone, and a small table
    is known to be small when a join is planned.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
