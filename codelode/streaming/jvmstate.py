"""Runtime snapshots: parsing, derived samples, rolling history and status changes.

Every operator works on batch and streaming DataFrames alike; the two stateful ones have a batch twin
with the same result.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codelode.operators.ordered import carry_forward

# --- fixed values: the snapshot document -------------------------------------------------------
USAGE = "STRUCT<init: BIGINT, used: BIGINT, committed: BIGINT, max: BIGINT>"
SECTIONS = {
    "runtime": """STRUCT<name: STRING, vmName: STRING, vmVendor: STRING, vmVersion: STRING, specName: STRING,
   specVersion: STRING, specVendor: STRING, classPath: STRING, libraryPath: STRING, bootClassPath: STRING,
   bootClassPathSupported: BOOLEAN, startTime: BIGINT, uptime: BIGINT, pid: BIGINT, inputArguments: ARRAY<STRING>>""",
    "classLoading": "STRUCT<loadedClassCount: BIGINT, totalLoadedClassCount: BIGINT, unloadedClassCount: BIGINT, verbose: BOOLEAN>",
    "compilation": "STRUCT<available: BOOLEAN, name: STRING, timeMonitoringSupported: BOOLEAN, totalCompilationTimeMs: BIGINT>",
    "os": """STRUCT<name: STRING, arch: STRING, version: STRING, availableProcessors: INT, systemLoadAverage: DOUBLE,
   freeMemorySize: BIGINT, totalMemorySize: BIGINT, committedVirtualMemorySize: BIGINT, freeSwapSpaceSize: BIGINT,
   totalSwapSpaceSize: BIGINT, processCpuTime: BIGINT, cpuLoad: DOUBLE, processCpuLoad: DOUBLE>""",
    "memory": f"STRUCT<heap: {USAGE}, nonHeap: {USAGE}, objectPendingFinalizationCount: BIGINT>",
    "memoryPools": f"ARRAY<STRUCT<name: STRING, type: STRING, usage: {USAGE}, peak: {USAGE}>>",
    "gc": "ARRAY<STRUCT<name: STRING, collectionCount: BIGINT, collectionTimeMs: BIGINT>>",
    "threads": """STRUCT<threadCount: INT, peakThreadCount: INT, daemonThreadCount: INT, totalStartedThreadCount: BIGINT,
   deadlocked: ARRAY<BIGINT>, list: ARRAY<STRUCT<id: BIGINT, name: STRING, state: STRING, blockedCount: BIGINT,
   waitedCount: BIGINT, stack: ARRAY<STRING>>>>""",
    "systemProperties": "MAP<STRING, STRING>",
}
#: What ``samples`` looks at.
SAMPLED = {"memory": f"STRUCT<heap: {USAGE}>", "threads": "STRUCT<threadCount: INT>", "os": "STRUCT<processCpuLoad: DOUBLE>"}
MINUS_ONE_FIELDS = {
    "os": [
        "systemLoadAverage", "freeMemorySize", "totalMemorySize", "committedVirtualMemorySize", "freeSwapSpaceSize",
        "totalSwapSpaceSize", "processCpuTime", "cpuLoad", "processCpuLoad",
    ],
    "usage": ["max"],
}
HISTORY = 60


def read_snapshots(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of ``json`` lines from files that pollers drop into a folder, with their source file."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files) if max_files else spark.readStream
    return reader.text(folder).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("source_file"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _minus_one(c: Column) -> Column:
    return F.coalesce(c, F.lit(-1))


def _usage(u: Column) -> Column:
    """Absent counters are 0, an absent maximum is -1, an absent section stays null."""
    full = F.struct(
        _zero(u["init"]).alias("init"), _zero(u["used"]).alias("used"), _zero(u["committed"]).alias("committed"),
        _minus_one(u["max"]).cast("long").alias("max"),
    )
    return F.when(u.isNotNull(), full)


def parse_snapshots(polls: DataFrame, sections: Collection[str] | dict[str, str] = SECTIONS) -> DataFrame:
    """Add the parsed document ``s``; text that is no JSON object gives a null ``s``.

    Only the asked ``sections`` (names, or names with what is wanted of them) are made into values; of the others the parser reads the
    syntax alone, so a value of the wrong type is noticed only where it was asked for.  The parse is handed on
    through a generator: filters and projections on ``s`` cannot be pushed below one, so each document is parsed once.
    """
    types = sections if isinstance(sections, dict) else {name: SECTIONS[name] for name in sections}
    with_error = "STRUCT<" + ", ".join(f"{name}: {kind}" for name, kind in types.items()) + ", _corrupt: STRING>"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    is_object = F.ltrim("json").startswith("{")
    parsed = F.array(F.when(is_object, F.from_json("json", with_error, options)))
    found = polls.select("*", F.explode(parsed).alias("s"))
    return found.withColumn("s", F.when(F.col("s")["_corrupt"].isNull(), F.col("s").dropFields("_corrupt")))


def valid_snapshots(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("s").isNotNull())


def corrupt_snapshots(parsed: DataFrame) -> DataFrame:
    """Rows for the side sink."""
    return parsed.filter(F.col("s").isNull()).drop("s")


def runtime_summary(parsed: DataFrame) -> DataFrame:
    """Flat gauges of each snapshot with the defaults for what it does not say."""
    s = F.col("s")
    os = s["os"]
    gauges = [_minus_one(os[f]).cast("double").alias(f) for f in MINUS_ONE_FIELDS["os"]]
    return parsed.select(
        "pid", "tick",
        _zero(s["classLoading"]["loadedClassCount"]).alias("loaded_classes"),
        _zero(s["compilation"]["totalCompilationTimeMs"]).alias("compilation_ms"),
        _zero(s["runtime"]["uptime"]).alias("uptime"),
        _zero(os["availableProcessors"]).alias("processors"), *gauges,
        F.coalesce(s["systemProperties"], F.create_map().cast("map<string,string>")).alias("properties"),
    )


def samples(parsed: DataFrame) -> DataFrame:
    """``(pid, tick, series, value)``: a series only advances when its section is there."""
    s = F.col("s")
    heap = s["memory"]["heap"]
    mb = (_zero(heap["used"]) - F.pmod(_zero(heap["used"]), F.lit(1048576))) / 1048576
    sample = lambda section, name, value: F.when(
        section.isNotNull(), F.struct(F.lit(name).alias("series"), value.cast("double").alias("value"))
    )
    found = F.array(
        sample(heap, "heap_mb", mb),
        sample(s["threads"], "threads", _zero(s["threads"]["threadCount"])),
        sample(s["os"], "cpu_pct", F.greatest(F.lit(0.0), _minus_one(s["os"]["processCpuLoad"])) * 100),
    )
    return parsed.select("pid", "tick", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(
        "pid", "tick", "x.series", "x.value"
    )


def last_samples(rows: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Newest ``keep`` samples per series.  Spark cuts each task to ``keep`` rows per series first."""
    newest = Window.partitionBy("pid", "series").orderBy(F.col("tick").desc())
    return rows.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= keep).drop("rank")


def _trim_partition(keep: int):
    """Keep a task's newest samples per series, so that a busy series shuffles ``keep`` rows per task."""

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch])
            held = both.sort_values("tick").groupby(["pid", "series"], sort=False).tail(keep)
        if held is not None:
            yield held

    return trim


def rolling_history(stream: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Streaming twin of :func:`last_samples`: the whole current history of every series that changed.

    State is a bounded list per series.  Samples are trimmed inside each task before they are shuffled.
    """

    def advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ticks, values = (list(x) for x in state.get) if state.exists else ([], [])
        held = sorted(zip(ticks, values))
        for batch in batches:
            held = sorted(held + list(zip(batch["tick"].tolist(), batch["value"].tolist())))[-keep:]
        state.update(([int(t) for t, _ in held], [float(v) for _, v in held]))
        yield pd.DataFrame(
            {"pid": key[0], "series": key[1], "tick": [t for t, _ in held], "value": [v for _, v in held]}
        )

    schema = "pid bigint, series string, tick bigint, value double"
    trimmed = stream.select("pid", "series", "tick", "value").mapInPandas(_trim_partition(keep), schema)
    return trimmed.groupBy("pid", "series").applyInPandasWithState(
        advance, schema, "ticks array<bigint>, vals array<double>", "update", GroupStateTimeout.NoTimeout
    )


# --- tabular views -----------------------------------------------------------------------------


def memory_pools(parsed: DataFrame) -> DataFrame:
    """Pools of each snapshot, with rows for all heap and all non-heap memory when the section is there."""
    s = F.col("s")
    mem = s["memory"]
    no_usage = F.lit(None).cast(USAGE)
    row = lambda name, kind, usage, peak: F.struct(
        name.alias("name"), kind.alias("type"), usage.alias("usage"), peak.alias("peak")
    )
    total = lambda name, kind, usage: F.when(usage.isNotNull(), row(F.lit(name), F.lit(kind), _usage(usage), no_usage))
    totals = F.array(
        total("Heap (aggregate)", "HEAP", mem["heap"]), total("Non-heap (aggregate)", "NON_HEAP", mem["nonHeap"])
    )
    pools = F.transform(
        F.coalesce(s["memoryPools"], F.array()), lambda p: row(p["name"], p["type"], _usage(p["usage"]), _usage(p["peak"]))
    )
    rows = F.concat(F.filter(totals, lambda x: x.isNotNull()), pools)
    return parsed.select("pid", "tick", F.posexplode(rows).alias("position", "p")).select(
        "pid", "tick", "position", "p.name", "p.type", F.col("p.usage.used").alias("used"),
        F.col("p.usage.committed").alias("committed"), F.col("p.usage.max").alias("max"), F.col("p.peak.used").alias("peak_used"),
    )


def collectors(parsed: DataFrame) -> DataFrame:
    return parsed.select("pid", "tick", F.explode(F.col("s")["gc"]).alias("g")).select(
        "pid", "tick", "g.name", _zero(F.col("g.collectionCount")).alias("collections"),
        _zero(F.col("g.collectionTimeMs")).alias("time_ms"),
    )


def threads(parsed: DataFrame) -> DataFrame:
    """Threads with a deadlock flag and the number of deadlocked threads of their snapshot."""
    t = F.col("s")["threads"]
    dead = F.coalesce(t["deadlocked"], F.array().cast("array<bigint>"))
    return (
        parsed.filter(t.isNotNull())
        .select("pid", "tick", dead.alias("dead"), F.explode(t["list"]).alias("x"))
        .select(
            "pid", "tick", _zero(F.col("x.id")).alias("id"), "x.name", "x.state", _zero(F.col("x.blockedCount")).alias("blocked"),
            _zero(F.col("x.waitedCount")).alias("waited"),
            F.array_contains("dead", _zero(F.col("x.id"))).alias("deadlocked"),
            F.size(F.array_distinct("dead")).alias("deadlocked_threads"),
        )
    )


def system_properties(parsed: DataFrame, text: str = "") -> DataFrame:
    """Properties whose key or value contains the text, whatever its case."""
    rows = parsed.select("pid", "tick", F.explode(F.col("s")["systemProperties"]).alias("key", "value"))
    rows = rows.withColumn("value", F.coalesce("value", F.lit("")))
    needle = text.strip().lower()
    if not needle:
        return rows
    return rows.filter(F.lower("key").contains(needle) | F.lower("value").contains(needle))


# --- attempt outcomes --------------------------------------------------------------------------


def attempt_status(success: Column, engine: Column) -> Column:
    return F.when(success & (engine == "Fallback"), "FALLBACK_ONLY").when(success, "SUCCESS").otherwise("FAILED")


def chain_outcomes(attempts: DataFrame) -> DataFrame:
    """Outcome of each attempt chain.  A chain ends at its first success, which then decides."""
    won = F.col("success")
    first = F.min_by(F.when(won, F.col("engine")), F.when(won, F.col("attempt_no")))
    return attempts.groupBy("chain").agg(
        F.bool_or(won).alias("any"), first.alias("engine"), F.max_by("engine", "attempt_no").alias("last_engine")
    ).select(
        "chain",
        attempt_status(F.col("any"), F.coalesce("engine", F.lit(""))).alias("status"),
        F.coalesce("engine", "last_engine").alias("engine"),
    )


def status_changes(updates: DataFrame, key: str = "key", order: str = "attempt_no") -> DataFrame:
    """Updates whose status is the key's first or differs from the one before.

    The previous status is looked up in blocks of ``order``, so a busy key is spread over tasks.
    """
    seen = carry_forward(updates, [key], order, {"previous": F.col("status")}, inclusive=False)
    return seen.filter(F.col("previous").isNull() | (F.col("previous") != F.col("status")))


def status_change_stream(stream: DataFrame) -> DataFrame:
    """Streaming twin of :func:`status_changes` over ``(key, attempt_no, status)``.

    Between batches only the latest status of a key is kept.
    """

    def advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values("attempt_no", ignore_index=True)
        previous = [latest, *rows["status"].tolist()[:-1]]
        state.update((str(rows["status"].iloc[-1]),))
        rows["previous"] = pd.Series(previous, dtype="object")
        yield rows[[p is None or p != s for p, s in zip(previous, rows["status"])]][
            ["key", "attempt_no", "status", "previous"]
        ]

    return stream.groupBy("key").applyInPandasWithState(
        advance, "key string, attempt_no bigint, status string, previous string", "status string", "append",
        GroupStateTimeout.NoTimeout,
    )


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a Parquet table with its checkpoint beside it; ``batch_id`` tells the trigger.

    A batch is written under its own number, so one that is retried replaces itself.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data")


def latest_per_series(history: DataFrame) -> DataFrame:
    """The rolling history as of the last batch that touched each series."""
    last = history.groupBy("pid", "series").agg(F.max("batch_id").alias("batch_id"))
    return history.join(last, ["pid", "series", "batch_id"], "left_semi").drop("batch_id")
