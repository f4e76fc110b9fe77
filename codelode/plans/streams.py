"""Runtime snapshot queries, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codelode.plans.registry import query
from codelode.plans.sqlviews import with_views
from codelode.session import shared_folder
from codelode.sources import tables as T
from codelode.streaming import jvmstate as V


def _parsed(spark, sf, sections=V.SECTIONS):
    return V.valid_snapshots(V.parse_snapshots(T.snapshots(spark, sf), sections))


def _events_stream(spark, sf):
    """The events table as a stream, read as a folder of one file."""
    schema = T.read(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")


def _work_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SAMPLE = "SELECT pid, tick, series, round(value,6) AS value FROM "


@query(with_views("samples", _SAMPLE + "samples"))
def snapshot_samples(spark, sf):
    return V.samples(_parsed(spark, sf, V.SAMPLED)).withColumn("value", F.round("value", 6))


_LAST = _SAMPLE + "(SELECT *, row_number() OVER (PARTITION BY pid, series ORDER BY tick DESC) AS k FROM samples) WHERE k<=60"


@query(with_views("samples", _LAST))
def last60(spark, sf):
    return V.last_samples(V.samples(_parsed(spark, sf, V.SAMPLED))).withColumn("value", F.round("value", 6))


@query(with_views("samples", _LAST))
def last60_stream(spark, sf):
    polls = T.snapshots_of(_events_stream(spark, sf))
    history = V.rolling_history(V.samples(V.valid_snapshots(V.parse_snapshots(polls, V.SAMPLED))))
    table = V.run_to_table(history, _work_folder(spark, "last60"), "update")
    return V.latest_per_series(table).withColumn("value", F.round("value", 6))


@query(with_views("polls", """SELECT pid, tick, CAST(row_number() OVER (PARTITION BY tick ORDER BY o)-1 AS INT) AS position, name, type, used, committed, CAST(-1 AS BIGINT) AS max, CAST(NULL AS BIGINT) AS peak_used FROM (
   SELECT pid, tick, 1 AS o, 'Heap (aggregate)' AS name, 'HEAP' AS type, used, used*2 AS committed FROM polls WHERE e<>'view' UNION ALL SELECT pid, tick, 2, 'Non-heap (aggregate)', 'NON_HEAP', used*3, used*6 FROM polls WHERE e<>'view'
   UNION ALL SELECT pid, tick, 3, 'Eden', 'HEAP', used, used*2 FROM polls UNION ALL SELECT pid, tick, 4, 'Code', 'NON_HEAP', used+1, used*2+2 FROM polls)"""))
def memory_pools(spark, sf):
    return V.memory_pools(_parsed(spark, sf, ["memory", "memoryPools"]))


@query(with_views("polls", "SELECT pid, tick, 'G1' AS name, tick AS collections, CAST(0 AS BIGINT) AS time_ms FROM polls"))
def gc_collectors(spark, sf):
    return V.collectors(_parsed(spark, sf, ["gc"]))


@query(with_views("polls", """SELECT pid, tick, u*10+i AS id, 'T'||(9-i)||'-'||u AS name, CASE WHEN u%2=0 THEN 'RUNNABLE' ELSE 'BLOCKED' END AS state, u+i AS blocked, CAST(0 AS BIGINT) AS waited,
  e='error' AND i=1 AS deadlocked, CASE WHEN e='error' THEN 1 ELSE 0 END AS deadlocked_threads FROM polls, (VALUES (0),(1)) t(i) WHERE e<>'click'"""))
def thread_rows(spark, sf):
    return V.threads(_parsed(spark, sf, ["threads"]))


@query(with_views("polls", """SELECT pid, tick, key, value FROM (SELECT pid, tick, 'user.id' AS key, CAST(u AS VARCHAR) AS value FROM polls UNION ALL SELECT pid, tick, 'Event.Type', e FROM polls UNION ALL SELECT pid, tick, 'os.props', props FROM polls)
  WHERE contains(lower(key),'type') OR contains(lower(value),'7')"""))
def system_properties(spark, sf):
    by_type = V.system_properties(_parsed(spark, sf, ["systemProperties"]), "TYPE")
    return by_type.unionByName(V.system_properties(_parsed(spark, sf, ["systemProperties"]), "7").filter(~F.lower("key").contains("type")))


@query(with_views("polls", """SELECT pid, tick, CAST(0 AS BIGINT) AS loaded_classes, 0 AS processors, CAST(-1 AS DOUBLE) AS "cpuLoad", round(CASE WHEN e<>'signup' THEN v/500-(u%2)*CAST(0.1 AS DOUBLE) ELSE -1 END, 6) AS "processCpuLoad", 3 AS properties FROM polls"""))
def runtime_summary(spark, sf):
    out = V.runtime_summary(_parsed(spark, sf))
    return out.select("pid", "tick", "loaded_classes", "processors", "cpuLoad", F.round("processCpuLoad", 6).alias("processCpuLoad"), F.size("properties").alias("properties"))


@query(with_views("polls", "SELECT pid, tick, CASE WHEN tick%3=0 THEN 'broken' ELSE '[1]' END AS json FROM polls WHERE tick%5=0"))
def corrupt_snapshots(spark, sf):
    tick = F.col("tick")
    bad = F.when(tick % 5 == 0, F.when(tick % 3 == 0, "broken").otherwise("[1]")).otherwise(F.col("json"))
    return V.corrupt_snapshots(V.parse_snapshots(T.snapshots(spark, sf).withColumn("json", bad)))


_STATUS = "CASE WHEN success AND engine='Fallback' THEN 'FALLBACK_ONLY' WHEN success THEN 'SUCCESS' ELSE 'FAILED' END"


@query(with_views("attempts", f"""WITH w AS (SELECT *, min(CASE WHEN success THEN attempt_no END) OVER (PARTITION BY chain) AS won, max(attempt_no) OVER (PARTITION BY chain) AS final FROM attempts)
  SELECT chain, {_STATUS} AS status, engine FROM w WHERE attempt_no=coalesce(won, final)"""))
def chain_outcomes(spark, sf):
    return V.chain_outcomes(T.attempts(spark, sf))


_CHANGES = f"""WITH s AS (SELECT key, attempt_no, {_STATUS} AS status FROM attempts), l AS (SELECT *, lag(status) OVER (PARTITION BY key ORDER BY attempt_no) AS previous FROM s)
  SELECT key, attempt_no, status, previous FROM l WHERE previous IS NULL OR previous<>status"""


def _updates(attempts):
    return attempts.select("key", "attempt_no", V.attempt_status(F.col("success"), F.col("engine")).alias("status"))


@query(with_views("attempts", _CHANGES))
def status_changes(spark, sf):
    return V.status_changes(_updates(T.attempts(spark, sf)))


@query(with_views("attempts", _CHANGES))
def status_changes_stream(spark, sf):
    changes = V.status_change_stream(_updates(T.attempts_of(_events_stream(spark, sf))))
    return V.run_to_table(changes, _work_folder(spark, "status")).drop("batch_id")
