"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import forget, running_sum, stored, word_count

#: Weight of a source over training time: (time, factor) knots from 0 to 1, linear between them.
Schedule = Sequence[tuple[float, float]]
LEVEL: Schedule = ((0.0, 1.0), (1.0, 1.0))
#: Schedules dealt to sources in turn by the registered query: level, rising, falling.
CURRICULUM: Sequence[Schedule] = (LEVEL, ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


def targets(sources: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``target`` for ``sources (source_size, weight, ...)``: ``share`` of all sizes dealt by weight, none above
    ``repeats`` times its source's size; what a full source leaves is dealt among the others by weight.

    Each round fixes the sources that their part overfills; only sums come to the driver, and the sources stay a table.
    """
    cap = F.col("source_size") * repeats
    rows = sources.withColumn("full", F.lit(False)).withColumn("_target", F.lit(0.0))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    count = -1
    while True:
        taken, weight, full = rows.agg(
            F.sum(F.when(F.col("full"), cap)), F.sum(F.when(~F.col("full"), F.col("weight"))), F.count_if("full")
        ).first()
        if full == count or not weight:
            break
        count = full
        left = max(0.0, total * share - (taken or 0))
        part = F.lit(left) * F.col("weight") / F.lit(weight)
        # A plan of one projection per round over a table of sources.
        rows = rows.withColumn("_target", F.when(F.col("full"), cap.cast("double")).otherwise(part))
        rows = rows.withColumn("full", F.col("full") | (part > cap))
    return rows.withColumn("target", F.least(F.col("_target"), cap.cast("double"))).drop("_target", "full")


def _time_of(demand: Column, schedule: Schedule) -> Column:
    """The training time at which a source has handed out the share ``demand`` of its target.

    The schedule is integrated piece by piece; within a piece the integral is a parabola in time and is inverted
    in closed form.
    """
    pieces = list(zip(schedule, schedule[1:]))
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces)
    conditions, upto = [], 0.0
    for (t0, w0), (t1, w1) in pieces:
        area = (t1 - t0) * (w0 + w1) / 2 / whole
        x = (demand - F.lit(upto)) * F.lit(whole)
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            at = F.lit(t0) + (x / F.lit(w0) if w0 else F.lit(0.0))
        else:
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + x * F.lit(2 * slope)))
            at = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        conditions.append((F.lit(upto + area), at))
        upto += area
    out = conditions[-1][1]
    for bound, at in reversed(conditions[:-1]):
        out = F.when(demand < bound, at).otherwise(out)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def _placed(docs: DataFrame, share: float, repeats: int, weights: Sequence[int]) -> DataFrame:
    """Each row with its size, its source's size and target, and the words before it in its source."""
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    word_count(F.col("text")).alias("size"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_turn")),
        "sizes",
    )
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = sized.withColumn("_null", F.col("source").isNull())
    numbered = running_sum(sized, [], ["_null", "source"], F.lit(1), "_place")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights)).cast("int") + 1)
    shared = stored(targets(numbered.withColumn("weight", turn), share, repeats), "targets")
    before = running_sum(rows, ["source"], ["_turn", "doc_id", "size"], F.col("size"), "_before")
    of = shared.select(F.col("source").alias("_source"), "source_size", "target", "_place")
    return before.join(of, before["source"].eqNullSafe(of["_source"])).drop("_source", "_turn")


def _handed_out(at: Column, schedule: Schedule) -> Column:
    """The share of its target that a source has handed out by the training time ``at``: the integral of its schedule."""
    pieces = list(zip(schedule, schedule[1:]))
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pieces)
    total = F.lit(0.0)
    for (t0, w0), (t1, w1) in pieces:
        x = F.greatest(F.lit(0.0), F.least(F.lit(t1 - t0), at - F.lit(t0)))
        total = total + x * (F.lit(w0) + x * F.lit((w1 - w0) / (t1 - t0) / 2))
    return total / F.lit(whole)


def _by_schedule(schedules: Sequence[Schedule], value: Callable[[Schedule], Column]) -> Column:
    """``value`` of the schedule that the row's source follows."""
    out = F.lit(None).cast("double")
    for i, schedule in enumerate(schedules):
        out = F.when(F.col("_place") % len(schedules) == i, value(schedule)).otherwise(out)
    return out


def _position(epoch: Column, schedules: Sequence[Schedule]) -> Column:
    start = F.col("_before") + epoch * F.col("source_size")
    demand = F.when(F.col("target") > 0, F.least(F.lit(1.0), start / F.col("target"))).otherwise(0.0)
    return _by_schedule(schedules, lambda schedule: _time_of(demand, schedule))


def _words(position: Column, schedules: Sequence[Schedule]) -> Column:
    """Words handed out of a row that stands at ``position``: what its source's schedule leaves for then and later, at most its size.

    Whole words were handed out before it, so the integral is rounded to them.
    """
    gone = F.round(F.col("target") * _by_schedule(schedules, lambda schedule: _handed_out(position, schedule)))
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - gone.cast("long"))).cast("long")


def mix(
    docs: DataFrame, share: float = 1.5, repeats: int = 2, weights: Sequence[int] = (3, 1, 2),
    schedules: Sequence[Schedule] = CURRICULUM,
) -> DataFrame:
    """The training mix of ``docs (doc_id, text, source, ...)``: a row per row of ``docs`` and pass over its source, with
    ``doc_id, source, size, source_size, target, epoch, words`` (taken in this pass) and ``position`` in training time, 0 to 1.

    Sources, in code-point order with null last, take ``weights`` and ``schedules`` in turn.  A source's documents stand in
    the order of the MD5 of their ids and are handed out word by word until its target is reached, a further pass
    following the first; only the last document can be taken in part.  A document's position is the time at which
    the integral of its source's schedule has reached its first word, and its words are those that the schedule still
    has to hand out from then on; callers range-sort by ``position``.

    Texts that are null or have no words are of size 0 and give no row; nor do passes that take nothing.  Rows that repeat a document
    count each.  Documents without doc_id come first in their source.  The same rows give the same mix; an empty table gives none.
    """
    placed = _placed(docs, share, repeats, weights)
    passes = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    passes = passes.withColumn("position", _position(F.col("epoch"), schedules))
    passes = passes.withColumn("words", _words(F.col("position"), schedules)).where("words > 0")
    return passes.select(*[c for c in passes.columns if c not in ("_before", "_place", "position")], "position")


def taken(
    docs: DataFrame, share: float = 1.5, repeats: int = 2, weights: Sequence[int] = (3, 1, 2),
    schedules: Sequence[Schedule] = CURRICULUM,
) -> DataFrame:
    """The same mix with one row per row of ``docs``: ``doc_id, size, source_size, target, taken`` (over all passes) and ``position``
    (of the first pass, in which every document stands, with or without words)."""
    placed = _placed(docs, share, repeats, weights)
    for e in range(repeats):
        placed = placed.withColumn(f"_at{e}", _position(F.lit(e), schedules))
    total = reduce(lambda a, b: a + b, [_words(F.col(f"_at{e}"), schedules) for e in range(repeats)])
    return placed.select("doc_id", "size", "source_size", "target", total.alias("taken"), F.col("_at0").alias("position"))
