"""Order-sensitive helpers that stay split however long one group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.session import cut_lineage


def carry_forward(
    rows: DataFrame, keys: list[str], order: str, values: dict[str, Column],
    block: int = 1 << 16, inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``values`` at or before each row, per key in ``order`` (an integer column).

    With ``inclusive`` off the row itself does not count.

    Groups are cut into blocks of ``order``: a window runs within each block, the few block
    summaries are carried forward among themselves and joined back.  A group of any length is
    spread over tasks, and the join reuses the partitioning of the window.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    for name, value in values.items():
        blocked = blocked.withColumn(f"_v_{name}", value)
    upto = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocked.groupBy(*keys, "_block").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in values]
    )
    carried = ends.select(
        *keys, "_block", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values]
    )
    local = blocked
    for n in values:
        local = local.withColumn(f"_l_{n}", F.last(f"_v_{n}", ignorenulls=True).over(inside))
    joined = local.join(carried, [*keys, "_block"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def number_rows(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Number rows 0, 1, 2, ... per ``group`` in ``order`` without gathering a group in one task.

    Rows are range-partitioned by group and order, numbered within their partition, and shifted by the
    counts of the partitions before.  Placement is written down first: range boundaries are sampled,
    and a recomputed sample could place a row elsewhere.
    """
    placed = cut_lineage(
        rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("_part", *group).agg(F.count("*").alias("_n")).select(
        "_part", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    return (
        placed.withColumn("_at", F.row_number().over(inside) - 1)
        .join(shifts, ["_part", *group])
        .select(*rows.columns, (F.col("_at") + F.col("_shift")).cast("long").alias(name))
    )
