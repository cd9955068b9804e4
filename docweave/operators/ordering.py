"""Order and choice without large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut


def keep_first(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (ties: any of the equal rows' smallest values).

    An aggregate with a map-side combine, so a hot key shrinks before the shuffle.
    """
    rest = [c for c in frame.columns if c not in keys]
    first = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*frame.columns)


def ordinal(frame: DataFrame, group: list[str], order: list[str], segment: Column, name: str) -> DataFrame:
    """Adds ``name``, the number of a row within its group from 0.

    ``segment`` must not fall along ``order``.  Rows are numbered within
    (group, segment) and moved by the sizes of the segments before, so a group
    of any size is spread over its segments.
    """
    parts = frame.withColumn("_seg", segment)
    sizes = parts.groupBy(*group, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*group, "_seg", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_seg")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*group, "_seg").orderBy(*order))
    return parts.withColumn("_k", local).join(before, [*group, "_seg"]).withColumn(name, F.col("_before") + F.col("_k") - 1).drop("_seg", "_k", "_before")


def previous(frame: DataFrame, order: list[str], columns: list[str], suffix: str = "_before") -> DataFrame:
    """Adds each of ``columns`` from the row before in the whole order; null for the first row.

    The rows are split into ranges of the order; the first row of a range takes
    the last of the ranges before, of which there is one row each.
    """
    ranged = cut(frame.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    place = F.struct(*order)
    ends = ranged.groupBy("_p").agg(F.max_by(F.struct(*columns), place).alias("_end"))
    across = ends.select("_p", F.lag("_end").over(Window.orderBy("_p")).alias("_across"))  # one row per range
    local = F.lag(F.struct(*columns)).over(Window.partitionBy("_p").orderBy(*order))
    seen = ranged.withColumn("_local", local).join(across, "_p", "left").withColumn("_prev", F.coalesce("_local", "_across"))
    return seen.select(*frame.columns, *[F.col("_prev")[c].alias(c + suffix) for c in columns])
