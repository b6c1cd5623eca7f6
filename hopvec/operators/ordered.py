"""Global order without a single task: a distributed row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_row_number(df: DataFrame, order, name: str = "pos", start: int = 1) -> DataFrame:
    """Adds ``name`` = position in the total order ``order`` (a list of Columns), numbered
    from ``start``. The sort is range-partitioned; each partition counts its rows (one
    row per partition reaches the offsets), and a row's number is its partition offset
    plus its index inside the partition. The sorted rows are checkpointed so partition
    ids and positions are fixed between the two passes."""
    cols = df.columns
    s = df.orderBy(*order).select(*cols, F.spark_partition_id().alias("_p"),
                                  F.monotonically_increasing_id().alias("_m"))
    s = cut_lineage(s)
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    return (s.join(F.broadcast(offs), "_p")          # offsets: one row per partition
            .select(*cols, (F.col("_o") + local + F.lit(start)).cast("bigint").alias(name)))
