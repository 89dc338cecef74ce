"""Distributed ranking helpers.

``global_rank`` numbers rows 1..n in a total order without a
single-partition window: a range-partitioned sort, a per-partition row count
(one small row per partition), prefix offsets over those counts, and a
broadcast join of the offsets back.  The sorted data is checkpointed to the
shared checkpoint dir first so that a recomputed task cannot see different
range boundaries than the counted one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termspark.session import materialize


def global_rank(df: DataFrame, order: list[Column], out: str = "rank",
                checkpoint: bool = True) -> DataFrame:
    """Add ``out`` = 1-based position in ``order`` (which must be a total
    order, e.g. ending with a unique key)."""
    s = df.orderBy(*order).withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id())
    if checkpoint:
        s = materialize(s)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a window over it is tiny by construction
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + local + F.lit(1))
            .drop("_pid", "_mid", "_off"))
