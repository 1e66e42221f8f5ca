"""Numbers of rows in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise


def numbered(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with a column ``name``: 0, 1, 2, ... in ``order`` within each value of ``groups`` (not null).

    Rows are dealt by ranges of the groups and the order, sorted in their
    tasks, and written; a task's first number is the sum of what the tasks
    before it hold of the same group.  Rows that tie are numbered in any
    order.  Range bounds are sampled, so ``df`` should be cheap to read
    twice, as a written table is.
    """
    keys = [*(F.col(g) for g in groups), *order]
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the position in the task is the low half of the increasing id
    placed = materialise(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    held = placed.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    bases = held.select(*groups, "_part", (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(bases, [*groups, "_part"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
