"""Running sums over a global order without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.plans.session import partitions_for, written

TARGET_BYTES = 64 << 20


def running_sum(df: DataFrame, value: str, order: list[str], out: str = "running", group: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds ``out``: the sum of ``value`` up to and including each row, in the order of these columns, which must be unique together;
    with ``group``, within each group.

    Rows are dealt out by ranges of group and order and written with the number of their range; one sum for each range and group
    gives the offset of the next, and within a range a window adds up, so that no group is one task. Nulls of ``value``
    count as 0.
    """
    ranged = df.repartitionByRange(partitions_for(df, TARGET_BYTES, 1), *group, *order).withColumn("__range", F.spark_partition_id())
    ranged = written(ranged, "running-sum")
    totals = ranged.groupBy("__range", *group).agg(F.sum(F.coalesce(value, F.lit(0))).alias("__total"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = totals.select("__range", *group, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn(out, F.sum(F.coalesce(value, F.lit(0))).over(within))
    if not group:
        joined = summed.join(F.broadcast(offsets), "__range")  # as many rows as there are ranges
    else:
        theirs = offsets.select(F.col("__range").alias("__r"), *(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), "__before")
        same = F.col("__range") == F.col("__r")
        for k, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
        joined = summed.join(theirs, same).drop("__r", *(f"__g{k}" for k in range(len(group))))
    return joined.withColumn(out, F.col(out) + F.col("__before")).drop("__range", "__before")


def nearest_prefix(df: DataFrame, chars: str, order: list[str], target: Column, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of the ordered prefix whose sum is nearest to the target: the row that crosses it stays only if that is strictly
    nearer than without it, and the first row always stays. All rows if their sum is no more than the target. With ``group``,
    of each group; the target may be a column."""
    summed = running_sum(df, chars, order, "__run", group)
    before = F.col("__run") - F.coalesce(F.col(chars), F.lit(0))
    crossing = (F.col("__run") >= target) & (before < target)
    keep = (F.col("__run") < target) | (crossing & ((before == 0) | (F.abs(target - F.col("__run")) < F.abs(target - before))))
    return summed.where(keep | (F.col("__run") <= target)).drop("__run")
