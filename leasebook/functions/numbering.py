"""Consecutive numbers for long keys of any distribution, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leasebook.sources.staging import stage


def number_rows(df: DataFrame, key: str, out: str) -> DataFrame:
    """Add `out` = 1, 2, 3 ... in ascending order of the long column `key`; a null key comes first.

    The distinct keys are dealt into ranges of about equal size and written with their range, so
    that a repeated task finds the same ranges. Ranks inside a range and the keys before it (one
    count a range) make the number. Rows that repeat a key get the same number.
    """
    ranged = stage(df.select(key).distinct().repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_keys"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_keys").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    numbers = ranged.withColumn("_rank", rank).join(starts, "_range").select(
        F.col(key).alias("_key"), (F.col("_start") + F.col("_rank")).alias(out))
    return df.join(numbers, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
