"""Global order without a single task: ranges, and offsets by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_index(df: DataFrame, order: Sequence[str], out: str, add: str | None = None) -> DataFrame:
    """Add each row's number from 0 in the given order, or the sum of column ``add`` over all rows before it.

    Rows are dealt to ranges and ordered there; a range's offset is a sum over the ranges before it, one row
    for each. ``order`` must tell all rows apart for a result that's the same each time.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
    step = F.lit(1) if add is None else F.col(add)
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("__inside", F.coalesce(F.sum(step).over(before), F.lit(0)))
    sums = dealt.groupBy(F.col("__range").alias("__r")).agg(F.sum(step).alias("__sum"))
    every = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of n ranges
    offsets = sums.select("__r", F.coalesce(F.sum("__sum").over(every), F.lit(0)).alias("__offset"))
    placed = inside.join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return placed.withColumn(out, (F.col("__inside") + F.col("__offset")).cast("bigint")).select(*df.columns, out)
