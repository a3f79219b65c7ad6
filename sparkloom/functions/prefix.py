"""Running totals over a global order without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.scratch import stored


def with_running_total(df: DataFrame, order: list[str], value: str, out: str = "prior_total") -> DataFrame:
    """`df` with `out`, the sum of `value` over all rows before in `order` (which must be unique).

    Rows are dealt by ranges of the order and written, so that ranges stay put; each range is summed on its own, and one
    row a range is added up to give the ranges' offsets.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    offsets = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__offset"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__within", within).join(F.broadcast(offsets), "__range").withColumn(out, F.col("__within") + F.col("__offset")).drop("__range", "__within", "__offset")
