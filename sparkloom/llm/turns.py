"""Turns of conversations in order, whatever share of the rows one conversation holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So much of a role or text takes part in the bounds of ranges, which Spark samples in the driver.
HEAD = 32


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")


def in_order(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text and more; roles and texts not null) dealt by ranges and sorted, with `at`.

    The order is that of conv_id, then turn (null first), then role and text, which only ties reach. A long conversation
    is cut between ranges. `at` grows along the order; its bits above the 33rd are the range's number. Ranges are cut by
    the beginnings of role and text only, so that no whole text gets into their bounds; rows that agree in them share one.
    """
    bounds = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, HEAD), F.when(F.length("role") <= HEAD, F.substring("text", 1, HEAD))]
    return turns.repartitionByRange(*bounds).sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id())
