"""Tables that cut a plan's lineage, in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local master may leave it unset: executors elsewhere don't see
    a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet below spark.checkpoint.dir and read back."""
    spark = df.sparkSession
    path = f"{base_dir(spark)}/sparkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_scratch_path", None)
        if path:
            where = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
