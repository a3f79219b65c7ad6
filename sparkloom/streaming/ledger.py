"""A daily budget as streaming state: what a day has spent, and on whom, in however many micro-batches it is asked."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ASK = "at timestamp, request string, chunks long"
GRANT = "day string, request string, granted long, spent long, closed boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class DayLedger(StatefulProcessor):
    """One day's grants: each request once, in the order of time, until the day's chunks are spent.

    A request that comes again is told what it was granted, and nothing is spent. When the watermark has passed the end of
    the day, a timer reports what the day has spent and drops its state.
    """

    def __init__(self, daily: int) -> None:
        self.daily = daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "chunks long")
        self.granted = handle.getMapState("granted", "request string", "chunks long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        asks = pd.concat(list(rows)).sort_values(["at", "request"])
        known = self.spent.exists()
        spent = int(self.spent.get()[0]) if known else 0
        if not known:
            self.handle.registerTimer(int(pd.Timestamp(key[0]).timestamp() * 1000) + DAY_MS)
        out = []
        for request, chunks in zip(asks["request"], asks["chunks"], strict=True):
            if self.granted.containsKey((request,)):
                granted = int(self.granted.getValue((request,))[0])
            else:
                granted = max(0, min(int(chunks), self.daily - spent))
                spent += granted
                self.granted.updateValue((request,), (granted,))
            out.append((key[0], request, granted, spent, False))
        self.spent.update((spent,))
        yield pd.DataFrame(out, columns=["day", "request", "granted", "spent", "closed"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        spent = int(self.spent.get()[0]) if self.spent.exists() else 0
        self.spent.clear()
        self.granted.clear()
        yield pd.DataFrame([(key[0], None, 0, spent, True)], columns=["day", "request", "granted", "spent", "closed"])

    def close(self) -> None:
        pass


def grants(asks: DataFrame, daily: int, late: str = "1 hour") -> DataFrame:
    """day, request, granted, spent and closed for a stream of asks (at, request, chunks), with `daily` chunks for each day.

    Days are those of UTC. Asks that come later than `late` after the latest one's day has ended may find it closed.
    """
    keyed = asks.withWatermark("at", late).withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    return keyed.groupBy("day").transformWithStateInPandas(statefulProcessor=DayLedger(daily), outputStructType=GRANT, outputMode="Append", timeMode="EventTime")


@contextmanager
def state_in_rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep state in RocksDB, which stateful processors need; the setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
