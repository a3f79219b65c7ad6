import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import backfill, models, sync
from sparkloom.sources.tables import VersionedTable
from sparkloom.streaming import backfill as stream
from sparkloom.streaming import ledger


def asked(spark, folder, name, *rows):
    data = pd.DataFrame([(pd.Timestamp(at), request, chunks) for at, request, chunks in rows], columns=["at", "request", "chunks"])
    spark.createDataFrame(data, ledger.ASK).coalesce(1).write.parquet(f"{folder}/asks/{name}")


def settled(spark, folder, daily):
    """Runs the ledger over what has been asked since, and all that it has said so far."""
    stream_ = spark.readStream.schema(ledger.ASK).option("maxFilesPerTrigger", 1).parquet(f"{folder}/asks/*")
    with ledger.state_in_rocks(spark):
        query = ledger.grants(stream_, daily, "1 second").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r["day"], r["request"] or "", r["granted"], r["spent"], r["closed"]) for r in spark.read.parquet(f"{folder}/out").collect())


def test_a_day_is_one_budget(spark, tmp_path):
    folder = str(tmp_path)
    asked(spark, folder, "a", ("2026-01-01T01:00:00", "r2", 7), ("2026-01-01T00:30:00", "r1", 5))
    assert settled(spark, folder, 10) == [("2026-01-01", "r1", 5, 5, False), ("2026-01-01", "r2", 5, 10, False)]
    asked(spark, folder, "b", ("2026-01-01T02:00:00", "r3", 4), ("2026-01-01T02:00:00", "r1", 5))  # r1 comes again
    got = settled(spark, folder, 10)
    assert ("2026-01-01", "r3", 0, 10, False) in got and got.count(("2026-01-01", "r1", 5, 10, False)) == 1
    asked(spark, folder, "c", ("2026-01-02T03:00:00", "s1", 4))
    asked(spark, folder, "d", ("2026-01-03T05:00:00", "t1", 40))
    got = settled(spark, folder, 10)
    assert ("2026-01-02", "s1", 4, 4, False) in got and ("2026-01-03", "t1", 10, 10, False) in got
    assert ("2026-01-01", "", 0, 10, True) in got  # the timer has closed the first day


def test_daily_stream(spark, tmp_path):
    now = ["2026-01-01T08:00:00.000Z"]
    tables = {n: VersionedTable(spark, str(tmp_path / n), k, 4) for n, k in (("v", "id"), ("m", "essay_path"), ("c", "essay_path"))}
    source, budget = str(tmp_path / "in"), backfill.WriteBudget(write_budget=9)  # four chunks a day

    def arrive(year, words):
        body = " ".join(f"w{i}" for i in range(words))
        spark.createDataFrame([(f"content/posts/unfolding/gemini-20{year}.mdx", body)], "essay_path string, body string").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream.start_daily(spark, source, tables["v"], tables["m"], tables["c"], str(tmp_path / "cp"), models.tracing_embedder, budget, files_per_batch=1, clock=lambda: now[0])
        header, entries = sync.read(tables["m"], sync.BACKFILL_DEFAULTS, sync.BACKFILL_ENTRY)
        return (0 if tables["v"].read() is None else tables["v"].read().count()), header["status"]

    arrive(30, 1300)  # three chunks
    arrive(31, 900)  # two
    arrive(32, 900)  # two
    assert run() == (4, "backlog_pending")  # three batches of one day
    now[0] = "2026-01-01T20:00:00.000Z"
    assert run() == (4, "backlog_pending")  # the same day has nothing left
    now[0] = "2026-01-02T08:00:00.000Z"
    assert run() == (7, "backlog_complete")  # a new day, without files
    before, version = tables["m"].meta(), tables["v"].version()
    again = sync.run_backfill(tables["c"].read().select("essay_path", "body"), tables["v"], tables["m"], models.tracing_embedder, budget, clock=lambda: now[0], request=before["requests"][0])
    assert again["requests"] == before["requests"] and tables["v"].version() == version  # a batch that is repeated


def test_the_later_file_counts(spark):
    rows = spark.createDataFrame([("a", "zzz", 1, "f1"), ("a", "new", 2, "f2"), ("b", "x", 5, "f1"), ("b", "y", 5, "f9"), ("b", "z", 5, "f3")], "essay_path string, body string, t int, written_in string")
    got = stream.latest(rows.withColumn("written_at", F.timestamp_seconds("t")))
    assert {r["essay_path"]: r["body"] for r in got.collect()} == {"a": "new", "b": "y"}


def test_groups_of_keys_share_a_bucket(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), buckets=64, cut=r"#\d+$", spread=2)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    table.upsert(rows(*[(f"e{i}#{j}", j) for i in range(200) for j in range(3)]))
    table.upsert(rows(*[("e7#0", 5), ("e7#1", 5), ("e7#9", 5)]))
    assert len(set(table.pointer(2)["buckets"].items()) - set(table.pointer(1)["buckets"].items())) == 1
    assert table.read().count() == 601 and {"e7#0", "e7#2", "e7#9"} <= {r["id"] for r in table.beside(rows(("e7#0", 0))).collect()}
    with pytest.raises(ValueError):
        from sparkloom.sources.tables import appended

        appended(table, rows(("new#0", 1), ("new#0", 2)))
