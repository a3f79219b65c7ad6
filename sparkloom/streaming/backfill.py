"""The backfill as a stream: new essay files in, chunks and vectors upserted once each, whatever is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.functions import paths
from sparkloom.operators import chunking, embeddings, manifest, sync
from sparkloom.operators import backfill as batches
from sparkloom.operators.backfill import WriteBudget
from sparkloom.operators.models import Embedder
from sparkloom.sources.scratch import discarded, stored
from sparkloom.sources.tables import VersionedTable

from . import ledger


def incoming(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    """Essays of the Parquet files below `source`, with the time of their file."""
    stream = spark.readStream.schema("essay_path string, body string").option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.select("essay_path", "body", F.col("_metadata.file_modification_time").alias("written_at"), F.col("_metadata.file_path").alias("written_in"))


def latest(batch: DataFrame) -> DataFrame:
    """Of several versions of an essay the one of the latest file; of equally late files that with the greatest name."""
    return batch.groupBy("essay_path").agg(F.max_by("body", F.struct("written_at", "written_in", "body")).alias("body"), F.max("written_at").alias("written_at"))


def start(spark: SparkSession, source: str, table: VersionedTable, checkpoint: str, embedder: Embedder, files_per_batch: int = 100, kept: VersionedTable | None = None) -> StreamingQuery:
    """Process all Parquet files of essays below `source` that haven't been, then stop. The checkpoint is the cursor.

    Of an essay that comes again, the chunks beyond its new end go. kept: vectors by content.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        essays = stored(latest(batch))
        chunks = stored(chunking.chunks(essays))
        rows = stored(embeddings.payloads(chunks, embedder, kept))
        firsts = essays.select(paths.vector_id(paths.slug(F.col("essay_path")), F.lit(0)).alias("id"))
        old = table.beside(firsts)
        if old is not None:
            mine = old.join(essays.select("essay_path"), F.col("metadata.essay_path") == F.col("essay_path"), "left_semi")
            table.delete(mine.select("id").join(rows.select("id"), "id", "left_anti"))
        table.upsert(rows)
        discarded(essays, chunks, rows)

    return incoming(spark, source, files_per_batch).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def owed(corpus: VersionedTable, entries: VersionedTable) -> int:
    """How many chunks, written or deleted, the archives' backlog still asks for."""
    essays = corpus.read()
    if essays is None:
        return 0
    archives = essays.where(paths.is_year_archive(F.col("essay_path")))
    _, known = sync.read(entries, sync.BACKFILL_DEFAULTS, sync.BACKFILL_ENTRY)
    live = archives.select("essay_path", batches.manifest_hash(F.col("body")).alias("content_hash"))
    actions = stored(manifest.backlog(known, live))
    sizes = chunking.chunk_counts(chunking.chunks(archives.join(actions.select("essay_path"), "essay_path", "left_semi")))
    row = batches.asked_for(actions, known, sizes).agg(F.coalesce(F.sum(F.col("deletes") + F.col("upserts")), F.lit(0))).first()
    discarded(actions)
    return int(row[0])


def start_daily(spark: SparkSession, source: str, vectors: VersionedTable, entries: VersionedTable, corpus: VersionedTable, checkpoint: str, embedder: Embedder, budget: WriteBudget, files_per_batch: int = 100, clock: sync.Clock = sync.utc_now, kept: VersionedTable | None = None) -> StreamingQuery:
    """The same under a budget for each day: what it doesn't reach stays pending in the manifest `entries`.

    Files are merged into `corpus` (key essay_path) batch by batch. Each batch, and the call itself after them, asks for
    what the backlog owes; a second stream hands asks to a ledger with one state for each day, and each grant is one
    backfill. So all batches and calls of a day share its budget, a new day opens it again, and a day without files goes
    on with the backlog. A batch that is repeated asks under its own name, which the ledger and the manifest know.
    """
    asks = f"{checkpoint}/asks"

    def ask(request: str, now: str) -> None:
        chunks = owed(corpus, entries)
        row = spark.createDataFrame([(now, request, min(chunks, budget.chunk_write_budget))], "at string, request string, chunks long")
        row.select(F.to_timestamp("at").alias("at"), "request", "chunks").coalesce(1).write.mode("overwrite").parquet(f"{asks}/{request}")

    def spend(batch: DataFrame, _: int) -> None:
        for grant in batch.where("NOT closed AND granted > 0").orderBy("day", "request").collect():  # a row for each ask
            share = WriteBudget(budget.provider_daily_cap, grant["granted"] + budget.bookkeeping_reserve, budget.bookkeeping_reserve)
            sync.run_backfill(corpus.read().select("essay_path", "body"), vectors, entries, embedder, share, clock=clock, kept=kept, request=grant["request"])

    def settle() -> StreamingQuery:
        stream = spark.readStream.schema(ledger.ASK).parquet(f"{asks}/*")
        with ledger.state_in_rocks(spark):
            query = ledger.grants(stream, budget.chunk_write_budget).writeStream.foreachBatch(spend).option("checkpointLocation", f"{checkpoint}/ledger").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def merge(batch: DataFrame, epoch: int) -> None:
        corpus.upsert(latest(batch), order=F.col("written_at"))
        now = clock()
        ask(f"{now[:10]}-batch-{epoch:08d}", now)
        settle()  # what this batch is granted is spent before the next one asks

    incoming(spark, source, files_per_batch).writeStream.foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/files").trigger(availableNow=True).start().awaitTermination()
    now = clock()
    ask(f"{now[:10]}-call-{now.replace(':', '').replace('.', '')}", now)
    return settle()
