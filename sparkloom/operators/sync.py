"""Syncs and backfills that write: vectors in one table, the manifest beside its entries in another."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.sources.scratch import discarded, stored
from sparkloom.sources.tables import VersionedTable, retried

from . import backfill, chunking, manifest, sagas
from .embeddings import payloads
from .models import Embedder

Clock = Callable[[], str]
TRIGGERS = ("deploy_postbuild", "manual", "ci")
#: What a manifest says before anything has been written.
SYNC_DEFAULTS = {"status": "no_index", "manifest_digest": None, "vector_count": 0, "last_sync_at": None, "last_error": None, "last_job": None}
BACKFILL_DEFAULTS = {"status": "backlog_pending", "provider_daily_cap": 10_000, "write_budget": 9_500, "committed_archive_vectors": 0, "last_run": None, "updated_at": None}
#: So many names of requests a manifest remembers; a day has fewer.
REQUESTS = 10_000
SYNC_ENTRY = "essay_path string, content_hash string, total_chunks long"
BACKFILL_ENTRY = f"{SYNC_ENTRY}, next_chunk_index long, committed_chunks long"


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def run_id(now: str) -> str:
    """The day of a stamp and something of its own."""
    return f"{now[:10]}-{uuid.uuid4().hex[:8]}"


def read(table: VersionedTable, defaults: dict, schema: str) -> tuple[dict, DataFrame]:
    """A manifest's header, missing keys filled in, and its entries."""
    rows = table.read()
    return {**defaults, **table.meta()}, table.spark.createDataFrame([], schema) if rows is None else rows


def chunk_ids(rows: DataFrame, start: Column, stop: Column) -> DataFrame:
    """id of the chunks start to stop, without stop, of each row's essay_path."""
    return rows.select(F.explode(paths.id_range(paths.slug(F.col("essay_path")), start, stop)).alias("id"))


def plan_sync(header: dict, entries: DataFrame, live: DataFrame) -> dict:
    """digest, event, files, skip, and the paths to process and those removed as tables (empty where it is skipped)."""
    digest = manifest.corpus_digest(live).first()["digest"]
    known, current = header["manifest_digest"], header["status"] == "index_current"
    lits = [F.lit(x) for x in (False, False)] + [F.lit(header["status"]), F.lit(known is not None and known != digest), F.lit(known == digest)]
    event = entries.sparkSession.range(1).select(sagas.sync_event(*lits).alias("e")).first()["e"]
    fresh = known is None or header["status"] == "no_index"
    todo = live.select("essay_path", "content_hash") if fresh else manifest.to_process(entries, live)
    gone = manifest.removed(entries, live)
    skip = current and known == digest
    return {"digest": digest, "event": event, "files": live.count(), "skip": skip, "to_process": todo.limit(0) if skip else todo, "removed": gone.limit(0) if skip else gone}


def run_sync(essays: DataFrame, vectors: VersionedTable, table: VersionedTable, embedder: Embedder, trigger: str = "manual", clock: Clock = utc_now, with_archives: bool = False, required: bool = True, kept: VersionedTable | None = None, model: str = "default") -> dict:
    """Bring vectors and manifest up to the essays (essay_path, body); the manifest's header afterwards.

    Files out of scope don't count. What is removed loses its chunks, what shrank its tail; the rest of a changed file is
    written over. The manifest says sync_running before the first write, and sync_failed with the error where one fails
    three times; that error is raised if the sync is required. A sync that is run again writes nothing. Bodies are read
    once for their hashes and those of new or changed files once more for their chunks. kept: vectors by content, so that
    texts which any run has embedded don't reach the model again.
    """
    if trigger not in TRIGGERS:
        raise ValueError(f"trigger must be one of {', '.join(TRIGGERS)}")
    header, entries = read(table, SYNC_DEFAULTS, SYNC_ENTRY)
    owned = essays.where(paths.in_scope(F.col("essay_path"), with_archives))
    live = stored(owned.select("essay_path", backfill.manifest_hash(F.col("body")).alias("content_hash")))
    plan = plan_sync(header, entries, live)
    if plan["skip"]:
        discarded(live)
        return header
    now = clock()
    job = {"job_id": run_id(now), "trigger": trigger, "started_at": now, "finished_at": None, "state": "sync_running", "files_scanned": plan["files"], "chunks_written": 0, "chunks_deleted": 0, "error_stage": None}
    header |= {"status": "sync_running", "last_job": job, "last_error": None}
    stage = "scan"
    try:
        retried(lambda: table.describe(header))
        todo, gone = stored(plan["to_process"]), stored(plan["removed"].join(entries, "essay_path"))
        stage = "chunk"
        chunks = stored(chunking.chunks(owned.join(todo.select("essay_path"), "essay_path", "left_semi")))
        sizes = chunking.chunk_counts(chunks)
        after = todo.join(sizes, "essay_path", "left").select("essay_path", "content_hash", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("total_chunks"))
        after = stored(after)
        shrunk = after.select("essay_path", F.col("total_chunks").alias("new_total")).join(entries.select("essay_path", "total_chunks"), "essay_path")
        dead = stored(chunk_ids(gone, F.lit(0).cast("long"), F.col("total_chunks")).unionByName(chunk_ids(shrunk, F.col("new_total"), F.col("total_chunks"))))
        stage = "upsert"
        retried(lambda: vectors.delete(dead))
        stage = "embed"
        rows = stored(payloads(chunks, embedder, kept, model))
        stage = "upsert"
        retried(lambda: vectors.upsert(rows))
        others = entries.join(gone.select("essay_path"), "essay_path", "left_anti").join(after.select("essay_path"), "essay_path", "left_anti")
        entries_now = stored(others.select(*after.columns).unionByName(after))
        total, written = (t.agg(F.coalesce(F.sum("total_chunks"), F.lit(0))).first()[0] for t in (entries_now, after))
        done = clock()
        job |= {"state": "index_current", "finished_at": done, "chunks_written": int(written), "chunks_deleted": dead.count()}
        header |= {"status": sagas.next_state("embed", "sync_running", "sync_complete"), "manifest_digest": plan["digest"], "vector_count": int(total), "last_sync_at": done, "last_job": job}
        retried(lambda: table.replace(entries_now, header))
        discarded(live, todo, gone, chunks, after, dead, rows, entries_now)
    except Exception as error:
        job |= {"state": "sync_failed", "finished_at": clock(), "error_stage": stage}
        header |= {"status": sagas.next_state("embed", "sync_running", "sync_error"), "last_error": str(error)[:2000], "last_job": job}
        _noted(table, header)
        if required:
            raise
    return header


def _noted(table: VersionedTable, header: dict) -> None:
    """Say how a run failed; if even that can't be written, the run's own error is the one to be seen."""
    try:
        retried(lambda: table.describe(header))
    except Exception:  # noqa: BLE001
        pass


def merged(header: dict, entries: DataFrame, local_header: dict, local_entries: DataFrame) -> tuple[dict, DataFrame]:
    """A remote manifest with a local one's cursors, and its status where that says that the last batch failed."""
    status = entries.sparkSession.range(1).select(manifest.merged_status(F.lit(header["status"]), F.lit(local_header.get("status"))).alias("s")).first()["s"]
    return {**header, "status": status}, stored(manifest.merge_cursors(entries, local_entries))


def run_backfill(essays: DataFrame, vectors: VersionedTable, table: VersionedTable, embedder: Embedder, budget: backfill.WriteBudget, clock: Clock = utc_now, only: DataFrame | None = None, trigger: str = "schedule", local: tuple[dict, DataFrame] | None = None, kept: VersionedTable | None = None, model: str = "default", request: str | None = None) -> dict:
    """One day's batch over the archives among essays (essay_path, body); the manifest's header afterwards.

    Deletions come first, from the end of removed and changed files, then the pending chunks in path order, as far as
    the budget reaches; the manifest's entries say how far each file has come, so that the next run goes on from there.
    A run that died or failed is taken up again. only: a table of the paths that the run is restricted to. local: header
    and entries of a manifest beside this machine, whose cursors count where they are of the same content and further on.
    kept: vectors by content, as for a sync. request: a name under which the batch is run once, however often it is asked.
    """
    header, entries = read(table, BACKFILL_DEFAULTS, BACKFILL_ENTRY)
    if request is not None and request in header.get("requests", []):
        return header
    if local is not None:
        header, entries = merged(header, entries, *local)
    archives = essays.where(paths.is_year_archive(F.col("essay_path")))
    paths.assert_disjoint(archives)
    archives, mine = paths.allowed(archives, only), paths.allowed(entries, only)
    live = stored(archives.select("essay_path", backfill.manifest_hash(F.col("body")).alias("content_hash")))
    actions = stored(manifest.backlog(mine, live))
    flags = manifest.backlog_flags(actions).first()
    header |= {"provider_daily_cap": budget.provider_daily_cap, "write_budget": budget.write_budget}
    if flags["drained"]:
        if header["status"] != "backlog_complete":
            header |= {"status": "backlog_complete", "updated_at": clock()}
            retried(lambda: table.describe(header))
        return header
    status = "batch_failed" if header["status"] in sagas.STUCK else header["status"]
    if status == "batch_failed":
        event = "batch_retry"
    elif status == "backlog_complete" or flags["archive_content_changed"]:
        event = "archive_content_changed"
    else:
        event = "daily_schedule"
    status = sagas.next_state("backfill", status, event)
    if status != "batch_running":
        status = sagas.next_state("backfill", status, "daily_schedule")
    now, meter = clock(), backfill.BudgetMeter(budget)
    run = {"run_id": run_id(now), "trigger": "retry" if event == "batch_retry" else trigger, "started_at": now, "finished_at": None, "state": status, "chunks_upserted": 0, "chunks_deleted": 0, "budget_spent": 0, "cursor_before": header["committed_archive_vectors"], "cursor_after": None, "error_stage": None, "error_message": None}
    header |= {"status": status, "last_run": run, "updated_at": now}
    stage = "commit"
    try:
        retried(lambda: table.describe(header))
        meter.spend(bookkeeping=1)
        stage = "chunk"
        chunks = stored(chunking.chunks(archives.join(actions.select("essay_path"), "essay_path", "left_semi")))
        sizes = chunking.chunk_counts(chunks)
        plan = stored(backfill.plan_batch(actions, mine, sizes, budget))
        spent = plan.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("deletes_granted", "upserts_granted")]).first()
        meter.spend(chunks=spent["deletes_granted"] + spent["upserts_granted"])  # raises before anything is written
        stage = "commit"
        dead = stored(backfill.tail_ids(plan, mine))
        retried(lambda: vectors.delete(dead))
        stage = "embed"
        rows = stored(payloads(backfill.pending_chunks(plan, mine, chunks), embedder, kept, model))
        stage = "upsert"
        retried(lambda: vectors.upsert(rows))
        stage = "commit"
        rest = entries if only is None else entries.join(only.select("essay_path").distinct(), "essay_path", "left_anti")
        now_mine = stored(backfill.advanced(mine, live, plan, sizes))
        drained = manifest.backlog_flags(manifest.backlog(now_mine, live)).first()["drained"]
        entries_now = stored(rest.select(*now_mine.columns).unionByName(now_mine)) if only is not None else now_mine
        committed = manifest.rollup(entries_now).first()["committed_archive_vectors"]
        status = sagas.next_state("backfill", sagas.next_state("backfill", "batch_running", "batch_upsert_ok"), "backlog_drained" if drained else "backlog_remaining")
        meter.spend(bookkeeping=1)
        run |= {"state": status, "finished_at": clock(), "chunks_upserted": spent["upserts_granted"], "chunks_deleted": spent["deletes_granted"], "budget_spent": meter.spent, "cursor_after": int(committed)}
        header |= {"status": status, "committed_archive_vectors": int(committed), "last_run": run, "updated_at": run["finished_at"]}
        if request is not None:
            header["requests"] = [*header.get("requests", [])[1 - REQUESTS :], request]
        retried(lambda: table.replace(entries_now, header))
        discarded(live, actions, chunks, plan, dead, rows, now_mine, *([] if only is None else [entries_now]))
    except Exception as error:
        run |= {"state": "batch_failed", "finished_at": clock(), "budget_spent": meter.spent, "error_stage": stage, "error_message": str(error)[:2000]}
        header |= {"status": sagas.next_state("backfill", "batch_running", "batch_error"), "last_run": run}
        _noted(table, header)
        raise
    return header
