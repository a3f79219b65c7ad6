"""Budget-limited, resumable backfills: the budget, who gets how much of it, and one batch from start to end."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions.prefix import with_running_total

from . import chunking, manifest, sagas

RESERVE = 5


@dataclass(frozen=True)
class WriteBudget:
    """Writes a day: what the provider takes, what may be spent, what bookkeeping keeps back."""

    provider_daily_cap: int = 10_000
    write_budget: int = 9_500
    bookkeeping_reserve: int = RESERVE

    def __post_init__(self):
        if self.write_budget >= self.provider_daily_cap:
            raise ValueError("the budget must stay below the provider's cap")
        if self.chunk_write_budget <= 0:
            raise ValueError("the budget leaves nothing for chunks")

    @property
    def chunk_write_budget(self) -> int:
        return self.write_budget - self.bookkeeping_reserve

    @classmethod
    def resolved(cls, env: Mapping[str, str], cap: str = "PROVIDER_DAILY_CAP", budget: str = "WRITE_BUDGET") -> WriteBudget:
        def positive(name: str, usual: int) -> int:
            raw = env.get(name, "").strip()
            if raw and not (raw.isdigit() and int(raw) > 0):
                raise ValueError(f"{name} must be a positive integer")
            return int(raw) if raw else usual

        return cls(positive(cap, cls.provider_daily_cap), positive(budget, cls.write_budget))


class BudgetMeter:
    """What a run has spent; spending more than there is raises before anything is written."""

    def __init__(self, budget: WriteBudget):
        self.budget, self.spent, self.chunks = budget, 0, 0

    @property
    def remaining(self) -> int:
        return self.budget.chunk_write_budget - self.chunks

    def spend(self, chunks: int = 0, bookkeeping: int = 0) -> None:
        if chunks > self.remaining or self.spent + chunks + bookkeeping > self.budget.write_budget:
            raise ValueError("over budget")
        self.spent, self.chunks = self.spent + chunks + bookkeeping, self.chunks + chunks


def allocated(pending: Column, prior: Column, budget: int) -> Column:
    return F.least(pending, F.greatest(F.lit(0), F.lit(budget) - prior))


def allocate(rows: DataFrame, budget: int, order: list[str], pending: str = "pending") -> DataFrame:
    """`rows` with `granted`: the budget goes to rows in order until it is spent."""
    return with_running_total(rows, order, pending).withColumn("granted", allocated(F.col(pending), F.col("prior_total"), budget).cast("long"))


def micro_batches(rows: DataFrame, order: list[str], size: int = 16) -> DataFrame:
    """`rows` with batch, the number of its batch of `size` rows in order."""
    return with_running_total(rows.withColumn("__one", F.lit(1)), order, "__one", "__before").withColumn("batch", F.floor(F.col("__before") / size).cast("long")).drop("__one", "__before")


def asked_for(actions: DataFrame, entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """essay_path, kind, and how many deletes and upserts each action takes.

    A removed file gives up all its chunks, a changed one only those beyond its new end; its own chunks are written anew.
    """
    rows = actions.join(sizes.select("essay_path", F.col("chunk_count").alias("new_total")), "essay_path", "left").join(entries.select("essay_path", "next_chunk_index"), "essay_path", "left")
    total = F.coalesce("new_total", F.lit(0))
    deletes = F.when(F.col("kind") == "delete_removed", F.col("old_total_chunks")).when(F.col("kind") == "reembed_changed", F.greatest(F.lit(0), F.col("old_total_chunks") - total)).otherwise(0)
    upserts = F.when(F.col("kind") == "delete_removed", 0).when(F.col("kind") == "embed_resume", F.greatest(F.lit(0), total - F.col("next_chunk_index"))).otherwise(total)
    return rows.select("essay_path", "kind", deletes.cast("long").alias("deletes"), upserts.cast("long").alias("upserts"))


def plan_batch(actions: DataFrame, entries: DataFrame, sizes: DataFrame, budget: WriteBudget) -> DataFrame:
    """essay_path, kind, deletes, upserts and what is granted of each: deletes first, then files in path order."""
    rows = asked_for(actions, entries, sizes)
    long = rows.select("essay_path", "kind", F.lit(0).alias("stage"), F.col("deletes").alias("pending")).unionByName(rows.select("essay_path", "kind", F.lit(1).alias("stage"), F.col("upserts").alias("pending")))
    granted = allocate(long, budget.chunk_write_budget, ["stage", "essay_path"])
    pick = lambda s: F.sum(F.when(F.col("stage") == s, F.col("granted")).otherwise(0))
    return rows.join(granted.groupBy("essay_path").agg(pick(0).alias("deletes_granted"), pick(1).alias("upserts_granted")), "essay_path")


def advanced(entries: DataFrame, live: DataFrame, plan: DataFrame, sizes: DataFrame) -> DataFrame:
    """The entries after a planned batch. A file whose deletes weren't all granted keeps its old hash for the next run."""
    now = plan.join(live.select("essay_path", F.col("content_hash").alias("new_hash")), "essay_path", "left").join(sizes.select("essay_path", F.col("chunk_count").alias("new_total")), "essay_path", "left")
    old = entries.join(now, "essay_path", "full_outer")
    whole = F.col("deletes_granted") == F.col("deletes")
    reset = F.col("kind").isin("embed_new", "reembed_changed") & whole
    gone = (F.col("kind") == "delete_removed") & whole
    next_ = F.when(reset, F.col("upserts_granted")).when(F.col("kind") == "embed_resume", F.col("next_chunk_index") + F.col("upserts_granted")).otherwise(F.col("next_chunk_index"))
    total = F.when(reset, F.col("new_total")).when(F.col("kind") == "delete_removed", F.col("total_chunks") - F.col("deletes_granted")).otherwise(F.col("total_chunks"))
    return old.where(~F.coalesce(gone, F.lit(False))).select("essay_path", F.when(reset, F.col("new_hash")).otherwise(F.col("content_hash")).alias("content_hash"), total.cast("long").alias("total_chunks"), next_.cast("long").alias("next_chunk_index"), F.least(next_, total).cast("long").alias("committed_chunks"))


def tail_ids(plan: DataFrame, entries: DataFrame) -> DataFrame:
    """id of the chunks that a planned batch deletes: the last ones of each file, as many as were granted."""
    rows = plan.where("deletes_granted > 0").join(entries.select("essay_path", "total_chunks"), "essay_path")
    ids = paths.id_range(paths.slug(F.col("essay_path")), F.col("total_chunks") - F.col("deletes_granted"), F.col("total_chunks"))
    return rows.select(F.explode(ids).alias("id"))


def pending_chunks(plan: DataFrame, entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that a planned batch writes: from each file's cursor on, as many as were granted."""
    rows = plan.where("upserts_granted > 0").join(entries.select("essay_path", "next_chunk_index"), "essay_path", "left")
    start = F.when(F.col("kind") == "embed_resume", F.col("next_chunk_index")).otherwise(0)
    wanted = rows.select("essay_path", start.alias("__from"), (start + F.col("upserts_granted")).alias("__to"))
    return chunks.join(wanted, "essay_path").where("chunk_index >= __from AND chunk_index < __to").drop("__from", "__to")


def run_batch(essays: DataFrame, entries: DataFrame, budget: WriteBudget) -> tuple[DataFrame, DataFrame, str]:
    """One batch over essays (essay_path, body): its plan, the entries after it and the status that it ends in."""
    live = essays.select("essay_path", manifest_hash(F.col("body")).alias("content_hash"))
    sizes = chunking.chunk_counts(chunking.chunks(essays))
    plan = plan_batch(manifest.backlog(entries, live), entries, sizes, budget)
    after = advanced(entries, live, plan, sizes)
    drained = manifest.backlog_flags(manifest.backlog(after, live)).first()["drained"]
    return plan, after, "backlog_complete" if drained else "backlog_pending"


def manifest_hash(body: Column) -> Column:
    from sparkloom.functions.text import content_hash, normalized

    return content_hash(normalized(body))


__all__ = ["BudgetMeter", "WriteBudget", "advanced", "allocate", "micro_batches", "plan_batch", "run_batch", "sagas"]
