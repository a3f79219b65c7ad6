"""Manifests against the live corpus: digests, sync plans, backlogs, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def corpus_digest(files: DataFrame, path: str = "essay_path", hash_: str = "content_hash") -> DataFrame:
    """One row, digest: of the set of path:hash lines, whatever their order.

    Each line's SHA-256 is cut into four numbers, these are summed over all lines, and the sums are hashed again: a sum
    needs no sorted list of the whole corpus in one place. An empty corpus has a digest too.
    """
    line = F.sha2(F.concat(path, F.lit(":"), hash_), 256)
    parts = files.select(*[F.conv(F.substring(line, 16 * i + 1, 15), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(4)])
    sums = parts.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"p{i}"), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)])
    return sums.select(F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(":", F.col("n").cast("string"), *[f"s{i}" for i in range(4)]), 256)).alias("digest"))


def to_process(manifest: DataFrame, live: DataFrame) -> DataFrame:
    """Live files that are new or changed. With no manifest rows these are all of them."""
    known = manifest.select("essay_path", F.col("content_hash").alias("known_hash"))
    return live.join(known, "essay_path", "left").where(~F.col("content_hash").eqNullSafe(F.col("known_hash"))).select("essay_path", "content_hash")


def removed(manifest: DataFrame, live: DataFrame) -> DataFrame:
    return manifest.select("essay_path").join(live, "essay_path", "left_anti")


def is_stale(manifest: DataFrame, live: DataFrame, has_digest: bool = True) -> DataFrame:
    """One row, stale: whether a path is missing, changed or new; not with an empty corpus, always without a digest."""
    both = manifest.select("essay_path", F.col("content_hash").alias("m")).join(live.select("essay_path", F.col("content_hash").alias("l")), "essay_path", "full_outer")
    flags = both.agg(F.coalesce(F.bool_or(~F.col("m").eqNullSafe(F.col("l"))), F.lit(False)).alias("differs"), F.count("l").alias("n"))
    return flags.select((F.lit(not has_digest) | (F.col("n") > 0) & F.col("differs")).alias("stale"))


def sync_plan(manifest: DataFrame, live: DataFrame) -> DataFrame:
    """essay_path and action, process or remove."""
    return to_process(manifest, live).select("essay_path", F.lit("process").alias("action")).unionByName(removed(manifest, live).select("essay_path", F.lit("remove").alias("action")))


def backlog(entries: DataFrame, live: DataFrame) -> DataFrame:
    """essay_path, kind, old_total_chunks of each file that a backfill must act on."""
    both = entries.select("essay_path", F.col("content_hash").alias("m"), "total_chunks", "next_chunk_index").join(live.select("essay_path", F.col("content_hash").alias("l")), "essay_path", "full_outer")
    kind = F.when(F.col("m").isNull(), "embed_new").when(F.col("l").isNull(), "delete_removed").when(F.col("m") != F.col("l"), "reembed_changed").when(F.col("next_chunk_index") < F.col("total_chunks"), "embed_resume")
    old = F.when(kind.isin("delete_removed", "reembed_changed"), F.col("total_chunks"))
    return both.select("essay_path", kind.alias("kind"), old.cast("long").alias("old_total_chunks")).where("kind IS NOT NULL")


def backlog_flags(actions: DataFrame) -> DataFrame:
    """One row: archive_content_changed, drained."""
    changed = F.coalesce(F.bool_or(F.col("kind").isin("delete_removed", "reembed_changed")), F.lit(False))
    return actions.agg(changed.alias("archive_content_changed"), (F.count("*") == 0).alias("drained"))


def merge_cursors(remote: DataFrame, local: DataFrame) -> DataFrame:
    """The remote entries, with the local cursor where it is of the same content and further on."""
    ahead = local.select("essay_path", "content_hash", F.col("next_chunk_index").alias("local_next"), F.col("committed_chunks").alias("local_committed"))
    rows = remote.join(ahead, ["essay_path", "content_hash"], "left")
    take = F.coalesce(F.col("local_committed") > F.col("committed_chunks"), F.lit(False))
    pick = lambda far, near: F.when(take, F.col(far)).otherwise(F.col(near))
    return rows.select("essay_path", "content_hash", "total_chunks", pick("local_next", "next_chunk_index").alias("next_chunk_index"), pick("local_committed", "committed_chunks").alias("committed_chunks"))


def merged_status(remote: Column, local: Column) -> Column:
    from .sagas import STUCK

    return F.when(remote.isin(*STUCK) & (local == "batch_failed"), local).otherwise(remote)


def sampled_chunks(entries: DataFrame) -> DataFrame:
    """essay_path, chunk_index of the first, middle and last committed chunk of each file."""
    last = F.col("committed_chunks") - 1
    places = F.array_distinct(F.array(F.lit(0).cast("long"), F.floor(last / 2).cast("long"), last.cast("long")))
    return entries.where("committed_chunks > 0").select("essay_path", F.explode(places).alias("chunk_index"))


def verify(entries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sampled chunks of `entries` without a row in `vectors` (essay_path, chunk_index)."""
    return sampled_chunks(entries).join(vectors.select("essay_path", "chunk_index"), ["essay_path", "chunk_index"], "left_anti")


def rollup(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("files"), F.coalesce(F.sum("total_chunks"), F.lit(0)).alias("vector_count"), F.coalesce(F.sum("committed_chunks"), F.lit(0)).alias("committed_archive_vectors"))


def as_json(entries: DataFrame) -> DataFrame:
    return entries.select("essay_path", F.to_json(F.struct("content_hash", "total_chunks", "next_chunk_index", "committed_chunks")).alias("payload"))


def from_json(payloads: DataFrame) -> DataFrame:
    """Entries back from JSON; unreadable ones and missing fields get defaults."""
    got = F.from_json("payload", "content_hash string, total_chunks long, next_chunk_index long, committed_chunks long")
    rows = payloads.select("essay_path", got.alias("e"))
    return rows.select("essay_path", F.coalesce("e.content_hash", F.lit("")).alias("content_hash"), *[F.coalesce(f"e.{c}", F.lit(0)).cast("long").alias(c) for c in ("total_chunks", "next_chunk_index", "committed_chunks")])
