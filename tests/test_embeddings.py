import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import backfill, chunking, embeddings, models, sync
from sparkloom.sources.tables import VersionedTable


def counting(folder):
    """An embedder that notes each text it was given, in files that test and workers share."""
    os.makedirs(folder, exist_ok=True)

    def embed(texts):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return models.tracing_embedder(texts)

    return embed


def given(folder):
    return sorted(line for name in os.listdir(folder) for line in open(f"{folder}/{name}").read().split("\n") if line)


def essays(spark, *rows):
    return spark.createDataFrame([(f"content/posts/examined/{n}.mdx", body) for n, body in rows], "essay_path string, body string")


def test_each_distinct_text_once_and_whole(spark, tmp_path):
    calls, kept = str(tmp_path / "calls"), embeddings.store(spark, str(tmp_path / "kept"), 4)
    long = " ".join(f"word{i}" for i in range(480)) + " last"
    chunks = chunking.chunks(essays(spark, ("a", long), ("b", long), ("c", "short text"), ("d", None)))
    got = embeddings.payloads(chunks, counting(calls), kept).select("metadata.essay_path", "vector", F.length("metadata.text").alias("cut")).collect()
    assert len(long) > 2000 and given(calls) == sorted([long, "short text"])
    assert {r["essay_path"][-5:-4]: tuple(r["vector"]) for r in got} == {"a": (len(long), 4, ord("t")), "b": (len(long), 4, ord("t")), "c": (10, 4, ord("t"))}
    assert max(r["cut"] for r in got) == 2000
    more = chunking.chunks(essays(spark, ("e", "short text"), ("f", "new text")))
    assert {tuple(r["vector"]) for r in embeddings.payloads(more, counting(calls), kept).collect()} == {(10, 4, ord("t")), (8, 4, ord("t"))}
    assert given(calls) == sorted([long, "short text", "new text"])
    embeddings.payloads(more, counting(calls), kept, model="other").count()
    assert given(calls).count("short text") == 2


def test_sync_and_backfill_share_vectors(spark, tmp_path):
    calls, kept = str(tmp_path / "calls"), embeddings.store(spark, str(tmp_path / "kept"), 4)
    tables = {n: VersionedTable(spark, str(tmp_path / n), k, 4) for n, k in (("v", "id"), ("m", "essay_path"), ("b", "essay_path"))}
    sync.run_sync(essays(spark, ("a", "one text"), ("b", "two text")), tables["v"], tables["m"], counting(calls), kept=kept)
    archive = spark.createDataFrame([("content/posts/unfolding/gemini-2030.mdx", "one text"), ("content/posts/unfolding/gemini-2031.mdx", "three text")], "essay_path string, body string")
    sync.run_backfill(archive, tables["v"], tables["b"], counting(calls), backfill.WriteBudget(), kept=kept)
    assert given(calls) == ["one text", "three text", "two text"]
    assert all(np.isfinite(r["vector"]).all() for r in tables["v"].read().collect()) and tables["v"].read().count() == 4


def test_backfill_takes_up_a_local_manifest(spark, tmp_path):
    vectors, manifest = (VersionedTable(spark, str(tmp_path / n), k, 4) for n, k in (("v", "id"), ("m", "essay_path")))
    archive = spark.createDataFrame([("content/posts/unfolding/gemini-2030.mdx", " ".join(["w"] * 1300))], "essay_path string, body string")
    budget = backfill.WriteBudget(write_budget=6)
    sync.run_backfill(archive, vectors, manifest, models.tracing_embedder, budget)
    header, entries = sync.read(manifest, sync.BACKFILL_DEFAULTS, sync.BACKFILL_ENTRY)
    assert entries.first()["committed_chunks"] == 1
    ahead = entries.withColumn("next_chunk_index", F.lit(2).cast("long")).withColumn("committed_chunks", F.lit(2).cast("long"))
    after = sync.run_backfill(archive, vectors, manifest, models.tracing_embedder, budget, local=({"status": "batch_failed"}, ahead))
    assert after["committed_archive_vectors"] == 3 and after["last_run"]["chunks_upserted"] == 1
    assert sync.merged({"status": "batch_running"}, entries, {"status": "batch_failed"}, ahead)[0]["status"] == "batch_failed"
