import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import models, retrieve, terms
from sparkloom.operators.vector_index import VectorIndex


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<double>").repartition(4)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_index_finds_what_a_full_comparison_finds(spark, tmp_path):
    draw = np.random.default_rng(4)
    x = unit(np.repeat(draw.normal(size=(40, 20)), 100, axis=0) + 0.3 * draw.normal(size=(4000, 20)))
    rows = table(spark, x)
    sought = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    VectorIndex.built(rows.unionByName(spark.createDataFrame([(9999, None)], rows.schema)), str(tmp_path / "i"))
    index = VectorIndex.opened(spark, str(tmp_path / "i"))
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in retrieve.similar(sought, rows, 10).collect()}
    brute = {(q, int(v)) for q in range(0, 4000, 50) for v in np.lexsort((np.arange(4000), -np.round(x @ x[q], 6)))[:10]}
    assert set(exact) == brute
    got = index.search(sought, rows, 10).collect()
    assert len({(r["query_id"], r["vec_id"]) for r in got} & set(exact)) >= 0.95 * len(exact)
    assert all(exact.get((r["query_id"], r["vec_id"]), r["score"]) == r["score"] for r in got) and {r["rank"] for r in got} == set(range(1, 11))
    assert index.codec.probes < len(index.codec.coarse) / 2 and index.codec.short * 10 < 2000  # far from all cells and all vectors


def test_added_and_removed_vectors(spark, tmp_path):
    x = unit(np.random.default_rng(5).normal(size=(300, 9)))
    index = VectorIndex.built(table(spark, x[:200]), str(tmp_path / "i"), recall=0.999)
    index.add(table(spark, x[200:], 200))
    live = table(spark, x).where("vec_id <> 250")
    asked = spark.createDataFrame([("q", x[250].tolist()), ("r", x[220].tolist()), ("null", None)], "query_id string, vector array<double>")
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in index.search(asked, live, 1).collect()}
    assert set(found) == {("q", 1), ("r", 1)} and found["r", 1] == 220 and found["q", 1] != 250
    with pytest.raises(ValueError):
        VectorIndex.built(table(spark, x[:0]), str(tmp_path / "e"))


def test_similar_with_lengths_of_several_kinds_and_ties(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", None)], "vec_id string, vector array<float>")
    asked = spark.createDataFrame([(1, [2.0, 1.0]), (2, [3.0]), (3, None)], "query_id int, vector array<double>")
    got = sorted(map(tuple, retrieve.similar(asked, rows, 2).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == [(1, 1, "a", 2.0), (1, 2, "b", 2.0), (2, 1, "d", 3.0)]
    assert sorted(r["vec_id"] for r in retrieve.similar(asked, rows, floor=1.0).collect()) == ["a", "b", "c", "d"]


def test_retrieval_by_status(spark, tmp_path):
    meta = "struct<essay_slug: string, essay_path: string, heading: string, chunk_index: int, text: string>"
    texts = ["the coalgebra unfolds a stream", "cooking rice for two"]
    embed = models.hashed_embedder(16)
    rows = spark.createDataFrame([(f"{i}#0", embed([t])[0].tolist(), (f"/{i}", f"content/posts/examined/{i}.mdx", None, 0, t)) for i, t in enumerate(texts)], f"id string, vector array<float>, metadata {meta}")
    asked = spark.createDataFrame([(1, "what is a coalgebra")], "query_id int, query string")
    run = lambda status, stale, **more: retrieve.retrieval({"status": status, "manifest_digest": "d"}, stale, asked, rows, terms.glossary(spark), embed, "bi", **more)
    fine = run("index_current", False, rerank_model="ce", scorer=models.lexical_scorer, min_score=0.0, min_rerank=-1.0)
    assert fine.chunks.first()["vec_id"] == "0#0" and fine.ann_chunks.count() == 2
    assert fine.meta == {"index_status": "index_current", "manifest_digest": "d", "stale": False, "bi_encoder_model": "bi", "rerank_model": "ce", "rerank": True, "model": "ce"}
    stale = run("index_current", True, rerank_model="ce", min_score=0.0)
    assert stale.meta["index_status"] == "stale" and stale.meta["model"] == "bi" and stale.chunks.count() == 2
    for status in retrieve.WITHOUT_INDEX:
        none = run(status, True)
        assert none.chunks.count() == 0 and none.ann_chunks.count() == 0 and none.meta["index_status"] == status
    index = VectorIndex.built(rows, str(tmp_path / "i"), id_="id")
    assert run("index_current", False, min_score=0.0, index=index).chunks.first()["vec_id"] == "0#0"
    assert retrieve.confident(F.lit(0.6), False) is not None
    flags = spark.range(1).select(retrieve.confident(F.lit(0.6), False).alias("a"), retrieve.confident(F.lit(0.4), False).alias("b"), retrieve.confident(F.lit(0.0), True).alias("c"), retrieve.confident(F.lit(None).cast("double"), True).alias("d")).first()
    assert tuple(flags) == (True, False, True, False)


def on_disk(folder):
    """Bytes below the folder of shuffles and scratch tables."""
    import os

    sizes = 0
    for d, _, names in os.walk(folder):
        for name in names:
            try:
                sizes += os.path.getsize(os.path.join(d, name))
            except OSError:  # a file may go meanwhile
                pass
    return sizes


def test_searches_move_vectors_and_not_pairs(spark, tmp_path):
    x = unit(np.random.default_rng(6).normal(size=(6000, 16)))
    table(spark, x).write.parquet(str(tmp_path / "x"))
    rows = spark.read.parquet(str(tmp_path / "x"))
    sought = rows.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    index = VectorIndex.built(rows, str(tmp_path / "i"))
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = on_disk(folder)
    assert retrieve.similar(sought, rows, 10).count() == index.search(sought, rows, 10).count() == 30000
    assert on_disk(folder) - before < 10 * x.nbytes


def test_tiles_of_few_queries_and_many_equal_vectors(spark, tmp_path, monkeypatch):
    from sparkloom.operators import blocks

    monkeypatch.setattr(blocks, "QUERY_BYTES", 10_000)
    draw = np.random.default_rng(7)
    x = unit(draw.normal(size=(900, 6)))
    x[100:800] = x[0]
    names = [f"v{i:04d}" for i in draw.permutation(900)]
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, x, strict=True)], "vec_id string, vector array<float>").repartition(3)
    sought = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 100, 2)] + [(100, None), (101, []), (102, [1.0])], "query_id int, vector array<double>")
    tiles = blocks.dealt(sought, rows.withColumnRenamed("vec_id", "id"), 10, ("id",))
    assert tiles.select("tile").distinct().count() == 4
    want = set()
    for q in range(0, 100, 2):
        score = np.round(np.float32(x).astype(float) @ x[q], 6) + 0.0
        want |= {(q, rank + 1, names[v], score[v]) for rank, v in enumerate(sorted(range(900), key=lambda v: (-score[v], names[v]))[:10])}
    found = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in retrieve.similar(sought, rows, 10).collect()}
    assert found == want
    index = VectorIndex.built(rows, str(tmp_path / "i"), recall=1.0)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in index.search(sought, rows, 10).collect()}
    assert len(got) == 500 and len(got & want) >= 475
    assert {r for r in got if r[0] == 0} == {r for r in want if r[0] == 0}
