from pyspark.sql import functions as F

from sparkloom.operators import conversations, paging
from sparkloom.sources.tables import VersionedTable


def test_a_conversation_goes_with_its_messages(spark, tmp_path):
    talks, said = (VersionedTable(spark, str(tmp_path / n), "id", 4) for n in ("c", "m"))
    talks.upsert(spark.createDataFrame([(f"c{i}", "t") for i in range(4)], "id string, title string"))
    said.upsert(spark.createDataFrame([(f"m{i}{j}", f"c{i}", j) for i in range(4) for j in range(3)], "id string, conversation_id string, ord int"))
    conversations.forgotten(talks, said, spark.createDataFrame([("c1",), ("c1",), ("c3",), ("none",)], "id string"))
    left = said.read()
    assert sorted(r["id"] for r in talks.read().collect()) == ["c0", "c2"]
    assert sorted(r["id"] for r in left.collect()) == [f"m{i}{j}" for i in (0, 2) for j in range(3)]
    keys = talks.read().select(F.col("id").alias("conversation_id"))
    assert conversations.orphans(left, keys).count() == 0
    assert conversations.orphans(left, keys.where("conversation_id = 'c0'")).count() == 3


def test_meta_of_the_model_that_wrote(spark):
    df = spark.createDataFrame([(("index_current", None, None, None),)], "m struct<index_status: string, llm_provider: string, llm_model: string, llm_fallback: boolean>")
    got = df.select(conversations.merged_meta(F.col("m"), F.lit("p"), F.lit("x"), F.lit(None).cast("boolean")).alias("m")).first()["m"]
    assert tuple(got) == ("index_current", "p", "x", False)


def test_pages_by_boundaries(spark, tmp_path):
    rows = [(c, o * 10, f"{c}-{o}") for c, n in (("a", 7), ("b", 3), ("c", 1)) for o in range(n)]
    schema = "conversation_id string, ord long, content string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "m"))
    said = spark.read.parquet(str(tmp_path / "m"))
    index = paging.marks(said, 3)
    assert sorted(map(tuple, index.select("conversation_id", "page", "first", "last").collect())) == [("a", 0, 0, 20), ("a", 1, 30, 50), ("a", 2, 60, 60), ("b", 0, 0, 20), ("c", 0, 0, 0)]
    one = paging.page(said, index, "a", 1)
    assert [r["content"] for r in one.orderBy("ord").collect()] == ["a-3", "a-4", "a-5"] and paging.page(said, index, "a", 9).count() == 0
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ord,3" in plan
    new = spark.createDataFrame([("a", 70, "a-7"), ("a", 80, "a-8"), ("a", 90, "a-9"), ("b", 30, "b-3"), ("d", 0, "d-0")], schema)
    every = said.unionByName(new)
    key = lambda df: sorted(map(tuple, df.select("conversation_id", "page", "first", "last").collect()))
    assert key(paging.extended(index, every, new, 3)) == key(paging.marks(every, 3))
    assert paging.marks(said.limit(0)).count() == 0
