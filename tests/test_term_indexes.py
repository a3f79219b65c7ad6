import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import postings, terms


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_words_within_two_edits_share_a_remainder(spark):
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randrange(1, 13))) for _ in range(150)} | {"é", "éé", "thesheaf", "x" * 400, "x" * 399 + "y"})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in terms.fuzzy_terms(df, df.select(F.col("word").alias("term"))).collect()}
    assert got == {(a, b) for a in words for b in words if edits(a, b) <= 2}
    assert terms.fuzzy_terms(df.limit(0), df.select(F.col("word").alias("term"))).count() == 0


def test_few_candidates_for_words_of_one_length(spark):
    draw = random.Random(4)
    words = spark.createDataFrame([("".join(draw.choice("abcdefghijklmnop") for _ in range(8)),) for _ in range(1500)], "word string")
    pairs = terms.fuzzy_candidates(words, words.select(F.col("word").alias("term")))
    assert pairs.count() < 1500 * 15  # a join by length compares 1500 * 1500


def documents(n=900):
    draw = random.Random(5)
    words = ["logicism", "logic", "idea", "ideal", "sheaf", "fold_x", "the", "operad-like", "unfold", "topos", "ÉTÉ", "Fold", "re-fold", "log", "ism"]
    return [(i, None if i % 50 == 9 else " ".join(draw.choice(words) for _ in range(draw.randrange(0, 6) if i % 3 else 0)), round(draw.random() * (30 if i % 7 == 0 else 1), 6)) for i in range(n)]


@pytest.mark.parametrize("k", [3, 40])
def test_top_documents_are_those_of_the_full_product(spark, k):
    docs = spark.createDataFrame(documents(), "doc long, body string, base double")
    asked = spark.createDataFrame([(1, ["sheaf", "logicism", "fold"]), (2, ["idealism"]), (3, ["nowhere"]), (4, []), (5, ["operad", "topos", "unfold", "idea", "sheaf"])], "query_id long, terms array<string>")
    index = postings.Postings(docs, asked.select(F.explode("terms").alias("term")))
    got = {(r["query_id"], r["rank"]): (r["doc"], round(r["score"], 6)) for r in index.top(asked, k).collect()}
    every = docs.join(asked.withColumnRenamed("query_id", "q"), how="cross").withColumn("s", F.col("base") + 10 * text.matching_terms(F.col("terms"), F.coalesce("body", F.lit(""))))
    want = {}
    for q in range(1, 6):
        rows = sorted((-round(r["s"], 6), r["doc"]) for r in every.where(F.col("q") == q).collect())[:k]
        want |= {(q, i + 1): (d, -s) for i, (s, d) in enumerate(rows)}
    assert got == want


def test_blocks_below_the_kth_score_stay_shut(spark):
    docs = spark.createDataFrame([(i, "sheaf" if i % 2 else "sheaf topos" if i < 100 else "none", 1000.0 - i) for i in range(4000)], "doc long, body string, base double")
    asked = spark.createDataFrame([(1, ["sheaf", "topos"])], "query_id long, terms array<string>")
    index = postings.Postings(docs, asked.select(F.explode("terms").alias("term")))
    assert [r["doc"] for r in index.top(asked, 5).orderBy("rank").collect()] == [0, 2, 4, 6, 8]
    assert index.bounds(asked).count() == 32 and index.opened.count() == 0  # 28 blocks are never opened


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc long, body string, base double")
    asked = spark.createDataFrame([(1, ["sheaf"])], "query_id long, terms array<string>")
    assert postings.Postings(docs, asked.select(F.explode("terms").alias("term"))).top(asked, 5).count() == 0
