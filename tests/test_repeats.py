import random
import re
import time

from sparkloom.functions import repeats


def test_against_the_pattern():
    draw = random.Random(6)
    found = 0
    for _ in range(3000):
        unit = "".join(draw.choice("ab") for _ in range(draw.randrange(1, 30)))
        text = "".join(draw.choice("abé") for _ in range(draw.randrange(0, 20))) + unit * draw.randrange(1, 6) + unit[: draw.randrange(0, len(unit))] + "".join(draw.choice("ab") for _ in range(draw.randrange(0, 20)))
        want = re.search(r"([\s\S]{12,}?)\1{2,}", text) is not None
        assert repeats.tandem(text) == want, text
        found += want
    assert 500 < found < 2800
    assert not repeats.tandem(None) and not repeats.tandem("x" * 35) and repeats.tandem("x" * 36)


def test_long_texts_in_time():
    draw = random.Random(7)
    for text, want in (("x" * 1_000_000, True), ("".join(draw.choice("abcdefgh ") for _ in range(300_000)), False)):
        began = time.perf_counter()
        assert repeats.tandem(text) is want
        assert time.perf_counter() - began < (1 if want else 30)


def test_periods_of_any_length():
    draw = random.Random(8)
    unit = "".join(draw.choice("abcdefgh") for _ in range(5000))
    assert repeats.tandem("head" + unit * 3) and not repeats.tandem("head" + unit * 2 + unit[:-1]) and repeats.tandem("head" + unit * 3 + "tail" * 2)


def test_flaws_of_every_kind(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions import text

    def brute(t):
        t = (t or "").strip()
        low, words = re.sub(r"^\[\d+\]\s*", "", t), re.sub(r"^\[\d+\]\s*", "", t).lower().split()
        grams = [low.lower()[i : i + 18] for i in range(len(low) - 17)]
        return (len(low) < 8, bool(re.match(r"\[\d+\]", t)), re.search(r"([\s\S]{12,}?)\1{2,}", low) is not None, any(grams.count(g) >= 3 for g in set(grams)), len(words) >= 10 and len(set(words)) / len(words) < 0.4)

    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.substring("text", 1, 400).alias("text")).limit(150).collect()]
    rows += ["", "short", "[12] cited text stands here", "no no no no no no no no no no no no", "the same phrase again. " * 3, "x" * 36, "ab " * 40, "A fold consumes a structure while an unfold produces one."]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", text.flaws(F.col("t")).alias("f"), text.malformed(F.col("t")).alias("m")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (tuple(r["f"]), r["m"]) == (brute(rows[r["i"]]), any(brute(rows[r["i"]]))), rows[r["i"]]


def test_slices_of_texts_of_all_kinds(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    monkeypatch.setattr(repeats, "SLICE", 500)
    monkeypatch.setattr(repeats, "DOC_BITS", 3)
    draw = random.Random(9)
    texts = [None, "", "x" * 36, "é" * 36, "x" * 35, None]
    for n in range(1500):
        letters = draw.choice(["ab", "abcdefgh ", "aé€😀"])
        unit = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 40)))
        between = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 25))) for _ in range(4)]
        texts.append(between[0] + unit * draw.randrange(1, 4) + between[1] + unit * draw.randrange(0, 3) + between[2] + unit + between[3])
    whole = pa.array(["before", *texts])
    tandem = [re.search(r"([\s\S]{12,}?)\1{2,}", t or "") is not None for t in texts]
    again = [max(Counter((t or "")[i : i + 18] for i in range(max(1, len(t or "") - 17))).values()) >= 3 and len(t or "") >= 20 for t in texts]
    assert 100 < sum(tandem) < 1400 and 100 < sum(again) < 1400
    for given in (whole.slice(1), pa.array(texts, pa.large_string())):
        assert repeats._flagged(given, repeats._tandems).to_pylist() == tandem
        assert repeats._flagged(given, lambda part: repeats._come_again(part, 18, 3)).to_pylist() == again
    monkeypatch.setattr(repeats._Slice, "keys", lambda part, n: (lambda at, _: (at, part.text[at].astype("uint64")))(*part.hashed(n, repeats.np.uint64)))
    assert repeats._flagged(whole.slice(1), lambda part: repeats._come_again(part, 18, 3)).to_pylist() == again  # with one hash for all


def test_flaws_of_a_table_in_time(spark):
    """Against what takes each word of each text once: four times as long here, 28 times with a string for each place."""
    from pyspark.sql import functions as F

    from sparkloom.plans import text_queries

    at = "/root/testdata/sf0.1"
    words = lambda s, at: text_queries.table(s, at, "documents").select("doc_id", F.size(F.array_distinct(F.split(F.lower("text"), r"\s+"))))

    def took(query):
        began = time.perf_counter()
        query(spark, at).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    text_queries.generation_flaws(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    words(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    plain, flaws = max(took(words), took(words)), took(text_queries.generation_flaws)
    assert flaws < 10 * plain
