import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import fingerprints as fp
from sparkloom.llm import toxicity

from .helpers import documents_dir, rows, table


def like(a, b):
    if a == b:
        return 1.0
    if 0 in (int(a, 16), int(b, 16)):
        return 0.0
    return max(0.0, float(np.cos(np.pi * bin(int(a, 16) ^ int(b, 16)).count("1") / fp.BITS)))


def test_op8_against_brute_force(spark, tmp_path):
    data = [r for r in rows() if r[0] is not None][:-1]
    folder = documents_dir(table(spark, data), tmp_path)
    order = sorted(data, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fp.op8_fingerprints(spark, folder).collect()}
    assert len(got) == len(data)
    one = lambda t: fp.fingerprints(pa.array([t]))[0].tobytes().hex()
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        text, nxt = r[1] or "", n[1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        x = got[r[0]]
        assert (x["n_chars"], x["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (x["fingerprint"], x["edited_fingerprint"]) == (one(text), one(edited))
        assert 0 <= x["near_edited"] <= 1 and (x["near_next"] == 1) == (one(text) == one(nxt))
    values = {x["fingerprint"] for x in got.values()}
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    for key, x in got.items():
        near = sum(0 < far(x["fingerprint"], v) <= fp.RADIUS for v in values)
        assert x["near_found"] == (near if key % 20 == 0 else None)
        assert x["near_edited"] == pytest.approx(like(x["fingerprint"], x["edited_fingerprint"]))
    assert fp.edit_likeness(table(spark, [])).count() == 0
    assert fp.edit_likeness(table(spark)).count() == len(rows())
    assert fp.edit_likeness(table(spark, rows()[:1])).first()["near_next"] == 1.0


def test_votes_are_weighted_sums():
    text = "a b c a b c a b d"
    terms = ["a b", "b c", "c a", "b d"]
    counts = [3, 2, 2, 1]
    sums = np.zeros(fp.BITS)
    for t, n in zip(terms, counts, strict=True):
        bits = np.unpackbits(fp.fingerprints(pa.array([t]))[0]).astype(float) * 2 - 1
        sums += bits * (1 + np.log2(n))
    assert (np.unpackbits(fp.fingerprints(pa.array([text]))[0]) == (sums > 0)).mean() > 0.97


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    values = [bytes(b) for b in base]
    for b in base[:20]:
        for n in range(1, 6):
            bits = np.unpackbits(b)
            bits[rng.choice(128, n, replace=False)] ^= 1
            values.append(np.packbits(bits).tobytes())
    hexed = [v.hex() for v in values]
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {(a, b, far(a, b)) for a in set(hexed) for b in set(hexed) if 0 < far(a, b) <= 3}
    df = spark.createDataFrame([(h,) for h in hexed + hexed[:5] + [None]], "fingerprint string")
    assert {tuple(r) for r in fp.near_fingerprints(df, df, 3).collect()} == want


def test_op10_learns_only_from_its_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        words = list(rng.choice(plain, 40))
        toxic = i % 6 == 0
        if toxic:
            words[::10] = rng.choice(["vilest", "nastyword"], 4)
        docs.append((i, " ".join(words), "en", "s", 1, 1, ""))
        labels.append((i, 1, int(toxic)))
    docs += [(None, None, None, None, None, None, None), (1001, "", "en", "s", 1, 1, "")]
    folder = documents_dir(table(spark, docs), tmp_path)
    schema = "doc_id long, quality int, toxic int"
    spark.createDataFrame(labels, schema).write.parquet(f"{folder}/labels.parquet")
    got = toxicity.op10_toxicity(spark, folder).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a = toxicity.train(table(spark, docs), spark.createDataFrame(labels, schema))
    b = toxicity.train(table(spark, docs), spark.createDataFrame(flipped, schema))
    assert (a.weights == b.weights).all() and a.bias == b.bias
    assert toxicity.train(table(spark, docs), spark.createDataFrame([], schema)).score(pa.array(["x"]))[0] == 0


def test_nnpu_keeps_the_negative_part_up():
    rng = np.random.default_rng(0)
    p = (rng.random((200, 3)) < [0.9, 0.5, 0.1]).astype(np.float32)
    u = (rng.random((2000, 3)) < [0.3, 0.5, 0.5]).astype(np.float32)
    w, _ = toxicity.fit_nnpu(p, u, 0.3)
    assert w[0] > 1 and w[2] < 0 and np.isfinite(w).all()


def test_copies_are_sampled_row_by_row(spark, monkeypatch):
    drawn = []
    fit = toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "UNLABELLED", 300)
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda p, u, prior: drawn.append(u) or fit(p, u, prior))
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 30 == 1
        text = "one vilest text in a third of the rows" if i % 3 == 0 else " ".join(rng.choice(["some", "other", "plain", "words"], 6)) + f" n{i}" + " vilest" * toxic
        docs.append((i, text, "en", "s", 1, 1, ""))
        labels.append((i, 1, int(toxic)))
    model = toxicity.train(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    place = np.searchsorted(model.hashes, toxicity.features(pa.array(["vilest"]))[1][-1])
    assert len(drawn[0]) == 300 and 0.25 < drawn[0][:, place].mean() < 0.48


def test_every_byte_of_long_runs_takes_part():
    of = lambda t: set(toxicity.features(pa.array([t]))[1].tolist())
    for text in ("x" * 70 + "a1b2c3" + "y" * 5, "这是一个没有空格的很长很长的句子里面有坏话在最后面", "ข้อความภาษาไทยที่ไม่มีช่องว่างเลยสักที่เดียว"):
        for at in range(len(text)):
            assert of(text) != of(text[:at] + "é" + text[at + 1 :])
    for sign in "\u00a0\u3000。、，！—…“”«»":
        assert of(f"first{sign}second") == of("first second")
    assert of("œuvre") != of("uvre") and of("人々") != of("人")
    shared = of("在前面" * 8 + "坏话在最后") & of("坏话在")
    assert len(shared) >= 1  # found within a run as at the beginning of a word
    many = ["plain words", "x" * 50, "", "last 一二三四五六七八九十一二三四五"]
    doc, hashes = toxicity.features(pa.array(many))
    assert [set(hashes[doc == i].tolist()) for i in range(4)] == [of(t) for t in many]


def test_rare_telling_words_become_features(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(rng.choice(["some", "other", "plain", "words"], 6)), "en", "s", 1, 1, "") for i in range(4500)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(4500)]
    learnt = [i for i, _, toxic in labels if toxic and zlib.crc32(str(i).encode()) % 3 != 1]
    for i in learnt[:3]:  # 0.3 % of about 1000 positive examples
        docs[i] = (i, docs[i][1] + " vilest", "en", "s", 1, 1, "")
    model = toxicity.train(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(learnt) > 900 and toxicity.features(pa.array(["vilest"]))[1][-1] in model.hashes
