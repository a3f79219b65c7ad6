import hashlib
import re

import numpy as np
import pyarrow.compute as pc
import pytest

from sparkloom.llm import debruijn, repeats, substrings, suffixes

from .helpers import documents_dir, rows, table


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    words = [f"{c}{i}" for i in range(60) for c in "abé"]
    shared = [list(rng.choice(words, int(rng.integers(30, 160)))) for _ in range(5)]
    out = []
    for i in range(n):
        text = []
        for _ in range(int(rng.integers(0, 5))):
            text += list(rng.choice(words, int(rng.integers(1, 60))))
            if rng.random() < 0.7:
                part = list(shared[int(rng.integers(0, 5))])
                for _ in range(int(rng.integers(0, 3))):
                    part[int(rng.integers(0, len(part)))] = str(rng.choice(words))
                a = int(rng.integers(0, 10))
                text += part[a:]
        out.append(((i * 37) % 101, " ".join(map(str, text)), "en", "s", 1, 1, ""))
    out += [(500 + i, out[3][1], "en", "s", 1, 1, "") for i in range(3)]
    out += [(700, "ab " * 400, "en", "s", 1, 1, ""), (701, "x" * 700, "en", "s", 1, 1, ""), (702, "x" * 99, "en", "s", 1, 1, "")]
    return out


def brute_words(data, k=50):
    docs = sorted(((r[0], re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data), key=lambda d: d[0])
    first: dict = {}
    for key, words in docs:
        for i in range(len(words) - k + 1):
            first.setdefault(tuple(words[i : i + k]), key)
    out = {}
    for key, words in docs:
        gone = set()
        for i in range(len(words) - k + 1):
            if first[tuple(words[i : i + k])] < key:
                gone |= set(range(i, i + k))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[key] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def brute_bytes(data, k=100):
    docs = sorted(((r[0], (r[1] or "").encode()) for r in data), key=lambda d: d[0])
    seen: set = set()
    out = {}
    for key, raw in docs:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - k + 1):
            if raw[i : i + k] in seen:
                gone[i : i + k] = True
            seen.add(raw[i : i + k])
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        out[key] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_op2_and_op3_against_brute_force(spark, tmp_path, seed):
    data = [r for r in corpus(seed) + (rows() if seed == 1 else []) if r[0] is not None]
    data = list({r[0]: r for r in data}.values())
    folder = documents_dir(table(spark, data), tmp_path)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.op2_substrings(spark, folder).collect()}
    assert got == brute_words(data)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.op3_suffixes(spark, folder).collect()}
    assert got == brute_bytes(data)


def test_paths_between_junctions_and_coordinates_that_disagree(spark):
    passage = [f"w{i}" for i in range(200)]
    shared = " ".join(passage)
    one = " ".join([*passage[:60], "left", *passage[60:]])
    data = [(1, "a b c " + one), (2, one.replace("left", "right")), (3, one), (4, "x " + shared), (5, shared + " y z")]
    docs = repeats.tagged(spark.createDataFrame(data, "doc_id long, text string"))

    def collide(column):  # two words with one hash: their runs are one path, their words are not
        return substrings.words_of(pc.replace_substring(column, "right", "left"))

    args = docs, collide, 50, 16, 1 << 20
    samples = debruijn._samples(debruijn._runs(*args, names_only=True))
    again, _, _ = debruijn.compacted(docs, debruijn._runs(*args, names_only=False), samples, substrings.spaced_words, 50, 1 << 20)
    spans = [(r["doc"], r["start"] >> 24, r["stop"]) for r in again.orderBy("doc", "start").collect()]
    assert {d for d, _, _ in spans} == {2, 3, 4, 5}
    assert max(spans.count(s) for s in spans) == 1 and len(spans) <= 24  # a few paths, not 500 edges
    ranges = debruijn.repeated_passages(docs, collide, substrings.spaced_words, 50, 16)
    got = {r["doc"]: {i for a in r["ranges"] for i in range(a["start"], a["end"])} for r in ranges.collect()}
    assert got[3] == set(range(201))
    assert got[4] == set(range(1, 201)) and got[5] == set(range(200))
    assert 60 not in got[2]


def test_every_window_is_in_one_span_and_equal_windows_share_samples():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, 500).astype(np.uint64)
    values = repeats.mix64(np.concatenate([a, a[100:400], a[:20]]))
    upto = np.array([0, 500, 800, 820])
    doc, lo, n, at, key, _ = repeats.sampled_spans(values, upto, 50, 8)
    assert n.sum() == 451 + 251
    where = {int(s): (int(k), int(t) - i) for s0, m, k, t in zip(lo, n, key, at, strict=True) for i, s in enumerate(range(s0, s0 + m))}
    assert all(where[s] == where[s + 400] for s in range(100, 351))


def test_nulls_repeated_keys_and_empty_tables(spark):
    data = [*rows(), (None, "x" * 300, "en", "s", 1, 1, ""), (5, "x" * 300, "en", "s", 1, 1, ""), (5, "y" * 300, "en", "s", 1, 1, "")]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffixes.without_repeated_bytes(table(spark, data)).collect()}
    assert got[(None, 300)] == 300
    assert substrings.without_repeated_words(table(spark, data)).count() == len(data)
    assert suffixes.without_repeated_bytes(table(spark, [])).count() == 0
    assert substrings.without_repeated_words(table(spark, [])).count() == 0


def test_regular_words_have_different_hashes():
    word = [0]
    for _ in range(10):
        word += [1 - x for x in word]  # a word and its complement collide modulo any power of two
    values = np.array([np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)])
    both = np.concatenate([values[word], values[[1 - x for x in word]]])
    a, b = repeats.Ranges(both)(np.array([0, len(word)]), len(word))
    assert a != b
    with pytest.raises(ValueError):
        repeats.repeated_ranges(None, None, 2000, 10, True)
