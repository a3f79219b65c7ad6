import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import jaccard
from sparkloom.llm.components import connected_components

from .helpers import documents_dir, rows, table


def brute(data, n=4, percent=85):
    sets = []
    for r in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
        sets.append(grams)
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(data)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(data)), key=str)


def near_copies(seed, groups=12, copies=14):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)])
    passage = list(rng.choice(words, 40))
    out = []
    for g in range(groups):
        base = list(rng.choice(words, int(rng.integers(5, 400))))
        if g % 3 == 0:
            base += passage
        for _ in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 2 + len(base) // 40))):
                at = int(rng.integers(0, len(text)))
                text[at : at + int(rng.integers(0, 2))] = [str(rng.choice(words))]
            out.append((len(out) * 3 % 997, " ".join(text), "en", "s", 1, 1, ""))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_op6_against_brute_force(spark, tmp_path, seed):
    data = near_copies(seed) + (rows() if seed == 1 else [])
    got = sorted(map(tuple, jaccard.op6_jaccard(spark, documents_dir(table(spark, data), tmp_path)).collect()), key=str)
    assert got == brute(data)


def test_equal_fragments_miss_no_similar_pair():
    rng = np.random.default_rng(5)
    for size in [*range(6, 60), 100, 159, 160, 250, 700]:
        a = [f"x{i}" for i in rng.permutation(5000)[: size + 3]]
        b = list(a)
        for _ in range(max(1, size // 60)):
            b[int(rng.integers(0, len(b)))] = "new"
        b = b + ["tail"] if size % 2 else b[:-1]
        grams, upto = jaccard.gram_sets(pa.array([" ".join(a), " ".join(b)]), 4)
        x, y = set(grams[: upto[1]].tolist()), set(grams[upto[1] :].tolist())
        if 100 * len(x & y) >= 85 * len(x | y):
            who, keys, level, spare = jaccard.fragment_keys(grams, upto, 0.85)
            kept = []
            for d in (0, 1):  # without the spare ones, whatever the order
                mine = sorted(zip(level[who == d].tolist(), keys[who == d].tolist(), spare[who == d].tolist(), strict=True))
                places: dict = {}
                kept.append({k for v, k, sp in mine if places.update({v: places.get(v, 0) + 1}) or places[v] > sp})
            assert kept[0] & kept[1]


def test_components_and_one_of_each(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0, 100}
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    data = near_copies(3, 5, 4) + rows()
    kept = jaccard.one_of_each(table(spark, data), n=4, threshold=0.85)
    assert kept.columns == table(spark, data).columns
    found = kept.collect()
    assert sorted({r["doc_id"] for r in found} - {None}) == sorted({c for _, _, c in brute(data)} - {None})
    assert len(found) == len({(r["doc_id"], r["text"]) for r in found})


def just_similar():
    """Pairs of whole-word texts whose 5-gram sets of 3 to 12 have a similarity of exactly 0.8 where that can be."""
    out = []
    for size in range(3, 13):
        for repeat in range(6):
            base = [f"s{size}r{repeat}w{i}" for i in range(size + 4)]
            for more in (1, 2, 3):  # one or more grams at the end: size / (size + more)
                out += [base, base + [f"s{size}r{repeat}e{more}x{i}" for i in range(more)]]
            other = [f"q{size}r{repeat}w{i}" for i in range(size + 4)]
            out += [other, other[:-1] + [f"q{size}r{repeat}z"]]  # one gram differs on both sides
    return [(i, " ".join(words), "en", "s", 1, 1, "") for i, words in enumerate(out)]


def test_sets_of_just_the_threshold_link(spark):
    data = just_similar()
    got = sorted(map(tuple, jaccard.jaccard_components(table(spark, data)).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(data, 5, 80)
    words = [f"w{i}" for i in range(9)]
    two = table(spark, [(i, " ".join(words[: 8 + i]), "en", "s", 1, 1, "") for i in (0, 1)])
    assert [r["doc_id"] for r in jaccard.one_of_each(two).collect()] == [0]


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_bounds_in_whole_percents(percent):
    for size in range(1, 60):
        for more in range(1, 1 + size * (100 - percent) // percent):
            words = [f"w{i}" for i in range(size + 4 + more)]
            grams, upto = jaccard.gram_sets(pa.array([" ".join(words[: size + 4]), " ".join(words)]), 5)
            who, keys, _, _ = jaccard.fragment_keys(grams, upto, percent / 100)
            assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.4, 0.855])
def test_low_and_uneven_thresholds_share_a_fragment(threshold):
    rng = np.random.default_rng(7)
    num, den = jaccard.ratio(threshold)
    for size in range(3, 90, 4):
        for _ in range(6):
            a = [f"x{i}" for i in range(size)]
            b = [x if rng.random() < 0.5 + threshold / 2 else f"y{i}" for i, x in enumerate(a)] + [f"z{i}" for i in range(int(rng.integers(0, 1 + size // 2)))]
            grams, upto = jaccard.gram_sets(pa.array([" ".join(a), " ".join(b)]), 1)
            x, y = set(grams[: upto[1]].tolist()), set(grams[upto[1] :].tolist())
            if x != y and den * len(x & y) >= num * len(x | y):
                who, keys, _, _ = jaccard.fragment_keys(grams, upto, threshold)
                assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())


def test_thresholds_are_checked():
    for bad in (0, -0.1, 1.01):
        with pytest.raises(ValueError):
            jaccard.ratio(bad)
    assert jaccard.ratio(0.85) == (17, 20) and jaccard.ratio(0.855) == (171, 200) and jaccard.ratio(1.0) == (1, 1)


def test_large_sets_without_enough_fragments(spark, monkeypatch):
    grams, upto = jaccard.gram_sets(pa.array([" ".join(f"v{i}" for i in range(400))]), 4)
    assert jaccard.lacking_levels(grams, upto, 0.85).tolist() == [0]
    crowded = np.arange(200, dtype=np.uint64)  # all in one fragment of any low level
    assert jaccard.lacking_levels(crowded, np.array([0, 200]), 0.85)[0] > 40

    def all_lack(grams, upto, threshold):
        sizes = np.diff(upto).astype(np.int64)
        return np.where(sizes > 0, jaccard.level_of(sizes, *jaccard.ratio(threshold)) + 1, 0)

    words = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(words[: 55 + i]), "en", "s", 1, 1, "") for i in range(4)]
    sets = jaccard._sets(table(spark, data), "doc_id", "text", 4, 0.85)
    assert jaccard._lacking(table(spark, data), sets, "text", 4) is None
    monkeypatch.setattr(jaccard, "lacking_levels", all_lack)
    short = jaccard._sets(table(spark, data), "doc_id", "text", 4, 0.85)
    shared = jaccard._lacking(table(spark, data), short, "text", 4)
    assert shared.groupBy("key").count().where("count > 1").count() > 0


def test_a_large_group_just_below_the_threshold(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(120)]
    data = []
    for i in range(300):
        text = list(base)
        for _ in range(int(rng.integers(2, 5))):
            at = int(rng.integers(0, len(text)))
            text[at : at + 1] = [] if rng.random() < 0.4 else [f"n{int(rng.integers(0, 40))}"]
        data.append((i, " ".join(text), "en", "s", 1, 1, ""))
    got = sorted(map(tuple, jaccard.jaccard_components(table(spark, data), n=4, threshold=0.85).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == brute(data)


def test_pairs_are_compared_without_new_pivot_pairs(spark, monkeypatch):
    pivot_pairs = jaccard._pivot_pairs
    monkeypatch.setattr(jaccard, "_pivot_pairs", lambda rows: pivot_pairs(rows).limit(0))
    words = [f"w{i}" for i in range(40)]
    data = [(i, " ".join(words[: 38 + i]), "en", "s", 1, 1, "") for i in range(3)]
    assert {tuple(r) for r in jaccard.jaccard_components(table(spark, data)).select("doc_id", "component_id").collect()} == {(i, 0) for i in range(3)}
