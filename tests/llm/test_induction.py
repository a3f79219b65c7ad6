import functools

import numpy as np
import pytest

from sparkloom.llm import induction, repeats, suffixes

from .test_repeats import corpus


def flat(parts):
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def test_least_between():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 100, 300).astype(np.int16)
    lo = rng.integers(0, 300, 400)
    hi = np.minimum(299, lo + rng.integers(0, 300, 400))
    assert induction.least_between(values, lo, hi).tolist() == [values[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]
    assert len(induction.least_between(values, lo[:0], hi[:0])) == 0


def test_common_prefixes():
    parts = [b"", b"a", b"ab", b"ab", b"abc", b"abd"]
    assert induction.common_prefixes(np.array([1, 1, 1, 1, 1, 2]), *flat(parts)).tolist() == [0, 0, 1, 2, 2, 0]


@pytest.mark.parametrize("seed", range(6))
def test_induced_windows_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    window, kinds = 10, []
    for place in range(160):
        before = rng.integers(0, 2, int(rng.integers(0, 8))).astype(np.uint8).tobytes()
        nearest = int(rng.integers(0, len(before) + 1))
        key = int(rng.integers(0, 4))
        ahead = bytes([9, key, 9]) + rng.integers(0, 2, window - nearest - 3).astype(np.uint8).tobytes()
        kinds.append((key, ahead, before, nearest, place // 2))  # two rows of each place
    kinds = [kinds[i] for i in rng.permutation(160)]
    kinds.sort(key=lambda k: k[:2])
    common = induction.common_prefixes(np.array([k[0] for k in kinds]), *flat([k[1] for k in kinds]))
    first = np.array([k[4] for k in kinds])
    got = induction.repeated_windows(common, *flat([k[2] for k in kinds]), np.array([k[3] for k in kinds]), first, window)

    windows = {(i, a): (b[len(b) - a :] + ahead)[:window] for i, (_, ahead, b, nearest, _) in enumerate(kinds) for a in range(nearest, len(b) + 1)}
    earliest: dict = {}
    for (i, _), w in windows.items():
        earliest[w] = min(earliest.get(w, 99), kinds[i][4])
    want = {at for at, w in windows.items() if earliest[w] < kinds[at[0]][4]}
    assert {(int(i), int(a)) for i, a in zip(*np.nonzero(got), strict=True)} == want and want


def test_small_tasks_and_samples_of_many_kinds(spark):
    docs = repeats.tagged(spark.createDataFrame([r[:2] for r in corpus(3, 40)], "doc_id long, text string"))

    def covered(held, kinds):
        by_sorting = functools.partial(induction.induced_ranges, held=held)
        ranges = repeats.repeated_ranges(docs, suffixes.bytes_of, 100, 32, True, by_sorting=by_sorting, kinds=kinds)
        return {(r["doc"], i) for r in ranges.collect() for a in r["ranges"] for i in range(a["start"], a["end"])}

    sorted_only = covered(induction.HELD, repeats.KINDS)
    assert sorted_only == covered(1, 2) and sorted_only
