"""Runs that repeat themselves and passages that come again, from hashes; what the hashes find is compared by characters.

All texts of a slice go together, so that numpy's calls are few. No backtracking: n log n for a text of n characters at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A unit has so many characters at least and stands so often in a row.
UNIT, TIMES = 12, 3
#: Pairs of blocks that are compared at a time.
PAIRS = 1 << 18
#: Characters and texts of a slice, about; a longer text is a slice of its own. A text's number has DOC_BITS bits of a key.
SLICE, DOC_BITS = 1 << 20, 12
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


class _Slice:
    """Code points of texts one behind the other, and where each ends."""

    def __init__(self, texts: pa.Array) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        ends = (offsets - offsets[0]).astype(np.int64)
        if len(raw) and raw.max() > 127:
            self.s = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
        else:
            self.s = raw
        self.begins, self.ends = ends[:-1], ends[1:]
        self.text = np.repeat(np.arange(len(texts)), self.ends - self.begins)

    def hashed(self, n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n characters of a text begin, and hashes of those."""
        power = lambda m: kind(pow(BASE, m, 1 << 64) & int(np.iinfo(kind).max))
        whole, width, have = self.s.astype(kind) + kind(1), 1, 0
        found, left = None, n
        while left:
            if left & 1:
                size = max(0, len(self.s) - have - width + 1)
                found = whole[:size] if found is None else found[:size] + power(have) * whole[have : have + size]
                have += width
            left >>= 1
            if left:
                size = max(0, len(whole) - width)
                whole, width = whole[:size] + power(width) * whole[width : width + size], 2 * width
        text = self.text[: len(found)]
        at = np.flatnonzero(self.ends[text] - np.arange(len(found)) >= n)
        return at, found[at]

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions as in hashed(), and keys: bits of a hash, and the text's number as the low ones."""
        at, found = self.hashed(n, np.uint64)
        found = (found ^ (found >> np.uint64(32))) * MIX
        low = np.uint64((1 << DOC_BITS) - 1)
        return at, (found & ~low) | self.text[at].astype(np.uint64)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1
        end = min(max(end, at + 1), at + (1 << DOC_BITS), len(texts))
        yield texts.slice(at, end - at)
        at = end


def _repeats(s: np.ndarray, at: int, p: int) -> bool:
    """Whether a run of period p around the equal blocks at `at` and `at` + p is TIMES periods long."""
    begin = max(0, at - (TIMES - 2) * p)
    same = s[begin : len(s) - p][: (2 * TIMES - 3) * p] == s[begin + p :][: (2 * TIMES - 3) * p]
    broken = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    return bool(np.diff(broken).max(initial=1) - 1 >= (TIMES - 1) * p)


def _stretches(part: _Slice) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of stretches in which every UNIT characters come again in the same text.

    In a run of three periods of UNIT characters or more, any UNIT characters stand a period before or behind too, so the
    whole run lies in one stretch. Equal hashes of other characters make stretches longer, never shorter.
    """
    at, keys = part.hashed(UNIT, np.uint32)
    if not len(keys):
        return at, at
    keys = (keys ^ part.text[at].astype(np.uint32) * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)
    order = np.sort(keys)
    again = order[1:][order[1:] == order[:-1]]
    bits = np.uint32(32 - min(26, max(16, int(len(keys)).bit_length() + 2)))
    seen = np.zeros(1 << (32 - int(bits)), bool)
    seen[again >> bits] = True
    marked = np.zeros(len(part.s) + 2, bool)
    marked[at + 1] = seen[keys >> bits]
    edges = np.flatnonzero(marked[1:] != marked[:-1])
    begins, lengths = edges[::2], edges[1::2] - edges[::2] + UNIT - 1
    long = lengths >= UNIT * TIMES
    return begins[long], lengths[long]


def _tandems(part: _Slice) -> np.ndarray:
    """For each text of a slice, whether some unit of UNIT characters or more stands TIMES times or more in a row.

    Of a run of three periods p, two whole blocks lie next to each other on multiples of p and are equal. Their hashes
    find them for every p; what they find is compared character by character.
    """
    found = np.zeros(len(part.begins), bool)
    begins, lengths = _stretches(part)
    if not len(begins):
        return found
    starts = np.cumsum(lengths) - lengths  # of the stretches one behind the other
    s = part.s[np.arange(lengths.sum()) + np.repeat(begins - starts, lengths)]
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(s), np.uint64(BASE))]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate((s.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    tried = lengths // TIMES - UNIT + 1
    which = np.repeat(np.arange(len(begins)), tried)
    periods = np.arange(len(which)) - np.repeat(np.cumsum(tried) - tried, tried) + UNIT
    pairs = np.cumsum(lengths[which] // periods - 1)
    at, done = 0, set()
    while at < len(which):
        end = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
        k, p = which[at:end], periods[at:end]
        at = end
        open_ = ~found[part.text[begins[k]]]
        k, p = k[open_], p[open_]
        counts = lengths[k] // p - 1
        period = np.repeat(p, counts)
        place = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * period + np.repeat(starts[k], counts)
        first, second, third = sums[place], sums[place + period], sums[place + 2 * period]
        equal = np.flatnonzero((second - first) * powers[period] == third - second)
        stretch = np.searchsorted(starts, place[equal], "right") - 1
        for i, k_, text in zip(equal.tolist(), stretch.tolist(), part.text[begins[stretch]].tolist(), strict=True):
            if text not in done and _repeats(s[starts[k_] : starts[k_] + lengths[k_]], int(place[i] - starts[k_]), int(period[i])):
                done.add(text)
                found[text] = True
    return found


def _come_again(part: _Slice, n: int, times: int) -> np.ndarray:
    """For each text of a slice, whether some n characters in a row occur `times` times."""
    found = np.zeros(len(part.begins), bool)
    at, keys = part.keys(n)
    order = np.sort(keys)
    often = order[times - 1 :][order[times - 1 :] == order[: len(order) - times + 1]] if len(order) >= times else order[:0]
    if not len(often):
        return found
    text = (often & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
    texts, first = np.unique(text, return_index=True)
    sought = np.zeros(len(found), np.uint64)
    asked = np.zeros(len(found), bool)
    sought[texts], asked[texts] = often[first], True
    own = part.text[at]
    hits = at[(keys == sought[own]) & asked[own]]
    owner = part.text[hits]
    heads = hits[np.searchsorted(owner, owner)]  # each text's first place
    same = np.ones(len(hits), bool)
    for i in range(n):
        same &= part.s[hits + i] == part.s[heads + i]
    found[np.bincount(owner[same], minlength=len(found)) >= times] = True
    for t in texts[~found[texts]]:  # different passages with one hash
        s = part.s[part.begins[t] : part.ends[t]]
        found[t] = max(Counter(s[i : i + n].tobytes() for i in range(len(s) - n + 1)).values()) >= times
    return found


def _flagged(texts: pa.Array, flags) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, bool), *[flags(_Slice(part)) for part in _slices(texts)]]))


def tandem(text: str | None) -> bool:
    """Whether some unit of UNIT characters or more stands TIMES times or more in a row."""
    return _flagged(pa.array([text], pa.string()), _tandems)[0].as_py()


@F.arrow_udf(T.BooleanType())
def has_tandem(texts: pa.Array) -> pa.Array:
    """tandem() of each text; a null text has none."""
    return _flagged(texts, _tandems)


def has_passage(n: int, times: int):
    """Whether some n characters in a row occur `times` times in a text; a null text has none."""

    @F.arrow_udf(T.BooleanType())
    def has(texts: pa.Array) -> pa.Array:
        return _flagged(texts, lambda part: _come_again(part, n, times))

    return has
