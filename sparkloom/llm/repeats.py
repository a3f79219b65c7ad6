"""Repeated stretches of a corpus, found without a row for each position; spans are known by 64-bit hashes.

A window is K consecutive units (words or bytes) of one document. Each window is sampled by the smallest of its m-unit
hashes, the leftmost of equal ones, which depends on the window's content alone; consecutive windows with one sample make
a span. Equal windows have equal samples at equal offsets, so everything else is decided among the spans of a sample:

1. spans that are equal throughout are equal window by window: all but the first are repeats,
2. a sample with a single kind of span needs nothing more,
3. the first span of each kind of any other sample goes to a function of the caller's that sorts whole samples (see
   induction.py). Samples of more kinds than a task should hold are cut into blocks of windows by their offset from the
   sample, and these, where they still differ, into windows; the same two steps decide among them.

Long repeats are found first, with windows four times as wide and so a quarter of the spans: what they cover can't hold a
first occurrence, so its windows are left out afterwards. Every level is a few joins and sums by key over rows that are
far fewer than the positions; hot keys are summed before they are shuffled and their joins can be split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, slices, written

#: Bytes that are broadcast at most; beyond that Spark joins by shuffling.
BROADCAST_BYTES = 256 << 20
#: Windows of a block, on the second level.
BLOCK = 8
#: Kinds of spans of one sample that a task sorts; samples with more are split by content.
KINDS = 1 << 16
BASE = np.uint64(0x9E6C63D0876A9A4F | 1)
PRIME, SMALL_BASE = np.uint64((1 << 31) - 1), 0x2F3A9C51
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NULL_DOC = (1 << 63) - 1
#: A span's place: first window, number of windows and offset of the sample, packed so that places sort by the first.
SPANS = "key long, id long, doc long, tag long, place long"
NODE_SPANS = f"{SPANS}, left long, right long"
#: How much wider the first level's windows and samples are.
WIDER = 4
#: Of a slice: 64-bit values of the units, and where each text's units begin (one more at the end).
Units = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
#: Of documents, spans of whole samples, window, within and most: doc, tag and range of what repeats.
Sorted = Callable[[DataFrame, DataFrame, int, bool, int], DataFrame]


class Ranges:
    """Hashes of any range of a slice's units, from running sums: a polynomial modulo 2 ** 64 and another modulo a prime.

    Modulo a power of two alone, some regular words of two letters have the same sum whatever the base.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        powers = np.full(n + 1, BASE)
        powers[0] = 1
        self.inverse = np.full(n + 1, INVERSE)
        self.inverse[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers[:n], out=self.sums[1:])
        self.back = _powers(pow(SMALL_BASE, -1, int(PRIME)), n + 1)
        self.small = np.zeros(n + 1, np.uint64)  # up to 2 ** 31 terms below the prime stay below 2 ** 62
        np.cumsum(mix64(values) % PRIME * _powers(SMALL_BASE, n) % PRIME, out=self.small[1:])

    def __call__(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        wide = (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]
        small = (self.small[starts + lengths] - self.small[starts]) % PRIME * self.back[starts] % PRIME
        return mix64(wide ^ mix64(small))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo PRIME."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, int(PRIME))) % PRIME
        done += more
    return out[:n]


def sampled_spans(values: np.ndarray, upto: np.ndarray, window: int, gram: int, left_out: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of each span: document number, first window, number of windows, offset of the sample, sample's and span's hash.

    left_out: of each unit, whether a window that starts there is to be left out.
    """
    n = len(values)
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    ranges = Ranges(values)
    hashes = mix64((ranges.sums[gram:] - ranges.sums[:-gram]) * ranges.inverse[: n - gram + 1])
    best = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    width, wanted = 1, window - gram + 1
    while width < wanted:  # minima over ever wider windows
        step = min(width, wanted - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    sample = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(upto[1:], np.diff(upto))[: len(sample)]
    valid = np.arange(len(sample)) + window <= ends
    if left_out is not None:
        valid &= ~left_out[: len(sample)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (sample[1:] != sample[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (sample[1:] != sample[:-1])
    lo, hi = np.flatnonzero(new), np.flatnonzero(last)
    # windows of two documents never share a sample: each lies within its document
    doc = np.searchsorted(upto, lo, "right") - 1
    count = hi - lo + 1
    return doc, lo, count, sample[lo] - lo, hashes[sample[lo]], ranges(lo, count + window - 1)


def span_rows(batch: pa.RecordBatch, doc: np.ndarray, key: np.ndarray, ids: np.ndarray, lo: np.ndarray, n: np.ndarray, at: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    """Spans as rows of SPANS, and further columns of 64 bits."""
    docs, tags = (batch.column(i).to_numpy(zero_copy_only=False)[doc] for i in (0, 1))
    place = lo.astype(np.int64) << 24 | n.astype(np.int64) << 12 | at.astype(np.int64)
    columns = {"key": key, "id": ids, "doc": docs, "tag": tags, "place": place} | more
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64), pa.int64()) for c in columns.values()], names=list(columns))


def first_window() -> Column:
    return F.shiftright("place", 24).cast("int")


def window_count() -> Column:
    return F.shiftright("place", 12).bitwiseAND(F.lit(4095)).cast("int")


def guarded(df: DataFrame, lists: str | None = None) -> DataFrame:
    """Marked for broadcast where its bytes, by its counted rows and list elements, are few; else left to Spark."""
    elements = F.coalesce(F.sum(F.size(lists).cast("long")), F.lit(0)) if lists else F.lit(0)
    size = df.agg((F.count("*") * 40 + elements * 16).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def tagged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tag and text: a null key comes last, the tag tells rows with equal keys and different texts apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_DOC)).alias("doc"), F.xxhash64(body).alias("tag"), body.alias("text"))


def _sampled(docs: DataFrame, units: Units, window: int, gram: int, most: int, keys_only: bool = False) -> DataFrame:
    """The spans of docs (doc, tag, text, and ranges whose windows are left out)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2, most)):
            values, upto = units(batch.column(2))
            out = cover(batch, upto, window - 1) if batch.num_columns > 3 else None
            doc, lo, n, at, key, ids = sampled_spans(values, upto, window, gram, out)
            if keys_only:
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])
            else:
                yield span_rows(batch, doc, key, ids, lo - upto[doc], n, at)

    return docs.mapInArrow(rows, "key long" if keys_only else SPANS)


def next_level(docs: DataFrame, open_spans: DataFrame, units: Units, window: int, block: int, most: int, nodes: bool = False) -> DataFrame:
    """The open spans cut into blocks of `block` windows by their offset from the sample (1: windows).

    nodes: with `left` and `right`, the hashes of the first and the last window - 1 units.
    """
    asked = written(open_spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "key")).alias("asked")))
    wanted = docs.join(guarded(asked, "asked"), ["doc", "tag"]).select("doc", "tag", "text", "asked")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2, most)):
            values, upto = units(batch.column(2))
            ranges = Ranges(values)
            asked = batch.column(3)
            flat = asked.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            packed, key = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            lo, n, at = packed >> 24, packed >> 12 & 4095, packed & 4095
            far, near = at // block, (at - n + 1) // block  # blocks of windows so far before the sample
            pieces = (far - near + 1).astype(np.int64)
            which = np.repeat(np.arange(len(lo)), pieces)
            j = far[which] - (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            place = (lo + at)[which]
            begin = np.maximum(place - block * j - block + 1, lo[which]).astype(np.int64)
            end = np.minimum(place - block * j, (lo + n - 1)[which]).astype(np.int64)
            base = begin + upto[doc[which]]
            ids = ranges(base, end - begin + window)
            ends = {"left": ranges(base, window - 1), "right": ranges(base + end - begin + 1, window - 1)} if nodes else {}
            keys = ids if block == 1 else mix64(key[which].view(np.uint64) + j.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
            yield span_rows(batch, doc[which], keys, ids, begin, end - begin + 1, place - begin, **ends)

    found = written(wanted.mapInArrow(rows, NODE_SPANS if nodes else SPANS))
    dropped(asked)
    return found


def _live(keys: DataFrame) -> DataFrame:
    return written(keys.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))


def _decide(rows: DataFrame, live: DataFrame, within: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that repeat an earlier one of their kind, and those that are the first of one of several kinds (with
    their number, kinds), which need the third table until they have been read.

    within: an earlier place in the same document counts; else only a smaller document does.
    """
    alive = written(rows.join(guarded(live), "key", "left_semi"))
    dropped(rows, live)
    rows = alive
    place = F.struct("doc", "place") if within else F.col("doc")
    firsts = written(rows.groupBy("key", "id").agg(F.min(place).alias("first")))
    several = firsts.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    known = written(rows.join(firsts, ["key", "id"]).select("key", "doc", "tag", "place", (place > F.col("first")).alias("again")))
    dropped(rows)
    return known.where("again"), known.where("NOT again").join(several, "key"), firsts


def _covered(again: DataFrame, window: int) -> DataFrame:
    return again.select("doc", "tag", F.struct(first_window().alias("start"), (first_window() + window_count() + F.lit(window - 1)).alias("end")).alias("range"))


def checked(window: int, gram: int) -> None:
    if not 0 < gram <= window or WIDER * (window - gram) >= 4095:
        raise ValueError("a window must have at least as many units as a gram, and at most 1022 more")


def repeated_ranges(docs: DataFrame, units: Units, window: int, gram: int, within: bool, most: int = 2 << 20, by_sorting: Sorted | None = None, kinds: int = KINDS) -> DataFrame:
    """doc, tag, ranges: the units that windows cover which occur earlier, as (start, end) in no particular order.

    docs has doc, tag and text, see tagged(). Windows may have up to 1023 units more than grams, so that counts and
    offsets of the wide ones fit into a packed place. by_sorting decides samples of up to `kinds` kinds of spans.
    """
    checked(window, gram)
    wide = written(_sampled(docs, units, WIDER * window, WIDER * gram, most))
    again, _, firsts = _decide(wide, _live(wide), within)
    dropped(firsts)
    covered = _covered(again, WIDER * window)
    known = written(covered.groupBy("doc", "tag").agg(F.collect_list("range").alias("ranges")))
    rest = docs.join(guarded(known, "ranges"), ["doc", "tag"], "left").select("doc", "tag", "text", "ranges")
    live = _live(_sampled(rest, units, window, gram, most, keys_only=True))
    again, still, firsts = _decide(_sampled(rest, units, window, gram, most), live, within)
    covered = covered.unionByName(_covered(again, window))
    still = written(still)
    dropped(firsts)
    if by_sorting:
        covered = covered.unionByName(by_sorting(docs, still.where(F.col("kinds") <= kinds), window, within, most))
    split = still.where(F.col("kinds") > kinds) if by_sorting else still
    for block in (BLOCK, 1) if not split.isEmpty() else ():
        rows = next_level(docs, split, units, window, block, most)
        again, split, firsts = _decide(rows, _live(rows), within)
        covered = covered.unionByName(_covered(again, window))
        if block > 1:
            split = written(split)
        dropped(firsts)
    return covered.groupBy("doc", "tag").agg(F.collect_list("range").alias("ranges"))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc, tag, text, ranges (null where nothing repeats)."""
    return docs.join(ranges, ["doc", "tag"], "left").select("doc", "tag", "text", "ranges")


def doc_id() -> Column:
    return F.when(F.col("doc") != NULL_DOC, F.col("doc"))


def cover(batch: pa.RecordBatch, upto: np.ndarray, short: int = 0) -> np.ndarray:
    """Of each unit of a slice, whether a range (without its last `short` units) covers it."""
    column = batch.column(3)
    flat, offs = column.flatten(), column.offsets.to_numpy()
    counts = np.diff(offs)
    if column.null_count:
        counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    base = np.repeat(upto[:-1], counts)
    steps = np.zeros(int(upto[-1]) + 1, np.int32)
    if len(flat):
        np.add.at(steps, flat.field(0).to_numpy(zero_copy_only=False) + base, 1)
        np.add.at(steps, flat.field(1).to_numpy(zero_copy_only=False) + base - short, -1)
    return np.cumsum(steps)[:-1] > 0
