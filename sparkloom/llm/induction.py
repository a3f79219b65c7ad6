"""Induced sorting of the suffixes in those spans whose sample repeats, with common-prefix values, outside of memory.

A span (repeats.py) is a run of windows around one sample. The suffix that begins at its sample is its sampled suffix; the
suffixes that begin before it, down to the span's first window, are induced from it:

1. Spark's external sort, which spills to disk, hands each task its sampled suffixes in the order of sample and bytes, as
   tuples of suffix, bytes before it and place; the bytes that neighbours have in common are counted.
2. The suffixes one byte further left are in the order of that byte and, where it is equal, of the suffixes they were
   induced from: a stable sort by one byte. Neighbours with one byte have one more byte in common than the least common
   prefix between them had before; others have none. This is repeated until each span's first window is reached.
3. Neighbours with a whole window in common are equal windows: all but the first place are repeats.

Suffixes are followed for the length of a window only, so names of samples need no order beyond their own bytes and the
recursion ends at the samples. A task holds some samples at a time, never a partition; samples with more kinds of spans
than a task may hold are left to the levels of repeats.py, which split them by content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, ragged_take, slices, string_buffers, written
from .repeats import guarded

#: Sampled suffixes that a task holds at a time, but for the rest of a sample (of at most repeats.KINDS).
HELD = 1 << 15
TUPLES = "key long, ahead binary, before binary, doc long, tag long, place long"


def _binary(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(ragged_take(data, starts, lengths)))])


def _tuples(docs: DataFrame, asked: DataFrame, window: int, most: int) -> DataFrame:
    """Of each span asked for: its sample, the bytes from there to the end of its last window, and those before."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2, most)):
            data, offs = string_buffers(batch.column(2))
            asked = batch.column(3)
            flat = asked.flatten()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            for begin in range(0, len(doc), HELD):
                which = doc[begin : begin + HELD]
                place, key = (flat.field(i).to_numpy(zero_copy_only=False)[begin : begin + HELD] for i in range(2))
                lo, n, at = place >> 24, place >> 12 & 4095, place & 4095
                first = lo + offs[which]
                docs, tags = (batch.column(i).to_numpy(zero_copy_only=False)[which] for i in (0, 1))
                columns = [pa.array(key), _binary(data, first + at, n - 1 - at + window), _binary(data, first, at), pa.array(docs), pa.array(tags), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ahead", "before", "doc", "tag", "place"])

    return docs.join(guarded(asked, "asked"), ["doc", "tag"]).select("doc", "tag", "text", "asked").mapInArrow(rows, TUPLES)


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo[i] : hi[i] + 1]) of each i, by minima of ranges of 1, 2, 4, ... values."""
    out = np.zeros(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[order], np.arange(int(level.max(initial=-1)) + 2))
    for k in range(len(edges) - 1):
        ask = order[edges[k] : edges[k + 1]]
        out[ask] = np.minimum(values[lo[ask]], values[hi[ask] - (1 << k) + 1])
        if k + 2 < len(edges):
            values = np.minimum(values[: -(1 << k)], values[1 << k :])
    return out


def common_prefixes(key: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes each string has in common with the one above it; none with that of another key."""
    lengths = np.diff(offs)
    common = np.zeros(len(lengths), np.int16)
    if len(lengths) > 1:
        short = np.minimum(lengths[1:], lengths[:-1])
        short[key[1:] != key[:-1]] = 0
        padded = np.zeros((len(lengths), int(lengths.max()) + 1), np.uint8)
        padded[np.arange(padded.shape[1]) < lengths[:, None]] = data
        differ = padded[1:] != padded[:-1]
        differ[:, -1] = True
        common[1:] = np.minimum(differ.argmax(1), short)
    return common


def repeated_windows(common: np.ndarray, data: np.ndarray, offs: np.ndarray, nearest: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Of each sampled suffix (in order, with common prefixes) and each offset from it, whether the window that begins so
    many bytes before it also begins at an earlier place.

    data, offs: the bytes before each; nearest: the offset of its last window; first: ranks of places.
    """
    furthest = np.diff(offs)
    out = np.zeros((len(common), int(furthest.max(initial=0)) + 1), bool)
    here = np.arange(len(common))
    for offset in range(out.shape[1]):
        if offset:
            was = np.flatnonzero(furthest[here] >= offset)
            byte = data[offs[here[was] + 1] - offset]
            order = np.argsort(byte, kind="stable")
            was, byte = was[order], byte[order]
            same = np.flatnonzero(byte[1:] == byte[:-1])
            induced = np.zeros(len(was), np.int16)
            induced[same + 1] = least_between(common, was[same] + 1, was[same + 1]) + 1
            here, common = here[was], induced
        begins = common < window
        begins[:1] = True
        earliest = np.minimum.reduceat(first[here], np.flatnonzero(begins))[np.cumsum(begins) - 1]
        out[here, offset] = (first[here] > earliest) & (nearest[here] <= offset)
    return out


def _ranges(rows: pa.RecordBatch, window: int, within: bool) -> pa.RecordBatch:
    """doc, tag, start and end of what is repeated, of whole samples."""
    key, doc, tag, place = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4, 5))
    at = place & 4095
    sample = (place >> 24) + at
    order = np.lexsort((sample, doc))
    later = np.zeros(len(order), np.int64)
    later[1:] = (np.diff(doc[order]) != 0) | (within & (np.diff(sample[order]) != 0))
    first = np.empty(len(order), np.int64)
    first[order] = np.cumsum(later)
    common = common_prefixes(key, *string_buffers(rows.column(1)))
    again = repeated_windows(common, *string_buffers(rows.column(2)), at - (place >> 12 & 4095) + 1, first, window)
    edges = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, near = np.nonzero(edges == 1)
    far = np.nonzero(edges == -1)[1] - 1
    columns = [pa.array(doc[row]), pa.array(tag[row]), pa.array((sample[row] - far).astype(np.int32)), pa.array((sample[row] - near + window).astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "tag", "start", "end"])


def induced_ranges(docs: DataFrame, spans: DataFrame, window: int, within: bool, most: int, held: int = HELD) -> DataFrame:
    """doc, tag, range: what the windows of spans cover which also begin earlier in spans of the same sample.

    spans: doc, tag, place, key, with bytes as units. within: earlier in the same document counts too.
    """
    asked = written(spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("place", "key")).alias("asked")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) < held:
                continue
            key = np.concatenate([b.column(0).to_numpy() for b in waiting])
            ends = np.flatnonzero(key[1:] != key[:-1])
            if len(ends):  # the last sample may go on in the next batch
                whole = int(ends[-1]) + 1
                table = pa.Table.from_batches(waiting)
                yield _ranges(table.slice(0, whole).combine_chunks().to_batches()[0], window, within)
                waiting = table.slice(whole).combine_chunks().to_batches()
        if sum(b.num_rows for b in waiting):
            yield _ranges(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0], window, within)

    ordered = _tuples(docs, asked, window, most).repartition("key").sortWithinPartitions("key", "ahead")
    found = written(ordered.mapInArrow(rows, "doc long, tag long, start int, end int"))
    dropped(asked)
    return found.select("doc", "tag", F.struct("start", "end").alias("range"))
