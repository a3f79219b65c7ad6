"""Removing byte strings that occur earlier, by induced sorting of sampled suffixes.

Sampled suffixes begin at the smallest gram of a window in a fixed random order, so that equal windows hold equal samples
at equal offsets. Those whose sample occurs once are left out, equal spans of windows are grouped by hash, wide ones
first (repeats.py); the suffixes of all others are sorted with their common-prefix values, and the ones between the
samples are induced from them, byte by byte (induction.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, mix64, slices, string_buffers
from .induction import induced_ranges
from .repeats import cover, doc_id, repeated_ranges, tagged, with_ranges

WINDOW, GRAM = 100, 32
BYTES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x6A09E667F3BCC908))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = string_buffers(column)
    return BYTES[data], offs


def without_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and kept_sha256 of each row.

    A byte goes if a string of `window` bytes over it also starts earlier: in a row with a smaller key (a null key is the
    largest) or before in the same text. Texts that are null, empty or shorter than a window lose nothing. Rows with
    equal keys count as one place, so equal starts in them are not earlier. Other columns are ignored.
    """
    rows = tagged(docs, key, text)
    ranges = repeated_ranges(rows, bytes_of, window, gram, within=True, by_sorting=induced_ranges)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2)):
            data, offs = string_buffers(batch.column(2))
            gone = cover(batch, offs)
            raw = data[~gone]
            upto = np.concatenate([[0], np.cumsum(gone)])[offs]
            edges = offs - upto
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offs[:-1][offs[:-1] < len(data)]
            begins[inner] = gone[inner]
            runs = np.diff(np.concatenate([[0], np.cumsum(begins)])[offs])
            texts = [raw[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            columns = [batch.column(0), pa.array(np.diff(offs)), pa.array(np.diff(upto).astype(np.int64)), pa.array(runs.astype(np.int64)), pa.array(texts, pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    found = with_ranges(rows, ranges).mapInArrow(kept, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return found.select(doc_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, ties and empty tables as without_repeated_bytes() says."""
    return without_repeated_bytes(documents(spark, sf_dir, "doc_id", "text")).drop("kept")
