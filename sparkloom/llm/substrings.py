"""Removing word passages that an earlier document has, by compaction of a de Bruijn graph of word k-mers.

Windows of 50 words are the edges; repeated paths without branches are compacted by joins, and the words at the
coordinates of each source verify them; see debruijn.py. The first source of a passage keeps its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, ragged_take, slices, string_buffers, word_bounds, word_hashes
from .debruijn import repeated_passages
from .repeats import cover, doc_id, tagged, with_ranges

WINDOW, GRAM = 50, 16


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = string_buffers(column)
    starts, ends, upto = word_bounds(data, offs)
    return word_hashes(data, starts, ends), upto


def spaced_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts with one space after each, where each word begins and the first word of each text."""
    data, offs = string_buffers(column)
    starts, ends, upto = word_bounds(data, offs)
    lengths = ends - starts + 1  # each word and the byte after it, which becomes a space
    raw = np.array(ragged_take(np.append(data, np.uint8(32)), starts, lengths))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    raw[begins[1:] - 1] = 32
    return raw, begins, upto


def without_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words joined by one space) and kept_sha256 of each row.

    Words of a window are removed where the same words also start in a row with a smaller key; a null key is the largest.
    Texts that are null, empty or shorter than a window lose nothing. Rows with equal keys don't count against each
    other, and repeats inside one document stay. Other columns are ignored.
    """
    rows = tagged(docs, key, text)
    ranges = repeated_passages(rows, words_of, spaced_words, window, gram)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2)):
            data, offs = string_buffers(batch.column(2))
            starts, ends, upto = word_bounds(data, offs)
            gone = cover(batch, upto)
            stay = np.flatnonzero(~gone)
            spaced = np.append(data, np.uint8(32))
            # each kept word and the byte after it, which becomes a space
            lengths = (ends - starts)[stay] + 1
            raw = ragged_take(spaced, starts[stay], lengths)
            stops = np.cumsum(lengths)
            raw[stops - 1] = 32
            edges = np.concatenate([[0], stops])[np.searchsorted(stay, upto)]
            texts = [raw[a : max(a, b - 1)].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[upto])
            columns = [batch.column(0), pa.array(np.diff(upto)), pa.array(removed.astype(np.int64)), pa.array([t.decode() for t in texts], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_removed", "kept", "kept_sha256"])

    found = with_ranges(rows, ranges).mapInArrow(kept, "doc long, n_words long, n_removed long, kept string, kept_sha256 string")
    return found.select(doc_id().alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, ties and empty tables as without_repeated_words() says."""
    return without_repeated_words(documents(spark, sf_dir, "doc_id", "text")).drop("kept")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(50)) AS j FROM k JOIN f USING (h) WHERE first < doc_id)),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
r AS (SELECT w.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY w.pos) FILTER (gone.pos IS NULL) AS kept
  FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
