"""Helpers shared by the training-text operators: table access, scratch tables, Arrow strings as numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.scratch import base_dir

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What is marked for broadcast at most.
BROADCAST_BYTES = 48 << 20
#: ASCII white space, as bytes.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def packed_row(df: DataFrame) -> Column:
    """All columns of `df` as one struct, out of the way of names that an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder that the session names."""
    return f"{base_dir(spark)}/sparkloom-{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession | None = None, **options: str) -> DataFrame:
    """Cut the lineage: write a Parquet table in the shared folder and read it back (survives lost executors).

    What has been shuffled for it is needed no more. Spark deletes shuffle files when the driver's garbage collector
    finds them unused, which it otherwise looks for every half hour; asking for it here keeps disks from filling up.
    Options go to the writer.
    """
    spark = spark or df.sparkSession
    path = scratch_dir(spark)
    df.write.options(**options).parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def guarded(df: DataFrame, row_bytes: int = 32) -> DataFrame:
    """Marked for broadcast where its rows, counted, and their width, stated, stay within BROADCAST_BYTES; else left to
    Spark's own choice."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dropped(*frames: DataFrame) -> None:
    """Delete tables of written() from which everything has been derived and written again."""
    for frame in frames:
        path = getattr(frame, "_scratch_path", None)
        if path:
            spark = frame.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its int64 offsets, starting at 0; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of a string column (a longer text stands alone), so that a task's arrays
    stay small whatever the rows of a batch hold."""
    _, offs = string_buffers(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(offs, offs[begin] + most, "right")) - 1)
        yield batch.slice(begin, stop - begin)
        begin = stop


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate flat[starts[i] : starts[i] + lengths[i]] over all i."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    if total == 0:
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a batch, and the number of the first word of each text (one more at the end)."""
    solid = ~SPACES[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** n in arithmetic modulo 2 ** 64 (base odd)."""
    out = np.full(n + 1, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: two polynomial sums of its scrambled bytes, weighted by the place in the word."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    table = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x51AFD7ED558CCD + seed))
    longest = int(lengths.max())
    weights = mix64(np.arange(min(longest, 64), dtype=np.uint64) + np.uint64(0x2545F491 + seed)) | np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    live = np.arange(len(starts))
    for k in range(longest):
        live = live[lengths[live] > k] if k else live
        if k < 64:
            out[live] += table[data[starts[live] + k]] * weights[k]
        else:  # long words: continue as a running polynomial
            out[live] = mix64(out[live]) + table[data[starts[live] + k]]
    return mix64(out + lengths.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
