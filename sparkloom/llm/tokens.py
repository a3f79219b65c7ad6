"""Token ids as directly addressable codes.

An id is cut into chunks of 8 bits. Level 0 holds the lowest chunk of every token, level k + 1 the next chunk of those
tokens whose level k has its continuation bit set; each level has a bitmap of these bits and a directory of ranks, one
for each 512 bits. Token i is read by following ranks from level to level, without decoding anything else of its block.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, ragged_take, scratch_dir, slices, string_buffers, written

#: Bits between two entries of a rank directory.
RANK_EVERY = 512
#: A segment takes whole documents until it has so many tokens.
SEGMENT_TOKENS = 1 << 18
#: Bytes of distinct chunks and their ids that a worker keeps, of those that it meets first, so mostly frequent ones;
#: others are encoded once a batch.
MEMO_BYTES, ENTRY_BYTES = 96 << 20, 200
_MEMOS: dict[str, dict[str, bytes]] = {}
_HELD: dict[str, list[int]] = {}
LEVEL = pa.struct([("codes", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))])
SEGMENT_DDL = "part int, segment int, n_tokens long, first_id long, last_id long, doc_ids array<bigint>, ends array<bigint>, levels array<struct<codes:binary,more:binary,ranks:binary>>"


class Codes:
    """Directly addressable codes of one array of ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint64)
        while True:
            more = rest >> np.uint64(8)
            bits = more > 0
            packed = np.packbits(bits, bitorder="little")
            counts = np.add.reduceat(bits.astype(np.uint32), np.arange(0, len(bits), RANK_EVERY)) if len(bits) else np.zeros(0, np.uint32)
            levels.append(((rest & np.uint64(255)).astype(np.uint8), packed, (np.cumsum(counts) - counts).astype(np.uint32)))
            if not bits.any():
                return cls(levels)
            rest = more[bits]

    def __getitem__(self, i: int) -> int:
        """Token i alone: on each level one code, one bit, one directory entry and the bits of at most one directory block."""
        value = 0
        for k, (codes, more, ranks) in enumerate(self.levels):
            value |= int(codes[i]) << (8 * k)
            if not more[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            ahead = np.unpackbits(more[block * RANK_EVERY // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_EVERY]
            i = int(ranks[block]) + int(ahead.sum())
        return value

    def decode(self) -> np.ndarray:
        """All tokens, from the last level up."""
        above = np.zeros(0, np.uint64)
        for codes, more, _ in reversed(self.levels):
            bits = np.unpackbits(more, count=len(codes), bitorder="little").astype(bool)
            value = codes.astype(np.uint64)
            value[bits] |= above << np.uint64(8)
            above = value
        return above.astype(np.uint32)

    def stored(self) -> list[dict]:
        return [{"codes": c.tobytes(), "more": m.tobytes(), "ranks": r.astype("<u4").tobytes()} for c, m, r in self.levels]

    @classmethod
    def loaded(cls, levels: list[dict]) -> Codes:
        return cls([(np.frombuffer(x["codes"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels])


def chunk_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where a batch of texts can be cut so that byte-level pre-tokenisation doesn't change: at each text's start, and
    before a single ASCII white-space byte between two characters that aren't white space of any kind."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        space = (data == 32) | (data == 10) | (data == 9) | (data == 13)
        wide = (data >= 0x1C) & (data <= 0x1F) | (data == 11) | (data == 12) | space
        before = np.zeros(n, bool)  # the previous character may be white space
        before[1:] = wide[:-1]
        before[2:] |= (data[1:-1] >= 0x80) & (data[:-2] == 0xC2)
        before[3:] |= (data[2:-1] >= 0x80) & ((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
        after = np.zeros(n, bool)
        after[:-1] = wide[1:] | (data[1:] == 0xC2) | (data[1:] >= 0xE1) & (data[1:] <= 0xE3)
        cut[:n] = space & ~before & ~after
    cut[offs[:-1]] = True
    cut[n] = False
    return np.flatnonzero(cut)


def distinct_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each chunk's text among the distinct ones, and those."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    coded = chunks.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class ByteEncoder:
    """Encodes batches with the tokenizers library, each distinct chunk once; ids are joined back by position."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # special tokens in a text are found as the library finds them; chunks are cut at white space, so none is cut
        if any(re.search(r"\s", t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token has white space, at which texts are cut into chunks")
        self.memo, self.held = _MEMOS.setdefault(path, {}), _HELD.setdefault(path, [0])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, and the number of ids of each text."""
        data, offs = string_buffers(column)
        starts = chunk_starts(data, offs)
        which, texts = distinct_chunks(data, starts)
        texts = texts.to_pylist()
        parts = list(map(self.memo.get, texts))
        missing = [i for i, x in enumerate(parts) if x is None]
        for i, e in zip(missing, self.tokenizer.encode_batch_fast([texts[i] for i in missing], add_special_tokens=False), strict=True):
            parts[i] = array("I", e.ids).tobytes()
        for i in missing:
            size = ENTRY_BYTES + 4 * len(texts[i]) + len(parts[i])
            if self.held[0] + size > MEMO_BYTES:
                break
            self.memo[texts[i]] = parts[i]
            self.held[0] += size
        flat = np.frombuffer(b"".join(parts), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begins = np.cumsum(lengths) - lengths
        per_chunk = lengths[which]
        ids = ragged_take(flat, begins[which], per_chunk)
        upto = np.concatenate([[0], np.cumsum(per_chunk)])
        return ids, np.diff(upto[np.searchsorted(starts, offs)])


def end_each(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """With one id more after each text's ids."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def encode_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write all documents' ids, in ascending order of `key`, as a table of segments of directly addressable codes.

    Null texts count as empty and keep their end id; null keys come first; equal keys keep no particular order among
    themselves; other columns are ignored; an empty table gives an empty one. Segments are Parquet rows in range order,
    so a lost executor's part is made again by Spark's writer.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, number = ByteEncoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            nonlocal number, held
            tokens, known = np.concatenate(ids), [k for k in keys if k is not None]
            row = {"part": part, "segment": number, "n_tokens": len(tokens), "first_id": min(known, default=None), "last_id": max(known, default=None), "doc_ids": list(keys), "ends": np.cumsum(np.concatenate(counts)), "levels": Codes.encode(tokens).stored()}
            number, held = number + 1, 0
            keys.clear(), counts.clear(), ids.clear()
            return pa.RecordBatch.from_pylist([row], SEGMENT)

        for batch in (x for b in batches for x in slices(b, 1)):
            got, n = end_each(*encoder(batch.column(1)), end_id)
            begin, ends, names = 0, np.cumsum(n), batch.column(0).to_pylist()
            while begin < len(n):
                base = int(ends[begin - 1]) if begin else 0
                stop = min(len(n), int(np.searchsorted(ends, base + segment_tokens - held)) + 1)
                keys += names[begin:stop]
                counts.append(n[begin:stop])
                ids.append(got[base : int(ends[stop - 1])])
                held += len(ids[-1])
                begin = stop
                if held >= segment_tokens:
                    yield segment()
        if keys:
            yield segment()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(segments, SEGMENT_DDL).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) and, if asked for, ids of each
    document, read back from the segments.

    Starts add up over the parts (one row for each part of the written table) and within each part over its segments.
    """
    table = spark.read.schema(SEGMENT_DDL).parquet(path)
    sizes = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = table.select("part", "segment", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("ahead")).join(bases, "part").select("part", "segment", (F.col("base") + F.col("ahead")).alias("base"))
    begins = written(begins)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            x = row.to_pylist()[0]
            ids, ends = Codes.loaded(x["levels"]).decode(), np.array(x["ends"], np.int64)
            begins, raw = np.concatenate([[0], ends[:-1]]), ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begins, ends, strict=True)]
            columns = [pa.array(x["doc_ids"], pa.int64()), pa.array(begins + x["base"]), pa.array(ends - begins), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return table.select("part", "segment", "doc_ids", "ends", "levels").join(begins, ["part", "segment"]).select("doc_ids", "ends", "levels", "base").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)


def token_at(spark: SparkSession, path: str, doc_id: int, position: int) -> int | None:
    """One token of one document by random access; None outside of it. Segments that can't hold the document are passed
    over by the statistics of their first and last key."""
    held = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id))
    found = spark.read.schema(SEGMENT_DDL).parquet(path).where(held).select("doc_ids", "ends", "levels").first()
    if found is None:
        return None
    k = found["doc_ids"].index(doc_id)
    begin = found["ends"][k - 1] if k else 0
    return Codes.loaded([x.asDict() for x in found["levels"]])[begin + position] if 0 <= position < found["ends"][k] - begin else None


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from the written codes of `documents`; nulls, ties and empty tables as encode_tokens() says."""
    import public_tokenizers

    path = scratch_dir(spark)
    encode_tokens(documents(spark, sf_dir, "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, with_ids=False)

