"""SentencePiece ids by way of distinct chunks.

No piece of the model crosses from another character to a white-space marker, so a text falls apart into chunks, each a
run of markers and what follows it, that are segmented on their own. In each Arrow batch every distinct chunk is
segmented once, and its ids are joined back by position. A worker keeps a bounded table of chunks from batch to batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ragged_take, slices, string_buffers
from .tokens import ENTRY_BYTES, MEMO_BYTES, distinct_chunks

MARK = "▁"
END_ID = 2


def marked_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Chunks start with each text, and at each space that no space or marker precedes."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        before = np.zeros(n, bool)
        before[1:] = data[:-1] == 32
        before[3:] |= (data[2:-1] == 0x81) & (data[1:-2] == 0x96) & (data[:-3] == 0xE2)
        cut[:n] = (data == 32) & ~before
    cut[offs[:-1]] = True
    cut[n] = False
    return np.flatnonzero(cut)


class PieceCodec:
    """Encodes and decodes batches with the sentencepiece library; `path` is a model whose pieces don't cross markers."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        self.mark = self.model.piece_to_id(MARK)
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _inner(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks inside a text: the model's own leading marker stands for the chunk's first space."""
        return [ids if len(x) > 1 else [self.mark] for x, ids in zip(chunks, self.model.encode([x[1:] for x in chunks], num_threads=1), strict=True)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch, without end ids, and the number of ids of each text."""
        data, offs = string_buffers(column)
        starts = marked_starts(data, offs)
        first = np.zeros(len(data) + 1, bool)
        first[offs[:-1]] = True
        first = first[starts]
        which, distinct = distinct_chunks(data, starts)
        texts = distinct.to_pylist()
        inner = np.zeros(len(texts), bool)
        inner[which[~first]] = True
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        missing = [x for x, k in zip(texts, inner.tolist(), strict=True) if k and x not in self.memo]
        for x, ids in zip(missing, self._inner(missing), strict=True):
            self.memo[x] = np.array(ids, np.int32).tobytes()
            self.held += ENTRY_BYTES + 4 * len(x) + 4 * len(ids)
        heads = np.unique(which[first])
        head_ids = dict(zip(heads.tolist(), self.model.encode([texts[i] for i in heads], num_threads=1), strict=True))
        parts = [self.memo[x] if k else b"" for x, k in zip(texts, inner.tolist(), strict=True)]
        parts += [np.array(head_ids[i], np.int32).tobytes() for i in heads.tolist()]
        place = np.zeros(len(texts), np.int64)
        place[heads] = len(texts) + np.arange(len(heads))
        which = np.where(first, place[which], which)
        flat = np.frombuffer(b"".join(parts), np.int32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        per_chunk = lengths[which]
        ids = ragged_take(flat, (np.cumsum(lengths) - lengths)[which], per_chunk)
        upto = np.concatenate([[0], np.cumsum(per_chunk)])
        return ids, np.diff(upto[np.searchsorted(starts, offs)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        ends = np.cumsum(counts)
        flat = ids.tolist()
        return self.model.decode([flat[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], num_threads=1)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", ids: str = "piece_ids", end_id: int | None = END_ID) -> DataFrame:
    """`docs` with the array column `ids`: the ids of its texts (a null text counts as empty) and the end id.

    Empty texts have the end id alone. Rows are independent, so ties, repeated rows, very long texts and further columns
    need nothing; a column called `ids` is replaced. Empty tables give empty ones.
    """
    schema = docs.drop(ids).withColumn(ids, F.lit(None).cast("array<int>")).schema

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in (x for b in batches for x in slices(b, text)):
            got, counts = codec.encode(batch.column(batch.schema.get_field_index(text)))
            if end_id is not None:
                got, counts = _ended(got, counts, end_id)
            column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(got.astype(np.int32)))
            kept = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), column], names=[*kept, ids])

    return docs.mapInArrow(encoded, schema)


def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end_id, np.int32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def decode_pieces(encoded: DataFrame, model: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """`encoded` with the column `text`, decoded from the array column `ids`; a null array gives an empty text."""
    schema = encoded.drop(text).withColumn(text, F.lit(None).cast("string")).schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            flat, counts = _lists(batch.column(batch.schema.get_field_index(ids)))
            kept = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(codec.decode(flat, counts), pa.string())], names=[*kept, text])

    return encoded.mapInArrow(decoded, schema)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offs = column.offsets.to_numpy()
    counts = np.diff(offs).astype(np.int64)
    if column.null_count:
        counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    return ragged_take(column.values.to_numpy(zero_copy_only=False), offs[:-1].astype(np.int64), counts), counts


def piece_sums(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 of each row."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2)):
            flat, counts = _lists(batch.column(1))
            names = np.char.add(np.arange(int(flat.max()) + 1 if len(flat) else 1).astype(str), " ")
            joined = np.frombuffer("".join(names).encode(), np.uint8)
            lengths = np.char.str_len(names).astype(np.int64)
            raw = ragged_take(joined, (np.cumsum(lengths) - lengths)[flat], lengths[flat])
            ends = np.concatenate([[0], np.cumsum(lengths[flat])])[np.concatenate([[0], np.cumsum(counts)])]
            shas = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            data, offs = string_buffers(batch.column(2))
            texts = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(shas), pa.array(texts)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return decoded.select(key, "piece_ids", "decoded").mapInArrow(sums, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, ties and empty tables as encode_pieces() says."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_sums(decode_pieces(encode_pieces(documents(spark, sf_dir, "doc_id", "text"), model).drop("text"), model))
