"""SimHash fingerprints of 128 bits.

Terms are pairs of neighbouring words (the word itself in a text of one), weighted 1 + log2 of their count. Each term's
hash votes on every bit; the sign of the weighted vote is the bit. Fingerprints within a Hamming radius are found with
permuted block tables: cut into radius + 2 blocks, two fingerprints that near agree on some two whole blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, mix64, slices, string_buffers, word_bounds, word_hashes, written

BITS = 128
#: Bits in which fingerprints may differ and still be near.
RADIUS = 3
EMPTY = "0" * (BITS // 4)
#: Bit k of a byte, as a vote of -1 or 1.
VOTES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2) - 1


def fingerprints(column: pa.Array) -> np.ndarray:
    """One row of 16 bytes for each text; texts without words have zeros."""
    data, offs = string_buffers(column)
    starts, ends, upto = word_bounds(data, offs)
    n_docs = len(offs) - 1
    out = np.zeros((n_docs, BITS // 8), np.uint8)
    if len(starts) == 0:
        return out
    words = word_hashes(data, starts, ends)
    counts = np.diff(upto)
    doc = np.repeat(np.arange(n_docs), counts)
    terms = words.copy()
    terms[:-1] = mix64(words[:-1] * np.uint64(0xA24BAED4963EE407) + words[1:])
    final = np.zeros(len(words), bool)
    final[upto[1:][counts > 1] - 1] = True  # a last word starts no pair
    doc, terms = doc[~final], terms[~final]
    lone = np.flatnonzero(counts == 1)
    if len(lone):
        terms[np.searchsorted(doc, lone)] = words[upto[lone]]
    order = np.lexsort((terms, doc))
    doc, terms = doc[order], terms[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    weight = 1 + np.log2(np.diff(np.append(first, len(terms))))
    doc, terms = doc[first], terms[first]
    both = np.stack([terms, mix64(terms + np.uint64(0x632BE59BD9B4E019))], axis=1).view(np.uint8).reshape(len(terms), -1)
    for begin in range(0, n_docs, 1024):  # a histogram of 256 values a byte and text, turned into votes
        some = slice(*np.searchsorted(doc, [begin, begin + 1024]))
        size = min(1024, n_docs - begin)
        for k in range(BITS // 8):
            histogram = np.bincount((doc[some] - begin) * 256 + both[some, k], weight[some], size * 256).reshape(size, 256)
            out[begin : begin + size, k] = np.packbits(histogram @ VOTES > 0, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine that the share of differing bits stands for, 0 at least; 0 between an empty text and another."""
    apart = np.unpackbits(a ^ b, axis=1).sum(axis=1)
    near = np.clip(np.cos(np.pi * apart / BITS), 0, 1)
    near[(a.any(axis=1) != b.any(axis=1))] = 0
    return np.where(apart == 0, 1.0, near)


def with_fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """`docs` with its fingerprints in hexadecimal; null texts count as empty, equal texts have equal fingerprints."""
    schema = docs.drop(column).withColumn(column, F.lit(None).cast("string")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, text)):
            kept = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array([x.tobytes().hex() for x in fingerprints(batch.column(text))], pa.string())], names=[*kept, column])

    return docs.mapInArrow(rows, schema)


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = 3, column: str = "fingerprint") -> DataFrame:
    """All pairs of different fingerprints, one of `queries` and one of `corpus`, that differ in 1 to `radius` bits:
    query, found, distance.

    Both sides are reduced to distinct fingerprints first, so copies cost nothing; documents are joined back by
    fingerprint where they are wanted. Each of the tables permutes two of radius + 2 blocks to the front as its key, of
    which 64 bits of hash are shuffled: what meets by accident is dropped by its distance.
    """
    edges = np.linspace(0, BITS, radius + 3).astype(int)
    blocks = [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    bits = "".join(f"lpad(bin(cast(conv(substr(hex(f), {i}, 8), 16, 10) as bigint)), 32, '0') || " for i in range(1, BITS // 4, 8))[:-4]

    def tables(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.unhex(column).alias("f")).where("f is not null").distinct().withColumn("b", F.expr(bits))
        keys = [F.xxhash64(F.lit(i), *[F.substring("b", a + 1, n) for a, n in pair]) for i, pair in enumerate(combinations(blocks, 2))]
        return rows.select(F.col("f").alias(name), F.explode(F.array(*keys)).alias("key"))

    halves = [f"bit_count(cast(conv(substr(hex(query), {i}, 8), 16, 10) as bigint) ^ cast(conv(substr(hex(found), {i}, 8), 16, 10) as bigint))" for i in range(1, BITS // 4, 8)]
    pairs = tables(queries, "query").join(tables(corpus, "found"), "key").where("query <> found").withColumn("distance", F.expr(" + ".join(halves)).cast("int"))
    found = pairs.where(F.col("distance") <= radius).select("query", "found", "distance").distinct()
    return found.select(F.lower(F.hex("query")).alias("query"), F.lower(F.hex("found")).alias("found"), "distance")


OUT = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
OUT_DDL = "kind string, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _compared(part: int, keys: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
    own, other, changed = (fingerprints(pa.array(x, pa.string())) for x in (texts, nexts, edited))
    hexed = lambda x: [r.tobytes().hex() for r in x]
    columns = [["done"] * len(texts), [part] * len(texts), keys, list(map(len, texts)), [hashlib.sha256(x.encode()).hexdigest() for x in edited], hexed(own), hexed(changed), likeness(own, changed), likeness(own, other), [None] * len(texts)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text (its last third replaced by the start of the next document in
    descending order of `key`, the first after the last) and both likenesses.

    Texts are dealt out once, by ranges of the key; each range is compared in order, and only its two outer documents are
    passed on to be joined with the ranges beside it. Null keys come last, equal keys are ordered by text; a lone
    document is its own next. Null texts count as empty.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        whole = lambda kind, k, t: pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "doc_id": k, "text": t}], OUT)
        keys: list = []
        texts: list = []
        for batch in (x for b in batches for x in slices(b, 1)):
            if not texts:
                yield whole("head", batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            keys += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            if len(texts) > 1:
                yield _compared(part, keys[:-1], texts[:-1], texts[1:])
                keys, texts = keys[-1:], texts[-1:]
        if texts:
            yield whole("open", keys[0], texts[0])

    order = F.col("doc_id").desc_nulls_last()
    dealt = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange(order).sortWithinPartitions(order, "text")
    found = written(dealt.mapInArrow(rows, OUT_DDL))
    parts = found.where("kind = 'head'").select("part")
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    beside = parts.select("part", following.alias("next_part"))
    heads = found.where("kind = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    open_rows = found.where("kind = 'open'").select("part", "doc_id", "text").join(beside, "part").join(heads, "next_part").select("part", "doc_id", "text", "next_text")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            yield _compared(batch.column(0)[0].as_py(), *(batch.column(i).to_pylist() for i in (1, 2, 3)))

    return found.where("kind = 'done'").unionByName(open_rows.mapInArrow(closed, OUT_DDL)).drop("kind", "part", "text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and near_found: for ids divisible by 20 the number of other fingerprints of the whole table
    within RADIUS bits, by the block tables; null for others. Nulls, ties and empty tables as edit_likeness() says."""
    rows = edit_likeness(documents(spark, sf_dir, "doc_id", "text"))
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    near = near_fingerprints(rows.where(asked), rows, RADIUS).groupBy(F.col("query").alias("fingerprint")).agg(F.count("*").alias("near_found"))
    return rows.join(near, "fingerprint", "left").withColumn("near_found", F.when(asked, F.coalesce("near_found", F.lit(0))))
