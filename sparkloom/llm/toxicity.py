"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positive examples and all other training documents, whatever their label, the
unlabelled ones. Features are words, word beginnings and pieces of long unbroken runs that occur at least once, twice or
four times in a text. A linear model in numpy minimises the class-prior-corrected risk, whose negative part is kept from going below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, mix64, slices, string_buffers, written

#: Lengths of word beginnings, in bytes, and the counts from which a feature holds.
STARTS = (5, 6, 7, 8, 10)
#: Lengths of the pieces, in bytes, that begin at every character of a run longer than a word is read.
LONGEST, PIECES = 32, (6, 10)
TIMES = (1, 2, 4)
#: Bounds of what is fitted on: features, positive and unlabelled examples.
FEATURES, POSITIVES, UNLABELLED = 512, 4000, 8000
THRESHOLD = 0.7
#: Keys of toxic rows, or features of positive examples, that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: A word's bytes: letters, digits and everything beyond ASCII but the separators below.
LETTERS = np.zeros(256, bool)
LETTERS[np.r_[48:58, 97:123, 128:256]] = True
_TABLE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x7F4A7C15))
_WEIGHTS = mix64(np.arange(LONGEST, dtype=np.uint64) + np.uint64(0x1B873593)) | np.uint64(1)
#: Ranges of Unicode spaces and punctuation: Latin-1, general, CJK and full-width forms.
SEPARATORS = [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def letters(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 texts belongs to a word."""
    solid = LETTERS[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3) | (data == 0xEF))
    long = data[lead] >= 0xE0
    second = data[lead + 1].astype(np.int64) & 63
    third = data[np.minimum(lead + 2, len(data) - 1)].astype(np.int64) & 63
    code = np.where(long, (data[lead].astype(np.int64) & 15) << 12 | second << 6 | third, (data[lead].astype(np.int64) & 31) << 6 | second)
    apart = np.zeros(len(lead), bool)
    for low, top in SEPARATORS:
        apart |= (code >= low) & (code <= top)
    solid[lead[apart]] = solid[lead[apart] + 1] = False
    solid[lead[apart & long] + 2] = False
    return solid


def beginnings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, emitted: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The sum over the bytes of each string, and for each of some lengths the strings that have it and their hashes."""
    sums = np.zeros(len(starts), np.uint64)
    live, out = np.arange(len(starts)), []
    for k in range(int(lengths.max()) if len(lengths) else 0):
        live = live[lengths[live] > k]
        sums[live] += _TABLE[data[starts[live] + k]] * _WEIGHTS[k]
        if k + 1 in emitted:
            out.append((live, mix64(sums[live] + np.uint64(k + 1))))
    return sums, out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text number and hash of each word and each word beginning of a batch, lower-cased.

    Words count up to 32 bytes. In longer runs (scripts without spaces, unbroken strings), pieces that begin at each
    further character are features as well, the same as beginnings of words, so that every byte takes part in one.
    """
    data, offs = string_buffers(pc.utf8_lower(column))
    solid = letters(data)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    sums, found = beginnings(data, starts, np.minimum(ends - starts, LONGEST), STARTS)
    docs, hashes = [doc[i] for i, _ in found], [h for _, h in found]
    wide = np.flatnonzero(ends - starts > LONGEST)
    if len(wide):
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[wide] + 1] += 1
        inside[ends[wide]] -= 1
        further = np.flatnonzero((np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80))
        run = np.searchsorted(starts, further, "right") - 1
        for i, h in beginnings(data, further, np.minimum(ends[run] - further, max(PIECES)), PIECES)[1]:
            docs.append(doc[run[i]])
            hashes.append(h)
    docs.append(doc)
    hashes.append(mix64(sums + np.uint64(0x5BD1E995)))
    return np.concatenate(docs), np.concatenate(hashes)


def counted(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text number and hash of each feature: (hash, times) pairs as hash + place of times, where the count is reached."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(doc)))
    doc, hashes = doc[first], hashes[first]
    held = [counts >= t for t in TIMES]
    return np.concatenate([doc[h] for h in held]), np.concatenate([hashes[h] + np.uint64(i) for i, h in enumerate(held)])


@dataclass
class Model:
    """Sorted hashes of the features, with a weight each."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if len(self.hashes) == 0:
            return np.zeros(n)
        doc, which = held(self.hashes, column)
        z = self.bias + np.bincount(doc, self.weights[which], n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held(vocabulary: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the place in the sorted `vocabulary` of each of its features that a batch's texts have."""
    doc, hashes = features(column)
    bases = np.unique((vocabulary[:, None] - np.arange(len(TIMES), dtype=np.uint64)).ravel())
    at = np.minimum(np.searchsorted(bases, hashes), len(bases) - 1)
    some = bases[at] == hashes
    doc, hashes = counted(doc[some], hashes[some])
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    some = vocabulary[at] == hashes
    return doc[some], at[some]


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear model of the non-negative positive-unlabelled risk with logistic loss, by Adam over all examples.

    risk = prior * loss(positive as 1) + max(0, loss(unlabelled as 0) - prior * loss(positive as 0)); where the second
    part is below zero, the step goes against its gradient alone.
    """
    m = positive.shape[1]
    theta = np.zeros(m + 1)
    theta[m] = np.log(prior / (1 - prior))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z).mean()

    def mean_grad(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.append(x.T @ d.astype(x.dtype), d.sum()) / len(d)

    for t in range(1, rounds + 1):
        zp, zu = positive @ theta[:m].astype(positive.dtype) + theta[m], unlabelled @ theta[:m].astype(positive.dtype) + theta[m]
        negative = loss(-zu) - prior * loss(-zp)
        grad_negative = mean_grad(unlabelled, sigmoid(zu)) - prior * mean_grad(positive, sigmoid(zp))
        grad = -grad_negative if negative < 0 else prior * mean_grad(positive, sigmoid(zp) - 1) + grad_negative
        grad[:m] += decay * theta[:m]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:m], float(theta[m])


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from rows that held_out() leaves. Feature counts cover all of them; only the final fit takes samples, of
    POSITIVES and UNLABELLED rows in the order of a hash of the key (with the text where it is null). Without positive examples all scores are 0."""
    names = labels.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    rows = docs.where(~held_out(key)).select(F.col(key).cast("long").alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    known = names.agg(F.count("*").alias("n"), F.sum((F.col("__toxic") == 1).cast("long")).alias("p")).first()
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not known["p"]:
        return none
    prior = float(np.clip(known["p"] / known["n"], 0.01, 0.5))
    toxic = names.where("__toxic = 1").select(F.col("doc_id").alias("__key"))
    toxic = F.broadcast(toxic) if known["p"] <= BROADCAST_ROWS else toxic  # else Spark shuffles the texts
    positive = rows.join(toxic, "__key", "left_semi").select("__key", "__text")

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 0)):
            hashes = np.sort(counted(*features(batch.column(0)))[1])
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else hashes.astype(np.int64)
            hashes, n = hashes[first], np.diff(np.append(first, len(hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])

    n_positive = positive.count()
    tally = lambda texts: texts.select("__text").mapInArrow(vocabulary, "feature long, n long")
    in_positive = written(tally(positive).groupBy("feature").agg(F.sum("n").alias("p")))
    n_features, n_all = in_positive.count(), rows.count()
    if not n_features:
        return none
    looked = in_positive.select("feature")
    looked = F.broadcast(looked) if n_features <= BROADCAST_ROWS else looked
    in_all = tally(rows).join(looked, "feature", "left_semi").groupBy("feature").agg(F.sum("n").alias("n"))
    p, u = (F.col("p") + 0.1) / (n_positive + 1), (F.col("n") + 0.5) / (n_all + 1)
    gain = (p - u) / F.sqrt(u * (1 - F.least(u, F.lit(0.999))))
    best = in_positive.join(in_all, "feature").select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()
    vocabulary_kept = np.sort(np.array([r["feature"] for r in best], np.int64).view(np.uint64))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 1)):
            doc, which = held(vocabulary_kept, batch.column(1))
            order = np.argsort(doc, kind="stable")
            offs = np.searchsorted(doc[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(which[order].astype(np.int32)))], names=["key", "which"])

    def sample(texts: DataFrame, n: int, of: int) -> np.ndarray:
        share = min(1.0, 1.2 * n / max(of, 1) + 100 / max(of, 1))
        seed = F.xxhash64("__key", F.when(F.col("__key").isNull(), F.col("__text")))
        some = texts.select(seed.alias("__seed"), "__text").where(F.pmod("__seed", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        got = some.mapInArrow(examples, "key long, which array<int>").orderBy(F.pmod("key", F.lit(1_000_000)), "key", F.array_sort("which")).limit(n).collect()
        x = np.zeros((len(got), len(vocabulary_kept)), np.float32)
        for i, r in enumerate(got):
            x[i, r["which"]] = 1
        return x

    weights, bias = fit_nnpu(sample(positive, POSITIVES, n_positive), sample(rows, UNLABELLED, n_all), prior)
    return Model(vocabulary_kept, weights, bias)


def with_scores(docs: DataFrame, model: Model, text: str = "text", column: str = "toxicity") -> DataFrame:
    """`docs` with a score from 0 to 1. Null and empty texts have scores too; rows are independent, so ties, repeated rows
    and null keys need nothing, and an empty table stays empty. A column of the new one's name is replaced; others of any
    name pass through."""
    schema = docs.drop(column).withColumn(column, F.lit(None).cast("double")).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, text)):
            kept = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(model.score(pc.fill_null(batch.column(text), "")))], names=[*kept, column])

    return docs.mapInArrow(scored, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of every document; nulls, ties and empty tables as train() and with_scores() say."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = with_scores(docs, model).drop("text")
    return scores.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
