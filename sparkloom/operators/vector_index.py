"""An inverted-file index over vectors, for inner products.

Coarse centroids cut the vectors into cells. What is left of a vector beyond its centroid is cut into subspaces, each
quantised by a codebook of its own, so a vector is one byte a subspace. A query probes the cells whose centroids it likes
best, scores what their codes stand for, and the short list is scored exactly with the vectors themselves.

Centroids and codebooks are fitted on a bounded sample (`FIT` vectors with the smallest hashes of ids); every vector is
coded. How many cells to probe and how long the short list must be is measured on held-out vectors (`HELD`), so that
`recall` of their nearest ones stay in reach. Codes lie in Parquet, in blocks sorted by cell. For a search they are joined with
the vectors that there are and dealt into tiles (`blocks`); how well a code must score for a query's short list is read off
the codes of the vectors that the codec was fitted on. So a short list is scored where its vectors are, and neither probes
nor short lists are shuffled, whose rows would grow with the square of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.sources.scratch import discarded, stored

from . import blocks

FIT, HELD = 16_384, 1_024
#: Vectors of a cell on average, cells at most, bits of a code's byte.
PER_CELL, CELLS = 256, 4096
CENTROIDS = 256
#: Components that a byte stands for.
SUBSPACE = 4
BLOCK = 1024


def _assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, some rows at a time."""
    square = (centres**2).sum(1)
    return np.concatenate([np.argmin(square - 2 * x[i : i + 4096] @ centres.T, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _fitted(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means, started from seeded rows."""
    centres = x[np.random.default_rng(0).permutation(len(x))[: max(1, min(k, len(x)))]].copy()
    for _ in range(rounds):
        own = _assigned(x, centres)
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=len(centres))
        some = np.flatnonzero(sizes)
        centres[some] = np.add.reduceat(x[order], (np.cumsum(sizes) - sizes)[some]) / sizes[some, None]
    return centres


class Codec:
    """Centroids, codebooks, and what was measured with them."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray) -> None:
        self.coarse, self.books = coarse, books  # cells x dim, subspaces x entries x width
        self.probes, self.short = len(coarse), 1.0
        #: Cells and codes of fitted vectors, and how many of them a short list holds for each result; none: not measured.
        self.sample, self.listed = (np.zeros(0, np.int32), np.zeros((0, len(books)), np.uint8)), 0.0

    def _parts(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and codes of a byte a subspace."""
        cells = _assigned(x, self.coarse)
        parts = self._parts(x - self.coarse[cells])
        return cells, np.stack([_assigned(parts[:, m], self.books[m]) for m in range(len(self.books))], 1).astype(np.uint8)

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        parts = self.books[np.arange(codes.shape[1]), codes]
        return self.coarse[cells] + parts.reshape(len(parts), -1)[:, : self.coarse.shape[1]]

    def reach(self, q: np.ndarray) -> np.ndarray:
        """How much each query likes the last of the cells that it probes."""
        if self.probes >= len(self.coarse):
            return np.full(len(q), -np.inf)
        last = -np.partition(-(q @ self.coarse.T), self.probes - 1, axis=1)[:, self.probes - 1]
        return last - 1e-9 * np.abs(last)

    def floors(self, q: np.ndarray, k: int) -> np.ndarray:
        """The score that a code must reach for the short list of each query's k best."""
        n = max(k, int(np.ceil(self.listed * k)))
        if not self.listed or n >= len(self.sample[0]):
            return np.full(len(q), -np.inf)
        rough, step = self.decoded(*self.sample), max(1, blocks.SCORES // len(self.sample[0]))
        return np.concatenate([np.zeros(0), *[np.partition(q[at : at + step] @ rough.T, -n, axis=1)[:, -n] for at in range(0, len(q), step)]])

    @classmethod
    def trained(cls, x: np.ndarray, size: int, k: int, recall: float) -> Codec:
        """Fitted on rows of x, for an index of `size` vectors, measured for the `k` nearest of held-out ones."""
        held = x[len(x) - min(HELD, len(x) // 8) :]
        fit = x[: len(x) - len(held)]
        coarse = _fitted(fit, int(np.clip(size // PER_CELL, 1, min(CELLS, max(1, len(fit) // 8)))))
        rest = fit - coarse[_assigned(fit, coarse)]
        width = min(SUBSPACE, x.shape[1])
        m = -(-x.shape[1] // width)
        rest = np.pad(rest, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(rest), m, width)
        books = [_fitted(rest[:, i], CENTROIDS) for i in range(m)]
        codec = cls(coarse, np.stack(books))
        if len(held) and len(fit) > k:
            codec._measured(fit, held, k, recall, size)
        return codec

    def _measured(self, fit: np.ndarray, held: np.ndarray, k: int, recall: float, size: int) -> None:
        """Probe as many cells, and keep as many of their codes, as hold all but a share of held-out vectors' nearest.

        A list for a larger index is longer in proportion; both shares of what is missed add up to 1 - recall.
        """
        exact = held @ fit.T
        best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
        cells, codes = self.coded(fit)
        likes = held @ self.coarse.T
        place = np.argsort(np.argsort(-likes, axis=1), axis=1)
        share = 1 - (1 - recall) / 2
        self.probes = int(np.quantile(np.take_along_axis(place, cells[best], 1), share, method="higher")) + 1
        rough = held @ self.decoded(cells, codes).T
        rank = np.stack([(r[None] > r[b][:, None]).sum(1) for r, b in zip(rough, best, strict=True)])
        self.sample, self.listed = (cells.astype(np.int32), codes), float(np.quantile(rank, share, method="higher") + 1) / k
        self.short = self.listed * max(1.0, size / len(fit))


class VectorIndex:
    """An index in a folder of its own, built from vectors (id, vector) of one length, null vectors left out."""

    def __init__(self, spark: SparkSession, path: str, codec: Codec, id_: str, kind: str) -> None:
        self.spark, self.path, self.codec, self.id, self.kind = spark, path, codec, id_, kind
        self.shared = spark.sparkContext.broadcast(codec)  # CELLS centroids and the codebooks at most

    @classmethod
    def built(cls, vectors: DataFrame, path: str, k: int = 10, recall: float = 0.97, id_: str = "vec_id", vector: str = "vector") -> VectorIndex:
        rows = vectors.where(F.col(vector).isNotNull()).select(id_, vector)
        sample = rows.orderBy(F.xxhash64(id_), id_).limit(FIT + HELD).toArrow()
        if not sample.num_rows:
            raise ValueError("an index needs vectors")
        dim = len(sample.column(1)[0])
        x = np.asarray(sample.column(1).combine_chunks().flatten(), np.float64).reshape(-1, dim)
        index = cls(vectors.sparkSession, path, Codec.trained(x, rows.count(), k, recall), id_, rows.schema[id_].dataType.simpleString())
        index._note()
        index.add(rows, vector, mode="overwrite")
        return index

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> VectorIndex:
        row = spark.read.parquet(f"{path}/codec").first()
        coarse = np.frombuffer(row["coarse"], np.float64).reshape(-1, row["dim"])
        codec = Codec(coarse, np.frombuffer(row["books"], np.float64).reshape(row["subspaces"], -1, row["width"]))
        codec.probes, codec.short, codec.listed = row["probes"], row["short"], row["listed"]
        codec.sample = (np.frombuffer(row["cells"], np.int32), np.frombuffer(row["codes"], np.uint8).reshape(-1, row["subspaces"]))
        return cls(spark, path, codec, row["id"], row["kind"])

    def _note(self) -> None:
        c = self.codec
        row = (bytearray(c.coarse.astype(np.float64).tobytes()), bytearray(c.books.astype(np.float64).tobytes()), c.coarse.shape[1], c.books.shape[0], c.books.shape[2], c.probes, c.short, c.listed, bytearray(c.sample[0].tobytes()), bytearray(c.sample[1].tobytes()), self.id, self.kind)
        self.spark.createDataFrame([row], "coarse binary, books binary, dim int, subspaces int, width int, probes int, short double, listed double, cells binary, codes binary, id string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/codec")

    def add(self, vectors: DataFrame, vector: str = "vector", mode: str = "append") -> None:
        """Code more vectors; those that are no more needn't be taken out, since the short list is joined with what there is."""
        shared, dim = self.shared, self.codec.coarse.shape[1]

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells, codes = shared.value.coded(np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "cell", "code"])

        rows = vectors.where(F.col(vector).isNotNull()).select(self.id, vector).mapInArrow(code, f"id {self.kind}, cell int, code binary")
        rows = stored(rows)
        sizes = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n")))  # a row for each of CELLS cells at most
        held = rows.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("id"), "n").alias("block")).agg(F.collect_list(F.struct("id", "code")).alias("held"))
        held.repartitionByRange("cell").sortWithinPartitions("cell").write.mode(mode).parquet(f"{self.path}/blocks")
        discarded(rows)

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector") -> DataFrame:
        """query_id, id, score (to six digits), rank: the k best of `vectors` that the index finds for each query."""
        shared, dim = self.shared, self.codec.coarse.shape[1]
        asked = queries.where(F.size(vector) == dim).select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
        live = vectors.where(F.size(vector) == dim).select(F.col(self.id).alias("id"), F.col(vector).alias("vector"))
        q_kind, id_kind = asked.schema["query_id"].dataType.simpleString(), live.schema["id"].dataType.simpleString()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = blocks.matrix(batch.column(1)) if batch.num_rows else np.zeros((0, dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.reach(q)), pa.array(shared.value.floors(q, k))], ["query_id", "vector", "reach", "floor"])

        def ranked(asking: blocks.Asking, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, ids, cells = blocks.matrix(run.column("vector")), run.column("id"), np.asarray(run.column("cell"))
            codes = np.frombuffer(b"".join(run.column("code").to_pylist()), np.uint8).reshape(len(cells), -1)
            rough = shared.value.decoded(cells, codes).astype(np.float32)
            who = np.flatnonzero(asking.q @ shared.value.coarse[cells[0]] >= asking.column["reach"])
            step = max(1, blocks.SCORES // len(x))
            for at in range(0, len(who), step):
                own = who[at : at + step]
                q, low = asking.q[own], asking.low(own)
                floor = np.where(np.isneginf(low), low, asking.column["floor"][own])  # a query without k vectors takes any
                i, j = np.nonzero(q.astype(np.float32) @ rough.T >= floor.astype(np.float32)[:, None])
                scores = blocks.paired(q, x, i, j)
                some = scores >= low[i]
                yield from asking.offer(own[i[some]], ids.take(pa.array(j[some])), scores[some])

        asking = asked.mapInArrow(probe, f"query_id {q_kind}, vector {asked.schema['vector'].dataType.simpleString()}, reach double, floor double")
        codes = self.spark.read.parquet(f"{self.path}/blocks").select("cell", "block", F.explode("held").alias("h")).select("cell", "block", "h.id", "h.code")
        tiles = blocks.dealt(asking, codes.join(live, "id"), k, ("cell", "block"), ("cell",))
        found = blocks.nearest(tiles, ranked, k, (q_kind, id_kind), ("cell",))
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("id").alias(self.id), "score", "rank")
