"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own, so K centroids a half cut space into K * K cells. A query walks
pairs of centroids by their summed distance with a heap and asks the cells for their entries, which are ranked by their
exact distance. It first takes cells until they hold `LEAST` entries; the tenth of those bounds how far its neighbours can
be, and it goes on only while the next cell's summed distance is within that bound plus `slack`, in rounds of four times as
many entries, each with a closer bound. The slack is measured: of held-out vectors and their nearest ones, all but a share
of `MISSED` have a cell that is not further than it.

Codebooks and slack are fitted on a bounded sample, with the smallest hashes of ids; all vectors are indexed. Of equal
vectors only the eleven smallest ids can be found by anyone, so only they are entries. A cell that holds a large share of
all entries gets codebooks of its own, level by level. Queries and entries meet in blocks of a cell, joined by the cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, guarded, written

#: Vectors that codebooks are fitted on, and those that the slack is measured on.
FIT, HELD = 16_384, 2_048
#: Entries of a cell on average, and centroids of a half at most.
PER_CELL, MOST = 64, 1024
#: A cell of more than 1 / SHARE of all entries, and of more than this many, is split; so many levels at most.
SHARE, LARGE, LEVELS = 256, 8192, 4
#: Entries that a query looks at in any case, and how many times as many it has looked at after each further round.
LEAST, FURTHER = 1000, 4
MISSED = 0.05
#: Entries and queries of a block.
BLOCK = 256
TOP = 10
Books = dict[int, tuple[np.ndarray, np.ndarray, int]]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each row, some rows at a time."""
    if not centres.shape[1]:
        return np.zeros(len(x), np.int64)
    square = (centres**2).sum(1)
    return np.concatenate([np.argmin(square - 2 * x[at : at + 2048] @ centres.T, 1) for at in range(0, len(x), 2048)] or [np.zeros(0, np.int64)])


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of k-means from seeded rows."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(10):
        near = _nearest(x, centres)
        sizes = np.bincount(near, minlength=len(centres))
        order, full = np.argsort(near, kind="stable"), np.flatnonzero(sizes)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(sizes) - sizes)[full]) / sizes[full, None]
    return centres


def _books(x: np.ndarray, entries: int, base: int) -> tuple[np.ndarray, np.ndarray, int]:
    k = int(np.clip(np.sqrt(entries / PER_CELL), 1, min(MOST, max(1, len(x) // 8))))
    half = x.shape[1] // 2
    return _codebook(x[:, :half], k, 1), _codebook(x[:, half:], k, 2), base


def _cells(x: np.ndarray, book: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    first, second, base = book
    half = first.shape[1]
    return base + _nearest(x[:, :half], first) * len(second) + _nearest(x[:, half:], second)


def walk(query: np.ndarray, books: Books) -> Iterator[tuple[float, int]]:
    """All cells with their summed squared distances, the smallest on the heap first; a split cell gives way to its parts."""
    heap, order = [], count()

    def enter(book: tuple[np.ndarray, np.ndarray, int]) -> None:
        first, second, base = book
        half = first.shape[1]
        a, b = ((first - query[:half]) ** 2).sum(1), ((second - query[half:]) ** 2).sum(1)
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        side = (a[i].tolist(), b[j].tolist(), i.tolist(), j.tolist(), base, len(second))
        heapq.heappush(heap, (side[0][0] + side[1][0], next(order), 0, 0, side))

    enter(books[-1])
    while heap:
        score, _, i, j, side = heapq.heappop(heap)
        a, b, left, right, base, width = side
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], next(order), i, j + 1, side))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], next(order), i + 1, 0, side))
        cell = base + left[i] * width + right[j]
        if cell in books:
            enter(books[cell])
        else:
            yield score, cell


def _slack(fit: np.ndarray, held: np.ndarray, book: tuple[np.ndarray, np.ndarray, int]) -> float:
    """By how much the summed distance of the cell of one of a vector's nearest exceeds their own, but for MISSED of them."""
    first, second, _ = book
    half = first.shape[1]
    coded = np.hstack([first[_nearest(fit[:, :half], first)], second[_nearest(fit[:, half:], second)]])
    excess = []
    for at in range(0, len(held), 256):
        q = held[at : at + 256]
        near = (q**2).sum(1)[:, None] + (fit**2).sum(1) - 2 * q @ fit.T
        best = np.argpartition(near, min(TOP, len(fit)) - 1, axis=1)[:, :TOP]
        excess.append((((coded[best] - q[:, None]) ** 2).sum(2) - np.take_along_axis(near, best, 1)).ravel())
    return float(np.quantile(np.concatenate(excess), 1 - MISSED)) if excess else 0.0


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector of the rows that take part, one for each id.

    Null ids, and vectors that are null, zero or hold null or non-finite components, take no part; nor do vectors of another
    length than most have (the longer of two equally common ones counts). A repeated id counts once, with the least of its
    vectors. Other columns, whatever their names, are not looked at.
    """
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull()).where(fine)
    rows = rows.groupBy("vec_id").agg(F.min(column).alias("vector"))
    rows = written(rows)
    common = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("vector") == (common["length"] if common else 0))


class MultiIndex:
    """Entries in a table of blocks by cell, and what queries need to walk the cells."""

    def __init__(self, vectors: DataFrame, top: int = TOP) -> None:
        self.spark, self.top = vectors.sparkSession, top
        rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
        entries = written(vectors.withColumn("__rank", rank).where(F.col("__rank") <= top + 1).drop("__rank"))
        self.size = entries.count()
        if not self.size:
            return
        sample = self._sampled(entries, FIT + HELD)
        self.dim = sample.shape[1]
        held = sample[len(sample) - min(HELD, len(sample) // 8) :]
        fit = sample[: len(sample) - len(held)]
        self.books: Books = {-1: _books(fit, self.size, 0)}
        self.slack = _slack(fit, held, self.books[-1])
        coded = written(self._coded(entries, [-1]))
        self.stop = len(self.books[-1][0]) * len(self.books[-1][1])
        for _ in range(LEVELS):
            large = coded.groupBy("cell").count().where(F.col("count") > max(LARGE, self.size // SHARE))
            parts = [r for r in large.collect() if r["cell"] not in self.books]  # fewer than SHARE
            if not parts:
                break
            for r in parts:
                own = self._sampled(coded.where(F.col("cell") == r["cell"]), FIT)
                self.books[r["cell"]] = _books(own, r["count"], self.stop)
                self.stop += len(self.books[r["cell"]][0]) * len(self.books[r["cell"]][1])
            ids = [r["cell"] for r in parts]
            again = written(coded.where(~F.col("cell").isin(ids)).unionByName(self._coded(coded.where(F.col("cell").isin(ids)), ids)))
            dropped(coded)
            coded = again
        sizes = coded.groupBy("cell").count().toArrow()  # a row for each cell: K * K at most, and the same for each split cell
        self.sizes = np.zeros(self.stop, np.int64)
        self.sizes[np.asarray(sizes["cell"])] = np.asarray(sizes["count"])
        self.blocks = written(self._blocked(coded, "vec_id"))
        dropped(entries, coded)
        self.shared = self.spark.sparkContext.broadcast((self.books, self.sizes))

    def _sampled(self, rows: DataFrame, most: int) -> np.ndarray:
        taken = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
        lengths = len(taken["vector"][0])
        return _matrix(taken["vector"], lengths)

    def _coded(self, rows: DataFrame, cells: list[int]) -> DataFrame:
        """vec_id, vector and cell of rows of the given cells (-1: all rows)."""
        books, dim = self.spark.sparkContext.broadcast({c: self.books[c] for c in cells}), self.dim
        whole = cells == [-1]

        def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("vector"), dim)
                old = np.full(len(x), -1) if whole else np.asarray(batch.column("cell"))
                new = np.empty(len(x), np.int64)
                for cell in np.unique(old):
                    own = old == cell
                    new[own] = _cells(x[own], books.value[int(cell)])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(new)], ["vec_id", "vector", "cell"])

        kind = dict(rows.dtypes)["vector"]
        return rows.mapInArrow(code, f"vec_id long, vector {kind}, cell long")

    def _blocked(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows of a cell in blocks of some BLOCK, dealt by hashes of `key`; sizes are a row for each cell."""
        sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("n_blocks"))
        dealt = rows.join(guarded(sizes, 24), "cell").withColumn("block", F.pmod(F.xxhash64(key), "n_blocks"))
        others = [c for c in rows.columns if c != "cell"]
        return dealt.groupBy("cell", "block").agg(*[F.collect_list(F.struct(*others)).alias("rows")])

    def _asked(self, queries: DataFrame, after: int, until: int) -> DataFrame:
        """The cells that each query looks at once it has seen `after` entries, and until it has seen `until`, within its bound."""
        shared, dim, slack = self.shared, self.dim, self.slack

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, sizes = shared.value
            for batch in batches:
                x, bounds = _matrix(batch.column("vector"), dim), np.asarray(batch.column("bound").fill_null(np.inf)) ** 2 + slack
                for i in range(len(x)):
                    cells, seen = [], 0
                    for score, cell in walk(x[i], books):
                        if seen >= until or (seen >= after and score > bounds[i]):
                            break
                        if sizes[cell] and seen >= after:
                            cells.append(cell)
                        seen += int(sizes[cell])
                    one = batch.slice(i, 1)
                    if cells:
                        again = pa.array(np.zeros(len(cells), np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *[one.column(c).take(again) for c in ("query_id", "vector", "bound")]], ["cell", "query_id", "vector", "bound"])

        kind = dict(queries.dtypes)["vector"]
        return queries.select("query_id", "vector", "bound").mapInArrow(ask, f"cell long, query_id long, vector {kind}, bound double")

    def _ranked(self, asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the nearest entries of the cells asked, exactly scored, `top` of each task's at most."""
        dim, top = self.dim, self.top
        met = self._blocked(asked, "query_id").select("cell", F.col("rows").alias("asking")).join(self.blocks.select("cell", F.col("rows").alias("held")), "cell")

        def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[float, int]]] = {}

            def out() -> pa.RecordBatch:
                flat = [(q, v, s) for q, found in best.items() for s, v in found]
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

            for batch in batches:
                for row in range(batch.num_rows):
                    asking, held = (batch.column(c).slice(row, 1).flatten() for c in ("asking", "held"))
                    q, x = (_matrix(side.field("vector"), dim) for side in (asking, held))
                    ids, found = np.asarray(held.field("vec_id")), np.asarray(asking.field("query_id"))
                    bounds = np.asarray(asking.field("bound").fill_null(np.inf))
                    norms = (x**2).sum(1)
                    near = norms + (q**2).sum(1)[:, None] - 2 * q @ x.T
                    error = 1e-9 * (norms.max() + (q**2).sum(1))
                    for i, query in enumerate(found.tolist()):
                        own = best.get(query, [])
                        limit = min(bounds[i], own[top - 1][0] if len(own) >= top else np.inf) ** 2 + error[i]
                        close = np.flatnonzero(near[i] <= limit)
                        if len(close) > 4 * top:
                            kth = np.partition(near[i][close], top)[top]
                            close = close[near[i][close] <= kth + error[i]]
                        close = close[ids[close] != query]
                        if len(close):
                            exact = np.sqrt(((x[close] - q[i]) ** 2).sum(1))
                            best[query] = sorted([*own, *zip(exact.tolist(), ids[close].tolist(), strict=True)])[:top]
                    if len(best) > 100_000:
                        yield out()
                        best.clear()
            if best:
                yield out()

        return met.mapInArrow(rank, "query_id long, vec_id long, score double")

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score of the nearest entries found for each row of `queries` (query_id, vector)."""
        if not self.size:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        asking = queries.select("query_id", "vector", F.lit(None).cast("double").alias("bound"))
        found, after, until = None, 0, max(LEAST, self.top + 1)
        while True:
            asked = written(self._asked(asking, after, until))
            if asked.isEmpty():
                break
            near = self._ranked(asked) if found is None else found.drop("rank").unionByName(self._ranked(asked))
            nearest = written(near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.top))
            dropped(asked, *([] if found is None else [found]))
            found, after, until = nearest, until, until * FURTHER
            bounds = found.where(F.col("rank") == self.top).select("query_id", F.col("score").alias("bound"))
            asking = queries.select("query_id", "vector").join(bounds, "query_id", "left")
        if found is None:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return found.select("query_id", "rank", "vec_id", "score")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: the ten nearest found of each vector whose id is divisible by 100; what takes part, ties,
    repeated rows and empty tables as usable() says."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return MultiIndex(vectors).search(vectors.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"))
