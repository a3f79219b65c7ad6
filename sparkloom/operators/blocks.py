"""Queries and vectors dealt into tiles: a task holds some of the queries and streams past them its share of the vectors.

What is shuffled is each vector once for every `QUERY_BYTES` of queries, each query once for every share of the vectors,
and k rows for each query of a tile. Pairs of a query and a vector never leave the task that scores them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.sources.scratch import stored

#: Bytes of a tile's queries with their best ones, about.
QUERY_BYTES = 32 << 20
#: Scores that a task holds at a time, and bytes of pairs that are scored one by one.
SCORES, PAIR_BYTES = 1 << 20, 32 << 20


def dealt(queries: DataFrame, vectors: DataFrame, k: int | None, by: tuple[str, ...], order: tuple[str | Column, ...] = ()) -> DataFrame:
    """Rows of `queries` (query_id, vector, others) and `vectors` (id, vector, others) by tile, the queries (asks) first.

    Vectors are dealt by hashes of their columns `by` and come sorted by length and `order`. Empty and null vectors are left out.
    """
    spark = vectors.sparkSession
    if queries.schema["vector"].dataType != vectors.schema["vector"].dataType:
        queries, vectors = (rows.withColumn("vector", F.col("vector").cast(T.ArrayType(T.DoubleType()))) for rows in (queries, vectors))
    queries = stored(queries.where(F.size("vector") > 0))
    weight = queries.agg(F.sum(8 * F.size("vector") + 32 * (k or 0))).first()[0] or 0
    groups = max(1, math.ceil(weight / QUERY_BYTES))
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    parts = max(1, math.ceil(wanted / groups))
    tile = (F.col("group") * parts + F.col("part")).cast("int").alias("tile")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda n, *columns: F.pmod(F.xxhash64(*columns), F.lit(n))
    asking = queries.withColumn("group", some(groups, "query_id")).withColumn("part", every(parts)).select(tile, F.lit(True).alias("asks"), *queries.columns)
    held = vectors.where(F.size("vector") > 0).withColumn("part", some(parts, *by)).withColumn("group", every(groups)).select(tile, F.lit(False).alias("asks"), *vectors.columns)
    both = asking.unionByName(held, allowMissingColumns=True)
    return both.repartitionById(groups * parts, "tile").sortWithinPartitions("tile", F.desc("asks"), F.size("vector"), *order)


def matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten().fill_null(0.0), np.float64).reshape(len(column), -1)


def _runs(batch: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which the tile, the side, the vectors' length and `keys` stay the same."""
    columns = [np.asarray(batch.column("vector").value_lengths()), *[np.asarray(batch.column(c).cast(pa.int32()).fill_null(-1)) for c in ("tile", "asks", *keys)]]
    ends = [*np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1, batch.num_rows]
    for begin, end in zip([0, *ends[:-1]], ends, strict=True):
        if end > begin:
            yield batch.slice(begin, end - begin)


def _ranked(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of ids."""
    return np.asarray(ids) if pa.types.is_integer(ids.type) and not ids.null_count else np.asarray(pc.rank(ids, tiebreaker="dense"))


class Asking:
    """A tile's queries of one length, with the k best vectors that each has met."""

    def __init__(self, k: int | None) -> None:
        self.k, self.rows, self.met, self.size = k, [], [], 0

    def begun(self) -> None:
        """From now on vectors come, and no queries any more."""
        if self.rows:
            self.rows = pa.concat_batches(self.rows)
            self.names, self.q = self.rows.column("query_id"), matrix(self.rows.column("vector"))
            self.bound = np.full(len(self.q), -np.inf)  # the k-th best score, once there are k
            self.column = {f.name: np.asarray(self.rows.column(f.name)) for f in self.rows.schema if pa.types.is_floating(f.type)}
            self.rows = []

    def low(self, own: slice | np.ndarray) -> np.ndarray:
        """Scores below these don't matter any more, rounded or not."""
        bound = self.bound[own]
        return bound - 1e-6 - 1e-9 * np.abs(np.where(np.isfinite(bound), bound, 0.0))

    def offer(self, own: np.ndarray, ids: pa.Array, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Vectors for the queries with the numbers `own`, with rounded scores; without k they are passed on at once."""
        if len(own):
            self.met.append((own, ids, scores))
            self.size += len(own)
        if self.k is None:
            yield from self.out()
        elif self.size > max(SCORES, 2 * self.k * len(self.q)):
            self._settled()

    def _settled(self) -> None:
        """Keep each query's k best, of equal ones the smaller ids."""
        own, scores = (np.concatenate([m[i] for m in self.met]) for i in (0, 2))
        ids = pa.concat_arrays([m[1] for m in self.met])
        order = np.lexsort((_ranked(ids), -scores, own))
        place = np.arange(len(order)) - np.searchsorted(own[order], own[order])
        kept = order[place < self.k]
        last = order[place == self.k - 1]
        self.bound[own[last]] = scores[last]
        self.met, self.size = [(own[kept], ids.take(pa.array(kept)), scores[kept])], len(kept)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.met and self.k is not None:
            self._settled()
        for own, ids, scores in self.met:
            for at in range(0, len(own), 1 << 16):
                piece = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([self.names.take(pa.array(own[piece])), ids[piece], pa.array(scores[piece])], ["query_id", "id", "score"])
        self.met, self.size = [], 0


def nearest(tiles: DataFrame, score: Callable[[Asking, pa.RecordBatch], Iterator[pa.RecordBatch]], k: int | None, kinds: tuple[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, score: what `score` offers to each tile's queries, slice by slice of its vectors with the same `keys`."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asking = None, {}
        for batch in batches:
            for run in _runs(batch, keys):
                at, dim = run.column("tile")[0].as_py(), len(run.column("vector")[0])
                if at != tile:
                    for a in asking.values():
                        yield from a.out()
                    tile, asking = at, {}
                if run.column("asks")[0].as_py():
                    asking.setdefault(dim, Asking(k)).rows.append(run)
                elif dim in asking:
                    asking[dim].begun()
                    yield from score(asking[dim], run)
        for a in asking.values():
            yield from a.out()

    return tiles.mapInArrow(met, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def compared(floor: float | None) -> Callable[[Asking, pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Inner products, to six digits, of all queries and vectors, or of those that reach `floor`."""

    def score(asking: Asking, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, ids = matrix(run.column("vector")), run.column("id")
        step = max(1, SCORES // len(x))
        for at in range(0, len(asking.q), step):
            scores = asking.q[at : at + step] @ x.T
            low = asking.low(slice(at, at + step))
            fresh = np.flatnonzero(np.isneginf(low))
            if asking.k is not None and len(fresh) and len(x) > asking.k:
                low[fresh] = np.partition(scores[fresh], -asking.k, axis=1)[:, -asking.k] - 1e-6
            if floor is not None:
                low = np.maximum(low, floor - 1e-6)
            i, j = np.nonzero(scores >= low[:, None])
            found = np.round(scores[i, j], 6) + 0.0
            if floor is not None:
                reached = found >= floor
                i, j, found = i[reached], j[reached], found[reached]
            yield from asking.offer(i + at, ids.take(pa.array(j)), found)

    return score


def paired(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products, to six digits, of rows i of q and j of x."""
    if 16 * len(i) > len(q) * len(x):
        return np.round((q @ x.T)[i, j], 6) + 0.0
    step = max(1, PAIR_BYTES // (16 * q.shape[1]))
    found = [np.einsum("ij,ij->i", q[i[at : at + step]], x[j[at : at + step]]) for at in range(0, len(i), step)]
    return np.round(np.concatenate([np.zeros(0), *found]), 6) + 0.0
