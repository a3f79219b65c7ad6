import numpy as np
import pytest

from sparkloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, vector string, cell int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, queries):
    """The ten nearest of each query, of rows of finite vectors of one length, known by distinct ids."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = []
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        out += [(q, r + 1, int(ids[k]), float(d[k])) for r, k in enumerate(order)]
    return sorted(out)


def searched(spark, rows, tmp_path):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, neighbours.op13_neighbours(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))


def clusters(n, dim=12, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, dim))
    return [(i, (centres[i % 40] + 0.1 * draw.normal(size=dim)).tolist()) for i in range(n)]


def test_op13_on_awkward_rows(spark, tmp_path):
    rows = clusters(300, 5)
    same = [(1000 + i, [1.0, 2, 3, 4, 5]) for i in range(40)]
    bad = [(None, [1, 2, 3, 4, 5]), (400, None), (500, [0, 0, 0, 0, 0]), (600, [1, None, 2, 3, 4]), (700, [1, 2, float("nan"), 4, 5]), (800, [1, 2, float("inf"), 4, 5]), (900, [1, 2]), (2000, [])]
    got = searched(spark, rows + same + same[:5] + rows[:3] + bad, tmp_path)
    assert got == brute(rows + same, [0, 100, 200, 1000])


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0])], [(0, [1.0]), (100, [2.0]), (7, [3.0])]])
def test_few_vectors(spark, tmp_path, rows):
    good = [r for r in rows if r[1]]
    assert searched(spark, rows, tmp_path) == (brute(good, [i for i, _ in good if i % 100 == 0]) if good else [])


def test_recall_and_share_of_entries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST", 100)
    rows = clusters(6000)
    index = neighbours.MultiIndex(neighbours.usable(table(spark, rows)))
    queries = neighbours.usable(table(spark, rows)).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = index.search(queries).collect()
    want = {(q, v) for q, _, v, _ in brute(rows, range(0, 6000, 100))}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.95 * len(want)
    first = index._asked(queries.selectExpr("query_id", "vector", "cast(0.3 AS double) AS bound"), 0, 10**9).collect()
    assert sum(int(index.sizes[r["cell"]]) for r in first) < 0.3 * 6000 * 60


def test_a_large_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LARGE", 200)
    monkeypatch.setattr(neighbours, "SHARE", 8)
    draw = np.random.default_rng(1)
    rows = clusters(1500, 6) + [(i, (np.ones(6) + 1e-3 * draw.normal(size=6)).tolist()) for i in range(1500, 3000)]
    index = neighbours.MultiIndex(neighbours.usable(table(spark, rows)))
    assert len(index.books) > 1 and index.sizes.sum() == 3000 and index.sizes.max() < 1000
    seen = [cell for _, cell in neighbours.walk(np.ones(6), index.books)]
    assert len(seen) == len(set(seen)) and set(np.flatnonzero(index.sizes)) <= set(seen)
    queries = neighbours.usable(table(spark, rows)).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["vec_id"]) for r in index.search(queries).collect()}
    want = {(q, v) for q, _, v, _ in brute(rows, range(0, 3000, 100))}
    assert len(got & want) >= 0.9 * len(want)


def test_walk_is_in_order():
    draw = np.random.default_rng(2)
    books = {-1: (draw.normal(size=(9, 3)), draw.normal(size=(7, 4)), 0)}
    q = draw.normal(size=7)
    walked = list(neighbours.walk(q, books))
    sums = ((books[-1][0] - q[:3]) ** 2).sum(1)[:, None] + ((books[-1][1] - q[3:]) ** 2).sum(1)
    assert len(walked) == 63 and np.allclose([s for s, _ in walked], np.sort(sums.ravel())) and np.allclose([s for s, _ in walked], [sums.ravel()[c] for _, c in walked])
