"""Exact kNN / radius join against NumPy brute force, with many pivots and
tiny blocks so that cell pruning and hot-cell chunking are exercised."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import neighbors as N
from conftest import SF01


def _brute_knn(keys, X, k, exclude_self):
    out = {}
    for i, q in enumerate(keys):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        cand = [(round(d[j], 9), keys[j]) for j in range(len(keys)) if not (exclude_self and j == i)]
        out[q] = [kk for _, kk in sorted(cand)[:k]]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "SUB", 16)


def test_knn_many_pivots(spark, small_blocks):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("f"))
    got = N.knn(v, v, "vec_id", "f", 5, exclude_self=True, n_pivots=16).toPandas()
    pdf = v.toPandas().sort_values("vec_id")
    X = np.stack(pdf["f"].to_numpy())
    want = _brute_knn(list(pdf["vec_id"]), X, 5, True)
    got_map = {q: list(g.sort_values("rank")["r_key"]) for q, g in got.groupby("q_key")}
    assert got_map == want


def test_knn_hot_cell_duplicates(spark, small_blocks):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]  # one point copied 300 times
    rows += [(300 + i, list(map(float, rng.normal(size=3) * 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, f array<double>")
    got = N.knn(df, df, "k", "f", 4, exclude_self=True, n_pivots=8).toPandas()
    X = np.array([r[1] for r in rows])
    want = _brute_knn([r[0] for r in rows], X, 4, True)
    got_map = {q: list(g.sort_values("rank")["r_key"]) for q, g in got.groupby("q_key")}
    assert got_map == want


def test_radius_join_many_pivots(spark, small_blocks):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("f"))
    got = N.radius_join(v, v, "vec_id", "f", 1.16, n_pivots=24).toPandas()
    pdf = v.toPandas()
    X = np.stack(pdf["f"].to_numpy())
    keys = pdf["vec_id"].to_numpy()
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    ii, jj = np.nonzero(np.round(D, 9) <= 1.16)
    want = sorted(zip(keys[ii].tolist(), keys[jj].tolist()))
    assert sorted(zip(got["q_key"].tolist(), got["r_key"].tolist())) == want


def test_few_cells_are_visited_on_clustered_data():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 8))[rng.integers(0, 40, 20000)] * 10 + rng.normal(size=(20000, 8))
    cells = N.Cells(X)
    Q = X[:500]
    row, _ = cells.tree.visit(Q, cells.reach(Q, np.ones(len(X), dtype=np.int64), 11))
    assert len(row) < 0.2 * len(Q) * len(cells.rows)


def test_dense_blob_sends_links_linear_in_its_points():
    X = np.random.default_rng(2).normal(size=(3000, 3)) * 0.3
    cells = N.Cells(X)
    q, r, a, b = cells.spanning(X, 0.5)
    assert len(q) + len(a) <= 2 * len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    assert (np.minimum(cells.counts(X, np.ones(len(X), dtype=np.int64), 0.5, 7), 7) == np.minimum((D <= 0.5).sum(1), 7)).all()
    up = list(range(len(X)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in zip([*q, *a], [*r, *b]):
        up[max(top(i), top(j))] = min(top(i), top(j))
    want = _plain_dbscan(X, 0.5, 1)
    assert len({(top(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({top(i) for i in range(len(X))})


def _plain_dbscan(X, eps, least):
    near = np.round(np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)), 9) <= eps
    core, label = near.sum(1) >= least, np.full(len(X), -1)
    for i in range(len(X)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = i
                    todo.append(j)
    for i in np.flatnonzero(~core):
        mine = label[near[i] & core]
        label[i] = mine.min() if len(mine) else -1
    ids = {x: n for n, x in enumerate(sorted(set(label) - {-1}))}
    return [ids.get(x, -1) for x in label]


def test_dbscan_over_many_blocks(spark, monkeypatch):
    from tidewatch.operators import cluster
    monkeypatch.setattr(cluster, "BLOCK", 40)
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(size=(150, 2)) * 0.4, rng.normal(size=(100, 2)) * 0.5 + 4, rng.uniform(-6, 8, size=(60, 2)), np.full((50, 2), 9.0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "k long, f array<double>")
    got = {r.k: r.cluster for r in cluster.dbscan(df, "k", "f", 0.5, 5).collect()}
    assert [got[i] for i in range(len(X))] == _plain_dbscan(X, 0.5, 5)


def _linked(n, pairs):
    label = list(range(n))
    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in pairs:
        label[top(int(a))] = top(int(b))
    return [top(x) for x in range(n)]


def test_points_in_many_dimensions_are_screened_without_cells():
    rng = np.random.default_rng(5)
    X = rng.normal(size=(1500, 24)) + 300.0
    X[3], X[4], X[5] = 1e9, -1e9, X[6]
    cells = N.Cells(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    eps = float(np.quantile(D, 0.01))
    assert cells.spread(X, np.full(len(X), eps))
    found = [p for p in cells.pairs(X, np.full(len(X), eps)) if p is not None]
    got = set(zip(*(np.concatenate(x).tolist() for x in list(zip(*found))[:2])))
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.round(D, 9) <= eps))))
    bound = cells.tighten(X, 6, np.full(len(X), np.inf))
    assert (bound >= np.sort(D, axis=1)[:, 5]).all() and (D[10:110] <= bound[10:110, None]).sum() < 100 * 20
    near = (D <= eps).sum(1)
    assert (np.minimum(cells.counts(X, np.ones(len(X), dtype=np.int64), eps, 7), 7) == np.minimum(near, 7)).all()
    q, r, a, b = cells.spanning(X, eps)
    assert len(q) + len(a) < 6 * len(X)
    mine, plain = _linked(len(X), [*zip(q, r), *zip(a, b)]), _linked(len(X), zip(*np.nonzero(D <= eps)))
    assert len(set(zip(mine, plain))) == len(set(mine)) == len(set(plain))


def test_rows_travel_to_few_blocks_and_are_not_written(spark, monkeypatch):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(900, 16))
    X[::2] = X[::2].astype(np.float32)  # half of them exact in single precision
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "k long, f array<double>")
    written, write = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda rows, name: (written.append(name), write(rows, name))[1])
    monkeypatch.setattr(N, "BLOCK", 200)
    got = N.knn(df, df, "k", "f", 5, exclude_self=True).toPandas()
    assert {q: list(g.sort_values("rank")["r_key"]) for q, g in got.groupby("q_key")} == _brute_knn(list(range(900)), X, 5, True)
    assert "queries" not in written
    rows = df.select(F.col("k").alias("id"), F.col("f").alias("v"))
    blocks = N.Blocks(rows, 200)
    assert (blocks.tree.children == 0).sum() > 15
    assert blocks.within(rows, F.lit(1e6)).count() <= 900 * 9
    assert blocks.points.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 200
