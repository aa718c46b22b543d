"""What the round 3 findings asked for: work and rows that stay in proportion."""

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import cluster
from tidewatch.operators import neighbors as N


def test_joined_core_points_do_not_travel_to_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 100)
    X = np.random.default_rng(4).normal(size=(900, 12))
    X[:3] += 50.0  # noise
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "k long, f array<double>")
    sent, solve = [], N.Blocks.solve

    def counted(self, queries, fn, *more, **named):
        if fn.__name__ == "links":
            sent.append(queries.count())
        return solve(self, queries, fn, *more, **named)

    monkeypatch.setattr(N.Blocks, "solve", counted)
    got = {r.k: r.cluster for r in cluster.dbscan(df, "k", "f", 6.0, 5).collect()}
    assert got == {i: -1 if i < 3 else 0 for i in range(900)}
    assert sum(sent) < 4 * 900  # all of them to all blocks: more than eight times


def test_links_between_known_groups_only():
    X = np.random.default_rng(6).normal(size=(500, 3))
    q, r, a, b = N.Cells(X).spanning(X[:50], 0.8, np.where(np.arange(500) < 250, 0, 250))
    assert len(a) == len(b) == 0 and set(r.tolist()) <= {0, 250}
    D = np.sqrt(((X[:50, None, :] - X[None, :, :]) ** 2).sum(-1)) <= 0.8
    both = np.flatnonzero(D[:, :250].any(axis=1) & D[:, 250:].any(axis=1))
    assert len(both) and {0, 250} == set(r[np.isin(q, both[:1])].tolist())


def test_blocks_of_narrow_vectors_are_wider(spark):
    def block(d):
        return N.Blocks(spark.createDataFrame([(1, [0.5] * d)], "id long, v array<double>"), None).block

    assert block(64) == 4 * N.BLOCK and block(128) == 2 * N.BLOCK and block(1024) == N.BLOCK


def test_flags_are_found_at_any_length():
    rng = np.random.default_rng(7)
    for shape in ((4, 16), (3, 5), (1, 8), (512, 2048)):
        flags = rng.random(shape) < 0.05
        assert (N._true(flags) == np.flatnonzero(flags)).all()


def test_kmeans_reads_written_scores(spark, monkeypatch):
    written, write = [], cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda rows, name: (written.append(name), write(rows, name))[1])
    wide = spark.range(40).select(F.col("id").alias("entity"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    mat, names = cluster.profile_matrix(wide)
    out = cluster.kmeans(cluster.fit_pca(mat, len(names)).transform(mat), k=3)
    assert out.count() == 40 and written == ["profiles", "profile_matrix", "scores"]


def _lof_rows(spark, n=300):
    X = np.random.default_rng(8).normal(size=(n, 6))
    X[n // 2:n // 2 + 30] = X[:30]  # copies
    return spark.createDataFrame([(i, x.tolist(), int(i % 10 != 0)) for i, x in enumerate(X)], "k long, f array<double>, y int")


def test_lof_searches_only_for_vectors_that_were_not_fitted(spark, monkeypatch, tmp_path):
    from tidewatch.operators.detect import AnomalyDetector
    df = _lof_rows(spark)
    det = AnomalyDetector("local_outlier_factor", key="k", vec="f", n_neighbors=5).fit(df.where("y = 1"))
    det.save(spark, str(tmp_path / "lof"))
    plain = AnomalyDetector.load(spark, str(tmp_path / "lof"))
    plain.model.near = None
    want = {r.k: r.score for r in plain.score(df).collect()}
    searched, solve = [], N.Blocks.solve

    def counted(self, queries, fn, *more, **named):
        searched.append(queries.count())
        return solve(self, queries, fn, *more, **named)

    monkeypatch.setattr(N.Blocks, "solve", counted)
    fitted = {tuple(r.f) for r in df.where("y = 1").collect()}
    other = {tuple(r.f) for r in df.collect()} - fitted
    for model in (det, AnomalyDetector.load(spark, str(tmp_path / "lof"))):
        searched.clear()
        assert {r.k: r.score for r in model.score(df).collect()} == want
        assert sum(searched) == len(other) > 0
        searched.clear()
        assert model.score(df.where("y = 1")).where("score is null").count() == 0 and searched == []


def test_lof_lists_are_not_used_where_a_fitted_row_was_left_out(spark):
    from tidewatch.operators.detect.lof import fit_lof
    rows = [(0, [0.0, 0.1 * i]) for i in range(4)] + [(i, [5.0, float(i)]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "k long, f array<double>")
    model = fit_lof(df, "k", "f", 3)  # the rows named 0 have only each other
    assert model.near is None and model.fitted.where("k = 0").count() == 0
    assert fit_lof(df.where("k > 0"), "k", "f", 3).near is not None


def test_known_lists_give_the_same_neighbours(spark):
    df = _lof_rows(spark)
    known = N.neighbour_lists(df.where("y = 1"), df, "k", "f", 6)
    for k in (4, 6):
        got, want = (sorted(map(tuple, N.knn(df, df, "k", "f", k, known=x).collect())) for x in (known, None))
        assert got == want and len(got) == 300 * k


def test_null_keys_take_no_neighbours_away(spark):
    df = spark.createDataFrame([(None, [0.0]), (None, [0.0]), (1, [0.0]), (2, [1.0]), (None, [1.5]), (3, [3.0])], "k long, f array<double>")
    got = {(r.q_key, r["rank"]): r.r_key for r in N.knn(df.where("k is not null"), df, "k", "f", 2).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 2, (2, 2): 1, (3, 1): 3, (3, 2): 2}


def test_one_class_svm_reads_the_lists_once(spark, monkeypatch):
    from tidewatch.operators.detect import ocsvm
    df = _lof_rows(spark)
    X = np.array([r.f for r in df.orderBy("k").collect()])
    want = ocsvm.fit_one_class_svm(df, "f", nu=0.05, n_features=16, iterations=20)
    monkeypatch.setattr(ocsvm, "BLOCK_NUMBERS", 42)  # blocks of seven rows
    got = ocsvm.fit_one_class_svm(df, "f", nu=0.05, n_features=16, iterations=20)
    assert np.allclose(got.w, want.w) and np.isclose(got.rho, want.rho)
    assert np.isclose(got.rho, np.quantile(ocsvm._phi(X, got.W, got.b) @ got.w, 0.05))
