"""Properties of the seeded models and brute-force checks of LOF and DBSCAN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from tidewatch.operators.detect.iforest import fit_isolation_forest, tree_candidates


def _blobs(spark, n=300, outliers=5, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 4))
    X[:outliers] += 8.0  # planted outliers
    rows = [(i, X[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "k long, f array<double>"), X


def test_isolation_forest_properties(spark):
    from tidewatch.operators.detect import AnomalyDetector
    df, X = _blobs(spark)
    det = AnomalyDetector("isolation_forest", key="k", vec="f").fit(df)
    s1 = det.score(df).orderBy("k").toPandas()
    assert ((s1["raw"] > 0) & (s1["raw"] <= 1)).all()
    top = set(s1.sort_values("score", ascending=False).head(5)["k"])
    assert top == {0, 1, 2, 3, 4}
    det2 = AnomalyDetector("isolation_forest", key="k", vec="f").fit(df.repartition(1))
    s2 = det2.score(df.repartition(7)).orderBy("k").toPandas()
    assert np.allclose(s1["score"], s2["score"])


def test_forest_candidates_by_skips(spark):
    n, trees, p = 20_000, 50, 0.004
    df = spark.range(n).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("f"))
    got = sorted((r.tree, r.k) for r in tree_candidates(df.repartition(7), "k", "f", trees, p, 3).collect())
    assert got == sorted((r.tree, r.k) for r in tree_candidates(df.coalesce(1), "k", "f", trees, p, 3).collect())
    assert len(set(got)) == len(got) and {t for t, _ in got} == set(range(trees))
    assert abs(len(got) - n * trees * p) < 5 * (n * trees * p) ** 0.5
    per_tree = np.bincount([t for t, _ in got], minlength=trees)
    assert (abs(per_tree - n * p) < 5 * (n * p) ** 0.5).all()
    both = np.bincount(np.bincount([k for _, k in got], minlength=n))  # trees are independent: binomial counts of a row
    assert abs(both[2] - n * 1225 * p**2 * (1 - p) ** 48) < 5 * (n * 1225 * p**2) ** 0.5
    model = fit_isolation_forest(df, "k", "f", n_estimators=trees, max_samples=32)
    roots = model.nodes[model.nodes["node"] == 0]
    assert len(roots) == trees and (roots["size"] == 32).all()


def test_contamination_share(spark):
    from tidewatch.operators.detect import AnomalyDetector
    df, _ = _blobs(spark, 400)
    det = AnomalyDetector("isolation_forest", key="k", vec="f").fit(df, contamination=0.05)
    flagged = det.predict(df).where(F.col("prediction") == -1).count()
    assert abs(flagged - 20) <= 1


def test_one_class_svm_flags_planted(spark):
    from tidewatch.operators.detect import AnomalyDetector
    df, _ = _blobs(spark, 300)
    det = AnomalyDetector("one_class_svm", key="k", vec="f", nu=0.05).fit(df)
    s = det.score(df).toPandas().sort_values("score", ascending=False)
    assert set(s.head(5)["k"]) == {0, 1, 2, 3, 4}


def test_lof_matches_bruteforce(spark):
    from tidewatch.operators.detect.lof import fit_lof
    df, X = _blobs(spark, 120)
    k = 10
    model = fit_lof(df, "k", "f", k)
    got = model.raw_scores(df).orderBy("k").toPandas()["lof"].to_numpy()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    n = len(X)
    Df = D + np.diag(np.full(n, np.inf))
    nn = np.argsort(Df, axis=1, kind="stable")[:, :k]
    kd = Df[np.arange(n), nn[:, -1]]
    lrd = 1 / (np.maximum(kd[nn], Df[np.arange(n)[:, None], nn]).mean(1) + 1e-10)
    nq = np.argsort(D, axis=1, kind="stable")[:, :k]        # novelty: the row itself may be a neighbour
    lrd_q = 1 / (np.maximum(kd[nq], D[np.arange(n)[:, None], nq]).mean(1) + 1e-10)
    want = lrd[nq].mean(1) / lrd_q
    assert np.allclose(got, want, rtol=1e-6)


def test_dbscan_matches_bruteforce(spark):
    from tidewatch.operators.cluster import dbscan
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(0, 0.3, (40, 2)), rng.normal(3, 0.3, (40, 2)), rng.uniform(-3, 6, (15, 2))])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "k long, f array<double>")
    got = dbscan(df, "k", "f", eps=0.4, min_samples=5).orderBy("k").toPandas()["cluster"].to_numpy()
    # brute force in index order (the traversal order of the classic algorithm)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    nb = [np.nonzero(np.round(D[i], 9) <= 0.4)[0] for i in range(len(X))]
    core = np.array([len(x) >= 5 for x in nb])
    lab = np.full(len(X), -1)
    c = 0
    for i in range(len(X)):
        if not core[i] or lab[i] != -1:
            continue
        stack = [i]
        lab[i] = c
        while stack:
            p = stack.pop()
            for q in nb[p]:
                if lab[q] == -1:
                    lab[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    assert (got == lab).all()


def test_pca_matches_numpy_and_kmeans_labels(spark):
    from tidewatch.operators.cluster import fit_pca, kmeans
    df, X = _blobs(spark, 200)
    fit = fit_pca(df, 4, vec="f", max_components=3)
    ev = fit.model.explainedVariance.toArray()
    Xc = X - X.mean(0)
    w = np.sort(np.linalg.eigvalsh(np.cov(Xc.T)))[::-1]
    assert np.allclose(ev, w[:3] / w.sum(), atol=1e-8)
    km = kmeans(fit.transform(df, "f"), k=3).toPandas()
    assert set(km["cluster"]) <= {0, 1, 2} and len(km) == 200


def test_model_tables_round_trip(spark, tmp_path):
    from tidewatch.operators.detect import AnomalyDetector, EnsembleAnomalyDetector
    df, _ = _blobs(spark, 150)
    ens = EnsembleAnomalyDetector([AnomalyDetector(t, key="k", vec="f") for t in
                                   ("isolation_forest", "one_class_svm", "local_outlier_factor")], "hard").fit(df)
    path = str(tmp_path / "ens")
    ens.save(spark, path)
    back = EnsembleAnomalyDetector.load(spark, path)
    a = ens.predict(df).orderBy("k").toPandas()
    b = back.predict(df).orderBy("k").toPandas()
    assert np.allclose(a["score"], b["score"]) and (a["prediction"] == b["prediction"]).all()


def test_smote_counts_and_interpolation(spark):
    from tidewatch.operators.balance import smote
    v = spark.read.parquet(f"{SF01}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("f"),
        F.when(F.col("label") == 0, 0).otherwise(1).alias("y"))
    out = smote(v, "y", "vec_id", "f", 0.5, 5)
    counts = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[1] == 450 and counts[0] == 225


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["entity", "anomaly_score", "num_anomalous_features", "total_features"]
    assert set(E.oracle_sql()) <= set(E.queries())
