"""Missing values, tiny tables and defaults: nothing is lost silently."""

import math

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import balance, derive, describe, evaluate, neighbors, preprocess, sample, schema
from tidewatch.operators.cluster import dbscan
from tidewatch.operators.detect import AnomalyDetector, EnsembleAnomalyDetector
from tidewatch.operators.detect.lof import fit_lof
from tidewatch.plans.preprocess import preprocess as run_preprocess


def test_rows_without_a_time_stay(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:03:00", 1.0), ("a", None, 2.0), (None, "2024-01-01 00:04:00", 3.0)], "`Source IP` string, t string, `Flow Duration` double")
    df = df.withColumn("Timestamp", F.to_timestamp("t"))
    assert derive.add_time_window(df, "Timestamp", 300).count() == 3
    rows = {r["Flow Duration"]: r for r in derive.row_window_features(df).collect()}
    assert len(rows) == 3 and rows[2.0]["time_window"] is None and str(rows[1.0]["time_window"]) == "2024-01-01 00:00:00"


def test_one_row_has_the_same_columns(spark):
    df = spark.createDataFrame([("a", "b")], "`Source IP` string, `Destination IP` string")
    assert derive.add_distinct_destinations(df).first()["Distinct Destinations Count"] == 1


def test_null_labels(spark):
    rows = [(i, 0) for i in range(10)] + [(i, 1) for i in range(10, 95)] + [(i, None) for i in range(95, 100)]
    df = spark.createDataFrame(rows, "k long, y int")
    got = [r.y for r in sample.undersample(df, "y", "k", 0.5).collect()]
    assert (got.count(0), got.count(1), got.count(None)) == (10, 20, 5)
    assert sample.stratified_split(df, "y", "k").count() == 100
    c = evaluate.confusion(df.withColumn("p", F.when(F.col("k") < 50, -1)), "y", "p").first()
    assert (c.tp, c.fp, c.tn, c.fn) == (10, 40, 50, 0)
    with pytest.raises(ValueError):
        sample.class_counts(spark.range(sample.MAX_CLASSES + 1), "id")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2), (float("nan"), 3), (3.0, None), (None, None)], "x double, n int")
    assert {r.column: r.n_missing for r in describe.null_counts(df).collect()} == {"x": 2, "n": 2}
    fv = preprocess.fit_fill_values(df, ["x", "n"], [])
    assert [(r.x, r.n) for r in fv.apply(df).collect()] == [(1.0, 2.0), (2.0, 3.0), (3.0, 2.5), (2.0, 2.5)]
    assert preprocess.fit_scaler(df, ["x"]).params["x"] == (2.0, 1.0)
    s = describe.summary(df, ["x"]).first()
    assert (s["count"], s["mean"], s["max"]) == (2, 2.0, 3.0)


def test_small_tables_and_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(15)], "k long, v array<double>")
    m = fit_lof(df, "k", "v", 20, contamination=0.1)
    assert m.fitted.count() == 15 and m.score(df).where("lof is null").count() == 0 and m.offset > 0
    none = df.limit(0)
    assert neighbors.knn(df, none, "k", "v", 3).collect() == [] and neighbors.radius_join(none, df, "k", "v", 1.0).collect() == []
    one = fit_lof(df.limit(1), "k", "v", 20)
    assert one.score(df).count() == 15


def test_chain_of_many_rounds(spark):
    df = spark.createDataFrame([(i * 37 % 300, [float(i)]) for i in range(300)], "k long, v array<double>")
    assert dbscan(df, "k", "v", 1.0, 2).select("cluster").distinct().count() == 1


def test_many_copies_of_a_point(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.array(F.lit(0.0), F.lit(0.0)).alias("v"))
    df = df.union(spark.createDataFrame([(3000, [0.5, 0.0]), (3001, [9.0, 9.0])], "k long, v array<double>"))
    got = {r.cluster: r["count"] for r in dbscan(df, "k", "v", 1.0, 5).groupBy("cluster").count().collect()}
    assert got == {0: 3001, -1: 1}


def test_smote_rows_have_every_feature(spark):
    rows = [(f"k{i}", float(i), i, "t", 0 if i < 8 else 1, [float(i), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows + [("synthetic-0", 50.0, 50, "t", 1, [50.0, 1.0])], "k string, x double, n int, s string, y int, v array<double>")
    out = balance.smote(df, "y", "k", "v", 0.5, 3)
    new = [r for r in out.collect() if r.k.startswith("synthetic--")]
    assert len(new) == int(33 * 0.5 - 8) and len({r.k for r in out.collect()}) == out.count()
    for r in new:
        assert abs(r.x - r.v[0]) < 1e-9 and abs(r.n - r.x) <= 0.5 + 1e-9 and r.s == "t" and r.y == 0


def test_preprocess_default_is_sparse_and_complete(spark):
    rows = [(i, f"c{i % 1500}", float(i % 7), 0 if i % 10 == 0 else 1) for i in range(1600)]
    df = spark.createDataFrame(rows, "k long, c string, x double, y int")
    out, fitted = run_preprocess(df, "y", "k", ratio=0.3)
    syn = out.where("k < 0").collect()
    assert syn and all(r["c_vec"] is not None and r["x"] is not None and len(r["features"]) == len(syn[0]["features"]) for r in syn)
    assert math.isclose(sum(syn[0]["features"][1:]), 1.0, abs_tol=1e-9) or len(syn[0]["features"]) > 1000


def test_limits_only_where_given():
    cols = ["Label", *[f"Flow Bytes {i}" for i in range(60)]]
    assert len(schema.essential_columns(cols)) == 60 and len(schema.essential_columns(cols, 10)) == 10


def test_models_reload_in_a_plain_session(spark, tmp_path):
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(arrow)
    df = spark.createDataFrame([(i, [float(i % 9), float(i % 4)], int(i % 9 != 0)) for i in range(60)], "k long, v array<double>, y int")
    try:
        spark.conf.set(arrow, "false")
        ens = EnsembleAnomalyDetector([AnomalyDetector(m, key="k", vec="v") for m in ("isolation_forest", "one_class_svm", "local_outlier_factor")], "soft").fit(df)
        ens.find_optimal_threshold(df, "y")
        back = EnsembleAnomalyDetector.load(spark, ens.save(spark, str(tmp_path / "e")))
        assert back.threshold == ens.threshold and back.evaluate(df, "y").columns == ens.evaluate(df, "y").columns
        a, b = ({r.k: r.score for r in e.score(df).collect()} for e in (ens, back))
        assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) for k in a)
    finally:
        spark.conf.set(arrow, before)


def test_scratch_tables_can_be_deleted(spark):
    from tidewatch import session
    t = session.materialize(spark.range(3), "gone")
    assert t.count() == 3 and session.clean_scratch(spark) >= 1 and session.clean_scratch(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from tidewatch import session
    sc = N(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(N(sparkContext=sc, conf=N(get=lambda *a: None)))


def test_window_features_meet_once_and_crowded_windows_agree(spark, monkeypatch):
    times = ["2024-01-01 00:00:01", "2024-01-01 00:00:02", "2024-01-01 00:04:00", "2024-01-01 00:05:00", None]
    rows = [(s, times[i % 5], [None, "x", "y"][(i // 5) % 3], float(i % 4) if i % 7 else None) for i in range(60) for s in ("a", "b" if i % 3 else None)]
    df = spark.createDataFrame(rows, "`Source IP` string, Timestamp string, `Destination IP` string, `Flow Duration` double")
    df = df.withColumn("Timestamp", F.to_timestamp("Timestamp"))
    out = derive.row_window_features(df)
    assert out.columns[:4] == ["Source IP", "time_window", "Timestamp", "Destination IP"]
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    plain = {}
    for s, t, d, x in rows:
        if s and t:
            plain.setdefault((s, t[:15] + ("5" if t[15] >= "5" else "0")), []).append((d, x))
    for limit in (1_000_000, 10):  # all in one way; some windows too large for it
        monkeypatch.setattr(derive, "HOT_ROWS", limit)
        got = derive.row_window_features(df).collect()
        assert len(got) == len(rows)
        for r in got:
            group = plain.get((r["Source IP"], str(r["time_window"])[:16]))
            if group is None:
                assert r["Destination IP_nunique"] is None and r["Flow Duration_mean"] is None
                continue
            xs = [x for _, x in group if x is not None]
            assert r["Destination IP_nunique"] == len({d for d, _ in group if d}) and r["Destination IP_count"] == sum(d is not None for d, _ in group)
            assert abs(r["Flow Duration_mean"] - sum(xs) / len(xs)) < 1e-9 and r["Flow Duration_max"] == max(xs)


def test_profiles_are_written_once(spark):
    from tidewatch.operators.cluster import standardized_profiles
    wide = spark.createDataFrame([("a", 1.0, None), ("b", 3.0, 2.0)], "entity string, x double, y double")
    out = standardized_profiles(wide)
    assert {r.entity: (r.x, r.y) for r in out.collect()} == {"a": (-1.0, -1.0), "b": (1.0, 1.0)}
    assert any("profiles-" in f for f in out.inputFiles())
