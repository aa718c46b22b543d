"""Reference semantics and the decisions of SURVEY §8, on small hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import derive, evaluate as M, preprocess as P, profile, sample as S, schema


def test_rename_only_present_and_roles(spark):
    df = spark.createDataFrame([("1.1.1.1", 3, "tcp", "Benign", 1.5)],
                               "src_ip string, dst_port int, protocol string, label string, duration double")
    out = schema.rename_to_standard(df)
    assert out.columns == ["Source IP", "Destination Port", "Protocol", "Label", "Flow Duration"]
    num, cat = schema.column_roles(out, "Label")
    assert num == ["Destination Port", "Flow Duration"] and cat == ["Source IP", "Protocol"]


def test_name_roles_token_vs_substring():
    cols = ["Source IP", "description", "Timestamp", "Flow Duration", "dst_port"]
    tok = schema.name_roles(cols)
    sub = schema.name_roles(cols, match="substring")
    assert "description" not in tok["ip"] and "description" in sub["ip"]
    assert tok["feature"] == ["Flow Duration", "dst_port"]
    assert schema.find_target(["a", "Class_x"], "label") == "Class_x"


def test_binarize_text_and_numeric(spark):
    t = spark.createDataFrame([("Normal",), ("benign",), ("DoS",), (None,)], "label string")
    assert [r[0] for r in schema.binarize_label(t, "label").collect()] == [1, 1, 0, 0]
    n = spark.createDataFrame([(0,), (1,), (2,), (0,)], "label int")
    assert [r[0] for r in schema.binarize_label(n, "label").collect()] == [1, 0, 0, 1]
    b = spark.createDataFrame([(0,), (1,)], "label int")   # already binary: untouched
    assert [r[0] for r in schema.binarize_label(b, "label").collect()] == [0, 1]
    r18 = spark.createDataFrame([(1,), (2,), (1,)], "label int")  # no 0: left unmapped (R18)
    assert [r[0] for r in schema.binarize_label(r18, "label").collect()] == [1, 2, 1]


def test_ratios_zero_guard(spark):
    df = spark.createDataFrame([(0, 0, 10.0, 4.0)], "`Total Fwd Packets` int, `Total Backward Packets` int, "
                               "`Total Length of Fwd Packets` double, `Total Length of Bwd Packets` double")
    r = derive.add_flow_ratios(df).first()
    assert r["Fwd Bytes per Packet"] == 10.0 and r["Bwd Bytes per Packet"] == 4.0
    assert r["Fwd Packet Ratio"] == 0.0 and r["Bwd Packet Ratio"] == 0.0


def test_one_window_entity_gets_no_std_z(spark):
    # entity 'b' has one window: its std statistic is NULL and is left out
    rows = [("a", 0, 1.0), ("a", 86400, 3.0), ("a", 172800, 5.0), ("b", 0, 100.0)]
    fw = spark.createDataFrame(rows, "e string, t long, x double") \
        .withColumn("time_window", F.timestamp_seconds("t")).drop("t")
    prof = profile.entity_profiles(fw, "e")
    z = profile.z_scores(prof, profile.global_profile(fw, "e"))
    b = z.where("entity = 'b'").select("stat").collect()
    assert sorted(r[0] for r in b) == ["max", "mean", "median", "min", "q1", "q3"]
    rep = profile.anomalous_entities(z, 1.0).collect()
    assert {r["entity"] for r in rep} == {"b"}


def test_constant_feature_skipped(spark):
    fw = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 2.0)], "e string, t long, x double") \
        .withColumn("time_window", F.timestamp_seconds("t")).drop("t")
    z = profile.z_scores(profile.entity_profiles(fw, "e"), profile.global_profile(fw, "e"))
    assert z.count() == 0


def test_predict_and_metrics_conventions(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.2), (1, 0.8), (1, 0.1), (1, 0.5)], "label int, s double")
    p = M.predict(df, "s", 0.5)
    assert [r["prediction"] for r in p.orderBy("s").collect()] == [1, 1, -1, -1, -1]
    low = M.predict(df, "s", 0.5, anomaly_when="low")
    assert [r["prediction"] for r in low.orderBy("s").collect()] == [-1, -1, 1, 1, 1]
    c = M.confusion(p, "label", "prediction").first().asDict()
    assert c == {"tp": 1, "fp": 2, "tn": 1, "fn": 1}
    m = M.metrics(p, "label", "prediction").first()
    assert m["precision"] == pytest.approx(1 / 3) and m["false_positive_rate"] == pytest.approx(2 / 3)
    empty = M.metrics(M.predict(df, "s", 10.0), "label", "prediction").first()
    assert empty["precision"] == 0.0 and empty["f1"] == 0.0


def test_auc_equals_mann_whitney_with_ties(spark):
    rng = np.random.default_rng(1)
    s = rng.integers(0, 20, 300).astype(float)
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, s double")
    got = M.roc_auc(df, "label", "s").first()[0]
    pos, neg = s[y == 0], s[y == 1]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want)


def test_sweep_matches_numpy(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=500)
    y = rng.integers(0, 2, 500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, s double")
    got = M.threshold_sweep(df, "label", "s").orderBy("i").toPandas()
    th = np.linspace(s.min(), s.max(), 100)
    for i, t in enumerate(th):
        flag = s >= t
        tp = (flag & (y == 0)).sum()
        fp = (flag & (y == 1)).sum()
        assert got.loc[i, "threshold"] == t
        assert got.loc[i, "recall"] == pytest.approx(tp / (y == 0).sum())
        assert got.loc[i, "false_positive_rate"] == pytest.approx(fp / (y == 1).sum())


def test_encoders_unseen_values(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    new = spark.createDataFrame([("b",), ("z",)], "c string")
    oh = P.fit_encoder(train, ["c"], "onehot").apply(new).orderBy("c_b", ascending=False).collect()
    assert [tuple(r) for r in oh] == [(0.0, 1.0, 0.0), (0.0, 0.0, 0.0)]
    lab = {r[0] for r in P.fit_encoder(train, ["c"], "label").apply(new).collect()}
    assert lab == {2, -1}
    bi = P.fit_encoder(train, ["c"], "binary").apply(new).collect()
    assert sorted(tuple(r) for r in bi) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        P.fit_encoder(train, ["c"], "hashing")


def test_target_encoding_formula(spark):
    rows = [("a", 1)] * 30 + [("a", 0)] * 10 + [("b", 1)] + [("c", 0)] * 5
    df = spark.createDataFrame(rows, "c string, y int")
    enc = P.fit_encoder(df, ["c"], "target", target="y")
    got = {r["value"]: r["enc"] for r in enc.target.collect()}
    prior = 31 / 46

    def sm(n, m):
        w = 1 / (1 + math.exp(-(n - 20) / 10))
        return prior * (1 - w) + m * w
    assert got["a"] == pytest.approx(sm(40, 0.75))
    assert got["b"] == pytest.approx(prior)          # a single row -> prior
    assert got["c"] == pytest.approx(sm(5, 0.0))


def test_scalers_degenerate_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    st = P.fit_scaler(df, ["x", "k"], "standard").apply(df).collect()
    assert [(r.x, r.k) for r in st] == [(-1.0, 0.0), (1.0, 0.0)]
    mm = P.fit_scaler(df, ["x", "k"], "minmax").apply(df).collect()
    assert [(r.x, r.k) for r in mm] == [(0.0, 0.0), (1.0, 0.0)]
    assert P.fit_scaler(df, ["x"], None).apply(df).collect() == df.collect()


def test_split_and_sample_sizes(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    sp = S.stratified_split(df, "y", "k")
    counts = {(r["y"], r["split"]): r["count"] for r in sp.groupBy("y", "split").count().collect()}
    assert counts[(1, "test")] == 50 and counts[(1, "val")] == 50 and counts[(1, "train")] == 150
    assert counts[(0, "test")] == 150 and counts[(0, "val")] == 150 and counts[(0, "train")] == 450
    assert S.sample_n(df, 123, "k").count() == 123
    assert S.sample_ratio(df, 0.37, "k").count() == 370
    un = S.undersample(df, "y", "k", 0.5)
    assert {r["y"]: r["count"] for r in un.groupBy("y").count().collect()} == {1: 250, 0: 500}


def test_sparse_onehot_unseen_all_zero(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",)], "c string")
    new = spark.createDataFrame([("b",), ("z",)], "c string")
    enc = P.fit_encoder(train, ["c"], "onehot", sparse=True)
    rows = {r["c_vec"].toArray().tolist().__repr__() for r in enc.apply(new).collect()}
    assert rows == {repr([0.0, 1.0, 0.0]), repr([0.0, 0.0, 0.0])}
