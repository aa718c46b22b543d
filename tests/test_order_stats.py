"""Exact order statistics: bracket path (forced with a tiny sketch accuracy)
and whole-group path must both equal NumPy / a brute-force ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.hashing import hash_int
from tidewatch.functions.order_stats import group_quantiles, rank_cuts
from tidewatch.functions.ranking import global_index, prefix_sums
from conftest import SF01


@pytest.mark.parametrize("accuracy", [20, 10000])
def test_group_quantiles_match_numpy(spark, accuracy):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    got = group_quantiles(ev, ["event_type"], "value", [0.1, 0.25, 0.5, 0.75, 0.99],
                          accuracy=accuracy, few_groups=True).toPandas()
    pdf = ev.select("event_type", "value").toPandas()
    for (et, p), v in got.set_index(["event_type", "p"])["value"].items():
        vals = pdf.loc[pdf.event_type == et, "value"].to_numpy()
        assert v == pytest.approx(np.quantile(vals, p), abs=1e-9)


def test_group_quantiles_with_ties(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).cast("double").alias("v"), F.lit(1).alias("g"))
    got = group_quantiles(df, ["g"], "v", [0.3, 0.5, 0.9], accuracy=10, few_groups=True).toPandas()
    vals = (np.arange(5000) % 7).astype(float)
    for _, r in got.iterrows():
        assert r["value"] == pytest.approx(np.quantile(vals, r["p"]))


@pytest.mark.parametrize("accuracy", [20, 10000])
def test_rank_cuts_match_bruteforce(spark, accuracy):
    ev = spark.read.parquet(f"{SF01}/events.parquet").withColumn("h", hash_int(F.col("event_id")))
    cuts = rank_cuts(ev, ["event_type"], "h", ["event_id"], [0.2, 0.4], accuracy=accuracy).toPandas()
    pdf = ev.select("event_type", "h", "event_id").toPandas()
    for _, r in cuts.iterrows():
        grp = pdf[pdf.event_type == r["event_type"]].sort_values(["h", "event_id"])
        k = int(np.floor(len(grp) * r["f"]))
        assert grp.iloc[k - 1]["event_id"] == r["event_id"]


def test_global_index_and_prefix_sums(spark):
    df = spark.range(0, 3000).select(((F.col("id") * 7919) % 3001).alias("k"), F.lit(1).alias("one"))
    idx = global_index(df, ["k"], num_partitions=5).toPandas().sort_values("k")
    assert list(idx["idx"]) == list(range(3000))
    ps = prefix_sums(df, ["k"], ["one"], num_partitions=4, descending=True).toPandas()
    ps = ps.sort_values("k", ascending=False)
    assert list(ps["cum_one"]) == list(range(1, 3001))


def test_bracket_refinement_rounds(spark, monkeypatch):
    """Force refinement: tiny sketch accuracy and a tiny bracket bound."""
    import tidewatch.functions.order_stats as O
    monkeypatch.setattr(O, "BRACKET_ROWS", 50)
    monkeypatch.setattr(O, "BUCKETS", 8)
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    got = group_quantiles(ev, ["event_type"], "value", [0.25, 0.5, 0.9], accuracy=20,
                          few_groups=True).toPandas()
    pdf = ev.select("event_type", "value").toPandas()
    for _, r in got.iterrows():
        vals = pdf.loc[pdf.event_type == r["event_type"], "value"].to_numpy()
        assert r["value"] == pytest.approx(np.quantile(vals, r["p"]), abs=1e-9)
    dup = spark.range(0, 3000).select((F.col("id") % 3).cast("double").alias("v"), F.lit(1).alias("g"))
    got = group_quantiles(dup, ["g"], "v", [0.5], accuracy=10, few_groups=True).first()
    assert got["value"] == 1.0
    ev2 = ev.withColumn("h", hash_int(F.col("event_id")))
    cuts = rank_cuts(ev2, ["event_type"], "h", ["event_id"], [0.3], accuracy=20).toPandas()
    pdf2 = ev2.select("event_type", "h", "event_id").toPandas()
    for _, r in cuts.iterrows():
        grp = pdf2[pdf2.event_type == r["event_type"]].sort_values(["h", "event_id"])
        assert grp.iloc[int(np.floor(len(grp) * r["f"])) - 1]["event_id"] == r["event_id"]


def test_missed_bracket_falls_back_bounded(spark, monkeypatch):
    """A sketch bracket that misses (simulated with a zero margin and tiny
    accuracy) is re-bracketed with the full range and still exact."""
    import tidewatch.functions.order_stats as O
    monkeypatch.setattr(O, "_MARGIN", 0.0)   # zero-width brackets: most miss their positions
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    got = group_quantiles(ev, ["event_type"], "value", [0.3, 0.7], accuracy=20, few_groups=True).toPandas()
    pdf = ev.select("event_type", "value").toPandas()
    for _, r in got.iterrows():
        vals = pdf.loc[pdf.event_type == r["event_type"], "value"].to_numpy()
        assert r["value"] == pytest.approx(np.quantile(vals, r["p"]), abs=1e-9)


def test_hash_cuts_match_rank_cuts_also_for_repeated_keys(spark):
    from tidewatch.functions.hashing import hash_int
    from tidewatch.operators.sample import hash_cuts
    for key in (F.col("id"), F.col("id") % 3):  # three keys only: hashes are not uniform
        df = spark.range(5000).select(key.alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") % 4).alias("g")).withColumn("h", hash_int("k"))
        got = {(r.g, r.f): (r.cut_o, r.k) for r in hash_cuts(df, ["g"], "h", "k", [0.0, 0.2, 0.999]).collect() if r.g is not None}
        want = {(r.g, r.f): (r.cut_o, r.k) for r in rank_cuts(df, ["g"], "h", ["k"], [0.0, 0.2, 0.999]).collect() if r.g is not None}
        assert got == want and len(got) == 12
