"""Exact quantiles by wide aggregates against NumPy, through several rounds."""

import numpy as np
import pytest

from tidewatch.functions import wide_quantiles as W


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 60_000
    cols = {"normal": rng.normal(size=n), "skewed": rng.exponential(size=n) ** 4, "few": rng.integers(0, 3, n).astype(float),
            "hot": np.where(rng.random(n) < 0.7, 5.0, rng.random(n) * 10), "one": np.full(n, 2.5)}
    rows = [tuple(float(v[i]) for v in cols.values()) + (None if i % 3 else float(i), float("nan"), None) for i in range(n)]
    df = spark.createDataFrame(rows, "normal double, skewed double, few double, hot double, one double, gaps double, nans double, nothing double")
    return df.repartition(6).persist(), cols | {"gaps": np.arange(0, n, 3).astype(float)}


@pytest.mark.parametrize("ranked,error", [(1_000_000, 0.002), (200, 0.002), (50, 0.0)])
def test_quantiles_equal_numpy(table, monkeypatch, ranked, error):
    # few ranked values: brackets are narrowed again; no slack: brackets miss and are opened
    monkeypatch.setattr(W, "RANKED_VALUES", ranked)
    monkeypatch.setattr(W, "RANK_ERROR", error)
    if ranked < 1_000_000:
        monkeypatch.setattr(W, "WHOLE", 10)
    if not error:
        monkeypatch.setattr(W, "SKETCH_K", 512)
    df, cols = table
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = W.column_quantiles(df, df.columns, probs)
    for c, v in cols.items():
        assert got[c].count == len(v) and got[c].min == v.min() and got[c].max == v.max()
        assert np.allclose(got[c].quantiles, np.quantile(v, probs), rtol=1e-12, atol=0)
    for c in ("nans", "nothing"):
        assert got[c].count == 0 and got[c].quantiles == [None] * len(probs)


def test_few_rows_and_none(table):
    df, _ = table
    got = W.column_quantiles(df.limit(2), ["one", "nans"], [0.5])
    assert got["one"].quantiles == [2.5] and got["nans"].quantiles == [None]
    assert W.column_quantiles(df.limit(0), ["one"], [0.5])["one"].count == 0
    assert W.column_quantiles(df, [], [0.5]) == {}
