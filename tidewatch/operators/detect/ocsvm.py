"""One-class SVM (L4; Schölkopf et al. 2001) with random Fourier features
(Rahimi and Recht 2007) in place of the exact kernel solver.

phi(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U[0, 2 pi];
gamma = 'scale' = 1 / (d * variance of all cells).  The primal
1/2 |w|^2 - rho + 1/(nu n) sum max(0, rho - w.phi(x)) is minimised by
full-batch subgradient steps (step 1/t, averaged iterate); each step is one
``mapInArrow`` pass over the rows, kept as blocks of numbers, that emits one
partial sum per partition, summed by a grouped aggregate, so only a D+1 vector
reaches the driver.  Finally rho is
set to the nu-quantile of w.phi on the training rows (exact, distributed), so
the training outlier share is nu.  ``score = rho - w.phi(x)`` (0 = own cut).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tidewatch.functions.order_stats import group_quantiles

BLOCK_NUMBERS = 1 << 20  # numbers of the rows kept as one block
ROWS = 512               # rows whose features are in memory at once


def _phi(X: np.ndarray, W: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = X @ W.T
    out += b
    np.cos(out, out=out)
    out *= np.sqrt(2.0 / W.shape[0])
    return out


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=np.float64) for a in v.to_numpy()])


@dataclass
class OneClassSVMModel:
    W: np.ndarray
    b: np.ndarray
    w: np.ndarray
    rho: float
    vec: str
    params: dict = field(default_factory=dict)

    def decision_udf(self):
        W, b, w = self.W, self.b, self.w

        @F.pandas_udf("double")
        def wphi(v: pd.Series) -> pd.Series:
            if len(v) == 0:
                return pd.Series([], dtype=np.float64)
            return pd.Series(_phi(_stack(v), W, b) @ w)

        return wphi

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        f = self.decision_udf()
        return df.withColumn("raw", -f(F.col(self.vec))).withColumn(out, F.col("raw") + F.lit(self.rho))


def fit_one_class_svm(df: DataFrame, vec: str, nu: float = 0.01, gamma="scale", kernel: str = "rbf",
                      n_features: int = 256, iterations: int = 60, seed: int = 42) -> OneClassSVMModel:
    if kernel != "rbf":
        raise ValueError(f"Unsupported kernel: {kernel}")
    x = df.select(F.col(vec).alias("_x"))
    st = x.select(F.size("_x").alias("d"), F.explode("_x").alias("c")).agg(
        F.first("d").alias("d"), F.count(F.lit(1)).alias("m"), F.avg("c").alias("mu"),
        F.var_pop("c").alias("var")).first()
    d, n_cells = int(st["d"]), int(st["m"])
    n = n_cells // max(d, 1)
    if gamma == "scale":
        g = 1.0 / (d * st["var"]) if st["var"] else 1.0
    elif gamma == "auto":
        g = 1.0 / d
    else:
        g = float(gamma)
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 * g), size=(n_features, d))
    b = rng.uniform(0.0, 2.0 * np.pi, size=n_features)
    most = max(1, BLOCK_NUMBERS // max(d, 1))

    def pack(batches):  # lists are turned into numbers once, not in every step
        for batch in batches:
            column = batch.column(0)
            X = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), d)
            yield pa.record_batch({"x": pa.array([X[s:s + most].tobytes() for s in range(0, len(X), most)], pa.binary())})

    def blocks(batches):
        for batch in batches:
            for block in batch.column(0):
                X = np.frombuffer(block.as_buffer(), dtype=np.float64).reshape(-1, d)
                yield from (X[s:s + ROWS] for s in range(0, len(X), ROWS))

    data = x.mapInArrow(pack, "x binary").persist(StorageLevel.MEMORY_AND_DISK)
    w = np.zeros(n_features)
    rho = 0.0
    w_avg, rho_avg = np.zeros(n_features), 0.0
    C = 1.0 / (nu * max(n, 1))
    for t in range(1, iterations + 1):
        ww, rr = w.copy(), rho

        def partial(it, ww=ww, rr=rr):
            acc = np.zeros(n_features)
            cnt = 0
            for X in blocks(it):
                P = _phi(X, W, b)
                viol = P @ ww < rr
                acc += viol @ P
                cnt += int(viol.sum())
            # one row per partition: the partial sum and, last, the violator count
            yield pa.record_batch({"s": pa.array([acc.tolist() + [float(cnt)]], pa.list_(pa.float64()))})

        parts = data.mapInArrow(partial, "s array<double>")
        sums = parts.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        vecsum = np.zeros(n_features + 1)
        for r in sums:
            vecsum[r["pos"]] = r["v"]
        sphi, nviol = vecsum[:n_features], vecsum[n_features]
        step = 1.0 / t
        w = w - step * (w - C * sphi)
        rho = rho - step * (-1.0 + C * nviol)
        w_avg += (w - w_avg) / t
        rho_avg += (rho - rho_avg) / t
    model = OneClassSVMModel(W, b, w_avg, rho_avg, vec,
                             {"kernel": kernel, "gamma": gamma, "nu": nu, "n_features": n_features,
                              "seed": seed})

    def decisions(it):
        for X in blocks(it):
            yield pa.record_batch({"wphi": pa.array(_phi(X, W, b) @ w_avg)})

    vals = data.mapInArrow(decisions, "wphi double").withColumn("_g", F.lit(0))
    qs = group_quantiles(vals, ["_g"], "wphi", [nu], few_groups=True).first()
    model.rho = float(qs["value"])
    data.unpersist()
    return model
