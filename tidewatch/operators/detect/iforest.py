"""Isolation forest (L2, L3; Liu, Ting, Zhou 2008).

Fit: each tree gets exactly psi = min(max_samples, n) rows drawn without
replacement by hash rank.  A row is a candidate of each tree with probability
p ~ 3 psi / n, independently: its first tree is one geometric skip drawn from
its key, so a scan draws once per row (not once per row and tree) and drops all
rows whose skip passes the last tree; only candidates draw on.  Then the psi
smallest hashes per tree are kept, so no step sorts n x T rows and a tree's
group holds ~3 psi rows.  Trees are grown
by ``groupBy(tree).applyInPandas`` (rows sorted by key, seed = (seed, tree)),
giving a node table bounded by T x (2 psi - 1) rows.

Score: the node arrays (bounded) travel in the UDF closure; a vectorised
``pandas_udf`` walks all trees for a batch of rows at once.
``raw = 2 ** (-mean path / c(psi))``; ``score = raw - offset`` with offset 0.5
('auto') or the (1 - contamination) quantile of training raw scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize
from tidewatch.functions.hashing import DEFAULT_SEED

AUTO_OFFSET = 0.5  # fixed value of the reference library: 'auto' offset of the forest
EULER = 0.5772156649
NODE_SCHEMA = ("tree int, node int, feature int, cut double, left int, right int, "
               "size long, depth int")


def avg_path(m):
    """c(m): average path length of an unsuccessful search in a BST of m rows."""
    m = np.asarray(m, dtype=np.float64)
    out = np.zeros_like(m)
    big = m > 2
    out[big] = 2.0 * (np.log(m[big] - 1.0) + EULER) - 2.0 * (m[big] - 1.0) / m[big]
    out[m == 2] = 1.0
    return out


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    nodes = []  # (node, feature, cut, left, right, size, depth)

    def build(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        n = len(idx)
        if depth >= max_depth or n <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, n, depth)
            return nid
        sub = X[idx]
        lo, hi = sub.min(0), sub.max(0)
        live = np.nonzero(hi > lo)[0]
        if len(live) == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, n, depth)
            return nid
        f = int(live[rng.integers(len(live))])
        cut = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < cut
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[nid] = (nid, f, cut, left, right, n, depth)
        return nid

    build(np.arange(len(X)), 0)
    return nodes


@dataclass
class IsolationForestModel:
    nodes: pd.DataFrame          # the node table, bounded by trees x (2 psi - 1)
    psi: int
    vec: str
    offset: float = AUTO_OFFSET
    params: dict = field(default_factory=dict)

    def _arrays(self):
        t = self.nodes.sort_values(["tree", "node"])
        trees = sorted(t["tree"].unique())
        width = int(t.groupby("tree")["node"].max().max()) + 1
        shape = (len(trees), width)
        feat = np.full(shape, -1, dtype=np.int64)
        cut = np.zeros(shape)
        left = np.zeros(shape, dtype=np.int64)
        right = np.zeros(shape, dtype=np.int64)
        leaf_len = np.zeros(shape)
        pos = {tr: i for i, tr in enumerate(trees)}
        ti = t["tree"].map(pos).to_numpy()
        ni = t["node"].to_numpy()
        feat[ti, ni] = t["feature"].to_numpy()
        cut[ti, ni] = t["cut"].to_numpy()
        left[ti, ni] = t["left"].to_numpy()
        right[ti, ni] = t["right"].to_numpy()
        leaf_len[ti, ni] = t["depth"].to_numpy() + avg_path(t["size"].to_numpy())
        return feat, cut, left, right, leaf_len

    def raw_udf(self):
        feat, cut, left, right, leaf_len = self._arrays()
        norm = float(avg_path(np.array([self.psi]))[0]) or 1.0

        @F.pandas_udf("double")
        def raw(v: pd.Series) -> pd.Series:
            if len(v) == 0:
                return pd.Series([], dtype=np.float64)
            X = np.stack([np.asarray(a, dtype=np.float64) for a in v.to_numpy()])
            rows = np.arange(len(X))
            total = np.zeros(len(X))
            for t in range(feat.shape[0]):
                node = np.zeros(len(X), dtype=np.int64)
                while True:
                    f = feat[t, node]
                    inner = f >= 0
                    if not inner.any():
                        break
                    xv = X[rows[inner], f[inner]]
                    nxt = np.where(xv < cut[t, node[inner]], left[t, node[inner]], right[t, node[inner]])
                    node[inner] = nxt
                total += leaf_len[t, node]
            return pd.Series(np.power(2.0, -(total / feat.shape[0]) / norm))

        return raw

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """L3 + L7: ``raw`` (in (0, 1]) and ``score = raw - offset``."""
        raw = self.raw_udf()
        return df.withColumn("raw", raw(F.col(self.vec))).withColumn(out, F.col("raw") - F.lit(self.offset))


def tree_candidates(df: DataFrame, key: str, vec: str, n_trees: int, p: float, seed: int) -> DataFrame:
    """(key, vec, tree, _u): every row for every tree with probability ``p``,
    independently and by the row's key alone; ``_u`` orders a tree's rows."""
    def draw(*salt):
        # 60 bits: draws stay distinct on any number of rows
        h = F.xxhash64(F.lit(seed), *salt, F.col(key))
        return (F.abs(h % F.lit(1 << 60)).cast("double") + 0.5) / F.lit(float(1 << 60))

    def skip(i):  # trees passed over before the next one that takes the row
        return F.floor(F.log1p(-draw(F.lit("skip"), i)) / F.lit(math.log1p(-p)))

    def further(taken, i):
        last = F.element_at(taken, -1)
        return F.when(last < n_trees, F.concat(taken, F.array(last + 1 + skip(i)))).otherwise(taken)

    rows = df.select(F.col(key), F.col(vec))
    if p >= 1.0:
        taken = F.sequence(F.lit(0), F.lit(n_trees - 1))
    else:
        rows = rows.withColumn("_first", skip(F.lit(0))).where(F.col("_first") < n_trees)
        taken = F.aggregate(F.sequence(F.lit(1), F.lit(n_trees)), F.array("_first"), further)
        taken = F.filter(taken, lambda t: t < n_trees)
    rows = rows.select(F.col(key), F.col(vec), F.explode(taken.cast("array<int>")).alias("tree"))
    return rows.withColumn("_u", draw(F.col("tree")))


def fit_isolation_forest(df: DataFrame, key: str, vec: str, n_estimators: int = 100,
                         max_samples="auto", contamination="auto", random_state: int = DEFAULT_SEED,
                         oversample: float = 3.0) -> IsolationForestModel:
    """L2: grow the forest; L6: set the offset."""
    n = df.count()
    psi = min(256, n) if max_samples == "auto" else min(int(max_samples), n)
    T = int(n_estimators)
    seed = int(random_state)
    thr = min(1.0, oversample * psi / max(n, 1) + 1e-12)
    while True:  # a few psi rows per tree; a tree that got too few draws from a wider slice
        cand = materialize(tree_candidates(df, key, vec, T, thr, seed), "candidates")
        if thr >= 1.0 or cand.groupBy("tree").count().where(F.col("count") >= psi).count() >= T:
            break
        thr = min(1.0, 4 * thr)
    w = Window.partitionBy("tree").orderBy("_u", key)
    chosen = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r", "_u")
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        tree = int(pdf["tree"].iloc[0])
        X = np.stack([np.asarray(a, dtype=np.float64) for a in pdf[vec].to_numpy()])
        rng = np.random.default_rng([seed, tree])
        rows = _grow(X, rng, max_depth)
        out = pd.DataFrame(rows, columns=["node", "feature", "cut", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out.astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32",
                           "right": "int32", "size": "int64", "depth": "int32"})

    nodes = chosen.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    model = IsolationForestModel(nodes, psi, vec, AUTO_OFFSET,
                                 {"n_estimators": T, "max_samples": max_samples,
                                  "contamination": contamination, "random_state": seed})
    if contamination != "auto":
        from tidewatch.operators.detect.base import contamination_offset
        model.offset = contamination_offset(model.score(df.select(vec)), "raw", float(contamination))
    return model
