"""Local outlier factor in novelty mode (L5; Breunig et al. 2000).

Fit: for each fitted row its k nearest other fitted rows give the k-distance
and the local reachability density ``lrd = 1 / (mean reach + 1e-10)`` with
``reach(p, o) = max(kdist(o), d(p, o))``; with fewer than k + 1 rows all
others are neighbours.  Score: a query row's k nearest
fitted rows give its lrd and ``LOF = mean(lrd(o)) / lrd(q)``.  All steps are
the exact kNN join plus equi-joins and grouped aggregates.  The neighbours found
by the fit stay with the model, so that scoring searches only for vectors that
are not among the fitted ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.neighbors import knn, neighbour_lists, ranked
from tidewatch.session import materialize

AUTO_OFFSET = 1.5  # fixed value of the reference library: 'auto' contamination offset of LOF


@dataclass
class LOFModel:
    fitted: DataFrame       # key, vec, kdist, lrd
    key: str
    vec: str
    k: int
    offset: float = AUTO_OFFSET
    near: DataFrame | None = None  # lists of the fitted vectors' nearest fitted rows

    def raw_scores(self, query: DataFrame) -> DataFrame:
        """LOF per query row (1 = as dense as its neighbours; higher = outlier)."""
        fit = self.fitted.select(F.col(self.key).alias("_fk"), F.col(self.vec).alias("_fv"), "kdist", "lrd")
        nn = knn(query.select(self.key, self.vec), fit.select(F.col("_fk").alias(self.key),
                                                              F.col("_fv").alias(self.vec)),
                 self.key, self.vec, self.k, known=self.near)
        j = nn.join(fit.select(F.col("_fk").alias("r_key"), "kdist", "lrd"), "r_key")
        per = j.groupBy("q_key").agg(
            F.avg(F.greatest(F.col("kdist"), F.col("dist"))).alias("_mr"), F.avg("lrd").alias("_nl"))
        lrd_q = 1.0 / (F.col("_mr") + F.lit(1e-10))
        return per.select(F.col("q_key").alias(self.key), (F.col("_nl") / lrd_q).alias("lof"))

    def score(self, query: DataFrame, out: str = "score") -> DataFrame:
        """Anomaly score = LOF - offset (0 is the model's own cut)."""
        s = self.raw_scores(query)
        return query.join(s, self.key, "left").withColumn(out, F.col("lof") - F.lit(self.offset))


def fit_lof(train: DataFrame, key: str, vec: str, k: int = 20, contamination="auto") -> LOFModel:
    rows = train.select(key, vec)
    lists = neighbour_lists(rows, rows, key, vec, k + 1)
    nn = ranked(lists, rows, key, vec, k, exclude_self=True)
    # the k-th neighbour, or the last one of fewer than k + 1 rows
    kd = nn.groupBy(F.col("q_key").alias("r_key")).agg(F.max("dist").alias("kdist"))
    j = nn.join(kd, "r_key")
    lrd = j.groupBy("q_key").agg(F.avg(F.greatest(F.col("kdist"), F.col("dist"))).alias("_mr")) \
        .select(F.col("q_key").alias(key), (1.0 / (F.col("_mr") + F.lit(1e-10))).alias("lrd"))
    fitted = materialize(rows.join(kd.withColumnRenamed("r_key", key), key).join(lrd, key), "lof_rows")
    # the lists hold for the fitted rows unless some row found no other neighbour and was left out
    whole = fitted.where(F.col(vec).isNotNull()).count() == rows.dropna().count()
    model = LOFModel(fitted, key, vec, k, near=lists if whole else None)
    if contamination != "auto":
        from tidewatch.operators.detect.base import contamination_offset
        # the training rows' own LOF: no row is its own neighbour
        near = nn.join(lrd.select(F.col(key).alias("r_key"), "lrd"), "r_key").groupBy(F.col("q_key").alias(key)).agg(F.avg("lrd").alias("_nl"))
        train_scores = near.join(lrd, key).select((F.col("_nl") / F.col("lrd")).alias("lof"))
        model.offset = contamination_offset(train_scores, "lof", float(contamination))
    return model
