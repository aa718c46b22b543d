"""Outlier detectors (L1-L12) behind one interface, with model tables.

Conventions: ``score`` is high for anomalous rows and 0 is the model's own
cut (``raw - offset``); ``predict`` without a threshold flags ``score > 0``
(the library rule: a decision value of exactly 0 is an inlier), with a
threshold it flags ``score >= threshold``.  Model state is a bounded table
(forest nodes, random-feature weights, LOF fitted rows and their neighbours) written as Parquet
next to a one-row metadata table.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as M
from tidewatch.operators.detect.base import merged_params
from tidewatch.operators.detect.iforest import NODE_SCHEMA, IsolationForestModel, fit_isolation_forest
from tidewatch.operators.detect.lof import LOFModel, fit_lof
from tidewatch.operators.detect.ocsvm import OneClassSVMModel, fit_one_class_svm

WEIGHT_SCHEMA = "projection array<array<double>>, phase array<double>, weights array<double>, rho double"
META_SCHEMA = "model_type string, threshold double, key string, vec string, params string, extra string"
MODEL_TYPES = ("isolation_forest", "one_class_svm", "local_outlier_factor")


class AnomalyDetector:
    """L1: a detector by name, parameters merged over the defaults."""

    def __init__(self, model_type: str = "isolation_forest", key: str = "key", vec: str = "features",
                 **params):
        self.model_type = model_type
        self.params = merged_params(model_type, **params)
        self.key, self.vec = key, vec
        self.model = None
        self.threshold = None

    def fit(self, df: DataFrame, contamination=None) -> "AnomalyDetector":
        p = dict(self.params)
        if contamination is not None:
            p["contamination"] = contamination  # L6 for every detector (R8)
        if self.model_type == "isolation_forest":
            self.model = fit_isolation_forest(df, self.key, self.vec, p["n_estimators"], p["max_samples"],
                                              p.get("contamination", "auto"), p["random_state"])
        elif self.model_type == "one_class_svm":
            self.model = fit_one_class_svm(df, self.vec, p["nu"], p["gamma"], p["kernel"])
            if p.get("contamination") not in (None, "auto"):
                from tidewatch.operators.detect.base import contamination_offset
                s = self.model.score(df.select(self.vec))
                self.model.rho -= contamination_offset(s, "score", float(p["contamination"]))
        elif self.model_type == "local_outlier_factor":
            self.model = fit_lof(df, self.key, self.vec, p["n_neighbors"], p.get("contamination", "auto"))
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Anomaly score, 0 = the model's own cut."""
        if self.model is None:
            raise ValueError("Model not fitted")
        return self.model.score(df, out)

    def predict(self, df: DataFrame, threshold: float | None = None, score: str = "score",
                out: str = "prediction") -> DataFrame:
        """-1 anomaly / 1 normal by the own cut or a given threshold."""
        s = self.score(df, score)
        if threshold is None:
            return s.withColumn(out, F.when(F.col(score) > 0, -1).otherwise(1))
        self.threshold = threshold
        return M.predict(s, score, threshold, out)

    def evaluate(self, df: DataFrame, label: str, threshold: float | None = None) -> DataFrame:
        """Metrics of the predictions; the tuned threshold is used by default (R2)."""
        th = threshold if threshold is not None else self.threshold
        p = self.predict(df, th)
        return M.metrics(p, label, "prediction", score="score")

    def find_optimal_threshold(self, df: DataFrame, label: str, metric: str = "f1") -> float:
        """M7 + M8 on validation rows; stores and returns the threshold."""
        sweep = M.threshold_sweep(self.score(df), label, "score")
        self.threshold = float(M.best_threshold(sweep, metric).first()["threshold"])
        return self.threshold

    # ---- A12: model tables ---------------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> str:
        base = path.rstrip("/")
        m = self.model
        extra = {}
        if isinstance(m, IsolationForestModel):
            spark.createDataFrame(m.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{base}/nodes")
            extra = {"psi": m.psi, "offset": m.offset}
        elif isinstance(m, OneClassSVMModel):
            spark.createDataFrame([(m.W.tolist(), m.b.tolist(), m.w.tolist(), float(m.rho))], WEIGHT_SCHEMA) \
                .write.mode("overwrite").parquet(f"{base}/weights")
        elif isinstance(m, LOFModel):
            m.fitted.write.mode("overwrite").parquet(f"{base}/fitted")
            if m.near is not None:
                m.near.write.mode("overwrite").parquet(f"{base}/near")
            extra = {"k": m.k, "offset": m.offset, "near": m.near is not None}
        threshold = None if self.threshold is None else float(self.threshold)
        meta = [(self.model_type, threshold, self.key, self.vec, json.dumps(self.params), json.dumps(extra))]
        spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{base}/meta")
        return base

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AnomalyDetector":
        base = path.rstrip("/")
        meta = spark.read.parquet(f"{base}/meta").first()
        det = cls(meta["model_type"], meta["key"], meta["vec"], **json.loads(meta["params"]))
        det.threshold = meta["threshold"]
        extra = json.loads(meta["extra"])
        if det.model_type == "isolation_forest":
            nodes = spark.read.parquet(f"{base}/nodes").toPandas()
            det.model = IsolationForestModel(nodes, extra["psi"], det.vec, extra["offset"], det.params)
        elif det.model_type == "one_class_svm":
            import numpy as np
            r = spark.read.parquet(f"{base}/weights").first()
            det.model = OneClassSVMModel(np.array(r["projection"]), np.array(r["phase"]), np.array(r["weights"]),
                                         r["rho"], det.vec)
        else:
            det.model = LOFModel(spark.read.parquet(f"{base}/fitted"), det.key, det.vec, extra["k"],
                                 extra["offset"], spark.read.parquet(f"{base}/near") if extra.get("near") else None)
        return det


class EnsembleAnomalyDetector:
    """Members scored side by side; hard vote (sign of the sum of
    predictions, tie -> anomaly), soft vote (mean score > 0 -> anomaly) and
    the ensemble score (mean of member scores)."""

    def __init__(self, models=None, voting: str = "hard"):
        self.models = list(models or [])
        self.voting = voting
        self.threshold = None

    def add_model(self, model: AnomalyDetector) -> None:
        self.models.append(model)

    def fit(self, df: DataFrame, contamination=None) -> "EnsembleAnomalyDetector":
        for m in self.models:
            m.fit(df, contamination)
        return self

    def member_scores(self, df: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("an ensemble needs at least one detector")
        out = df
        for i, m in enumerate(self.models):
            out = m.score(out, f"score_{i}").drop("raw", "lof")
            out = out.withColumn(f"pred_{i}", F.when(F.col(f"score_{i}") > 0, -1).otherwise(1))
        return out

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        s = self.member_scores(df)
        n = len(self.models)
        return s.withColumn(out, sum(F.col(f"score_{i}") for i in range(n)) / F.lit(float(n)))

    def predict(self, df: DataFrame, threshold: float | None = None, out: str = "prediction") -> DataFrame:
        """The vote, or with a threshold on the ensemble score ``score >= threshold``."""
        s = self.score(df)
        n = len(self.models)
        if threshold is not None:
            return M.predict(s, "score", threshold, out)
        if self.voting == "hard":
            total = sum(F.col(f"pred_{i}") for i in range(n))
            return s.withColumn(out, F.when(total > 0, 1).otherwise(-1))
        if self.voting == "soft":
            return s.withColumn(out, F.when(F.col("score") > 0, -1).otherwise(1))
        raise ValueError(f"Voting is 'hard' or 'soft', not {self.voting!r}")

    def evaluate(self, df: DataFrame, label: str, threshold: float | None = None) -> DataFrame:
        """Metrics of the ensemble; the tuned threshold is used by default (R2)."""
        th = threshold if threshold is not None else self.threshold
        return M.metrics(self.predict(df, th), label, "prediction", score="score")

    def find_optimal_threshold(self, df: DataFrame, label: str, metric: str = "f1") -> float:
        """M7 + M8 on validation rows; stores and returns the threshold."""
        sweep = M.threshold_sweep(self.score(df), label, "score")
        self.threshold = float(M.best_threshold(sweep, metric).first()["threshold"])
        return self.threshold

    def save(self, spark: SparkSession, path: str) -> str:
        """One sub-directory per member plus the voting rule."""
        base = path.rstrip("/")
        for i, m in enumerate(self.models):
            m.save(spark, f"{base}/model_{i}")
        threshold = None if self.threshold is None else float(self.threshold)
        spark.createDataFrame([(len(self.models), self.voting, threshold)], "n_models int, voting string, threshold double") \
            .coalesce(1).write.mode("overwrite").parquet(f"{base}/meta")
        return base

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "EnsembleAnomalyDetector":
        base = path.rstrip("/")
        meta = spark.read.parquet(f"{base}/meta").first()
        models = [AnomalyDetector.load(spark, f"{base}/model_{i}") for i in range(meta["n_models"])]
        out = cls(models, meta["voting"])
        out.threshold = meta["threshold"]
        return out


class ScoreColumnDetector:
    """A detector whose raw score is an existing column (a precomputed score):
    fit sets the offset from the contamination (L6), score shifts it (L7)."""

    def __init__(self, column: str, contamination="auto"):
        self.column = column
        self.contamination = contamination
        self.offset = 0.0

    def fit(self, df: DataFrame, contamination=None) -> "ScoreColumnDetector":
        from tidewatch.operators.detect.base import contamination_offset
        c = contamination if contamination is not None else self.contamination
        if c not in (None, "auto"):
            self.offset = contamination_offset(df.select(F.col(f"`{self.column}`").cast("double").alias("raw")),
                                               "raw", float(c))
        return self

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        raw = F.col(f"`{self.column}`").cast("double")
        return df.withColumn("raw", raw).withColumn(out, F.col("raw") - F.lit(self.offset))
