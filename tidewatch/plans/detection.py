"""Detection composition (Q4) and the combined decision (Q5).

Q4: preprocess (Q1) -> fit a detector (or ensemble) on the train split ->
tune the threshold on the validation split (M7/M8) -> evaluate on the test
split with the tuned threshold (R2) -> metrics row (written as CSV, A8).
Q5: the row model's predictions AND the entity profile's flags (B19) ->
metrics of the combined decision (M11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as M
from tidewatch.operators import profile
from tidewatch.operators.detect import AnomalyDetector, EnsembleAnomalyDetector
from tidewatch.plans.preprocess import preprocess
from tidewatch.sources import sinks


def run_detection(df: DataFrame, target: str, key: str, model_type: str = "isolation_forest",
                  exclude=(), encoding: str = "label", balance_method: str | None = None,
                  tune_metric: str | None = "f1", out_dir: str | None = None, stored=None,
                  members=("isolation_forest", "local_outlier_factor"), voting: str = "soft", **params):
    """``model_type='ensemble'`` combines ``members`` by ``voting``; a fitted
    detector or ensemble given as ``stored`` (for example loaded from a model
    table) is used as it is instead of fitting one."""
    rows, fitted = preprocess(df, target, key, encoding=encoding, balance_method=balance_method,
                              exclude=exclude)
    rows = fitted.assemble(rows) if "features" not in rows.columns else rows
    if stored is not None:
        det = stored
    elif model_type == "ensemble":
        det = EnsembleAnomalyDetector([AnomalyDetector(m, key=key, vec="features", **params.get(m, {})) for m in members], voting)
    else:
        det = AnomalyDetector(model_type, key=key, vec="features", **params)
    if stored is None:
        det.fit(rows.where(F.col("split") == "train"))
    if tune_metric:
        det.find_optimal_threshold(rows.where(F.col("split") == "val"), target, tune_metric)
    test = rows.where(F.col("split") == "test")
    metrics = det.evaluate(test, target)
    if out_dir:
        sinks.write_metrics(metrics, f"{out_dir.rstrip('/')}/metrics.csv")
    return det, rows, metrics


def combined_decision(rows: DataFrame, det: AnomalyDetector, entity_rows: DataFrame, key: str,
                      entity_col: str, z: DataFrame, target: str, threshold: float = 2.0):
    """Q5: rows flagged only when the row model and the entity profile agree.
    ``entity_rows`` maps the row key to its entity."""
    pred = det.predict(rows, det.threshold).select(key, target, "score", "prediction")
    flagged = profile.anomalous_entities(z, threshold)
    with_entity = pred.join(entity_rows.select(key, entity_col), key)
    flags = profile.entity_flag(with_entity, entity_col, flagged)
    comb = M.combine_flags(flags, "prediction", "entity_anomalous")
    return comb, M.metrics(comb, target, "combined")
