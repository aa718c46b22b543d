"""Shared detector pieces: parameters merged over defaults (L1, R7) and the
contamination offset (L6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.order_stats import group_quantiles

# Fixed values of the reference defaults.
DEFAULT_PARAMS = {
    "isolation_forest": {"n_estimators": 100, "max_samples": "auto", "contamination": "auto",
                         "random_state": 42},
    "one_class_svm": {"kernel": "rbf", "gamma": "scale", "nu": 0.01},
    "local_outlier_factor": {"n_neighbors": 20, "contamination": "auto"},
}


def merged_params(model_type: str, **given) -> dict:
    """L1: the given parameters over the defaults (the reference replaced the
    defaults entirely when any parameter was given, R7)."""
    if model_type not in DEFAULT_PARAMS:
        raise ValueError(f"detector {model_type!r} is not one of {sorted(DEFAULT_PARAMS)}")
    out = dict(DEFAULT_PARAMS[model_type])
    out.update(given)
    return out


def contamination_offset(scores: DataFrame, col: str, contamination: float) -> float:
    """The (1 - contamination) quantile of training scores (exact, no
    column gathered in one task); flagged share of training rows = contamination."""
    qs = group_quantiles(scores.withColumn("_g", F.lit(0)), ["_g"], col, [1.0 - contamination],
                         few_groups=True)
    return float(qs.first()["value"])
