"""Thresholding and evaluation.

Conventions (SURVEY R1-R3): ``score`` is high for anomalous rows; a row is
predicted anomalous (-1) when ``score >= threshold`` (``anomaly_when='low'``
gives the reference's literal ``score < threshold``); the positive class of
every metric is the anomaly; the label is 1 = normal, 0 = anomaly.

Scale notes
* Confusion counts and metrics are one aggregate with four ``count_if``.
* Curves collapse rows to distinct scores first, then take running totals
  with ``prefix_sums`` (range partitioned, no single-partition window).
* AUC is a sum over distinct scores of ``fp * (tp_above + tp/2)``; no pairs.
* The 100-step sweep maps each row to the highest step it passes (an
  arithmetic index checked against the exact step values), so the rows are
  aggregated once and only the 100-row step table is windowed; no cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.ranking import prefix_sums
from tidewatch.operators.schema import q

METRICS = ["accuracy", "precision", "recall", "f1", "false_positive_rate"]


def _is_anom(label: str, anomaly_label: int = 0):
    # a row without a label is not known to be an anomaly: it counts as normal
    return F.coalesce(F.col(q(label)) == F.lit(anomaly_label), F.lit(False))


def predict(df: DataFrame, score: str, threshold: float, out: str = "prediction",
            anomaly_when: str = "high") -> DataFrame:
    """-1 (anomaly) or 1 (normal) from a score and a threshold."""
    s = F.col(q(score))
    flag = s >= F.lit(threshold) if anomaly_when == "high" else s < F.lit(threshold)
    return df.withColumn(out, F.when(flag, -1).otherwise(1))


def combine_flags(df: DataFrame, row_pred: str, entity_flag: str, out: str = "combined") -> DataFrame:
    """Anomaly only when the row model and the entity profile both flag."""
    both = (F.col(q(row_pred)) == -1) & F.col(q(entity_flag))
    return df.withColumn(out, F.when(both, -1).otherwise(1))


def confusion(df: DataFrame, label: str, pred: str, anomaly_label: int = 0) -> DataFrame:
    """M1: tp, fp, tn, fn (positive = anomaly) in one pass, zeros kept.  Every
    row counts once: a missing label or prediction counts as normal."""
    a = _is_anom(label, anomaly_label)
    p = F.coalesce(F.col(q(pred)) == -1, F.lit(False))
    return df.agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"),
                  F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"))


def confusion_table(df: DataFrame, label: str, pred: str, anomaly_label: int = 0) -> DataFrame:
    """M1 as a labelled table: (actual, predicted, count) over {-1, 1}²."""
    c = confusion(df, label, pred, anomaly_label)
    rows = F.array(
        F.struct(F.lit(-1).alias("actual"), F.lit(-1).alias("predicted"), F.col("tp").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(-1).alias("predicted"), F.col("fp").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tn").alias("count")),
        F.struct(F.lit(-1).alias("actual"), F.lit(1).alias("predicted"), F.col("fn").alias("count")))
    return c.select(F.explode(rows).alias("r")).select("r.*")


def _ratio(a, b):
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def metrics_from_counts(c: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return c.select(_ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"), _ratio(fp, fp + tn).alias("false_positive_rate"))


def metrics(df: DataFrame, label: str, pred: str, score: str | None = None,
            anomaly_label: int = 0) -> DataFrame:
    """M2 + M6 (+ M5 when a score is given): one-row metrics table."""
    m = metrics_from_counts(confusion(df, label, pred, anomaly_label))
    if score is None:
        return m
    return _attach(m, roc_auc(df, label, score, anomaly_label))


def _attach(one_row_a: DataFrame, one_row_b: DataFrame) -> DataFrame:
    """Side-by-side of two one-row tables (join on a constant key)."""
    a = one_row_a.withColumn("_k", F.lit(1))
    b = one_row_b.withColumn("_k", F.lit(1))
    return a.join(F.broadcast(b), "_k").drop("_k")


def _score_counts(df: DataFrame, label: str, score: str, anomaly_label: int) -> DataFrame:
    a = _is_anom(label, anomaly_label)
    return df.where(F.col(q(score)).isNotNull()).groupBy(F.col(q(score)).alias("threshold")).agg(
        F.count_if(a).alias("tp_at"), F.count_if(~a).alias("fp_at"))


def _curve_base(df, label, score, anomaly_label):
    counts = _score_counts(df, label, score, anomaly_label)
    cum = prefix_sums(counts, ["threshold"], ["tp_at", "fp_at"], descending=True)
    tot = counts.agg(F.sum("tp_at").alias("P"), F.sum("fp_at").alias("N"))
    return _attach(cum, tot)


def pr_curve(df: DataFrame, label: str, score: str, anomaly_label: int = 0) -> DataFrame:
    """M3: precision and recall when flagging ``score >= threshold``, one row
    per distinct score."""
    b = _curve_base(df, label, score, anomaly_label)
    tp, fp = F.col("cum_tp_at"), F.col("cum_fp_at")
    return b.select("threshold", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("P")).alias("recall"))


def roc_curve(df: DataFrame, label: str, score: str, anomaly_label: int = 0) -> DataFrame:
    """M4: false and true positive rate per distinct score threshold."""
    b = _curve_base(df, label, score, anomaly_label)
    return b.select("threshold", _ratio(F.col("cum_fp_at"), F.col("N")).alias("fpr"),
                    _ratio(F.col("cum_tp_at"), F.col("P")).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str, anomaly_label: int = 0) -> DataFrame:
    """M5: trapezoid area under the ROC curve through all distinct scores
    (= Mann-Whitney with ties counted one half)."""
    b = _curve_base(df, label, score, anomaly_label)
    area = F.sum(F.col("fp_at") * (F.col("cum_tp_at") - F.col("tp_at") / 2.0))
    return b.agg((area / (F.first("P") * F.first("N"))).alias("roc_auc"))


def _step_index(s, lo, step, n):
    """Highest i with lo + i*step <= s (exact against the step values)."""
    est = F.least(F.greatest(F.floor((s - lo) / step).cast("int"), F.lit(0)), F.lit(n - 1))
    t = lambda i: F.when(i >= n - 1, F.col("_hi")).otherwise(lo + i.cast("double") * step)
    down = F.when(t(est) > s, est - 1).otherwise(est)
    return F.when((down + 1 <= n - 1) & (t(down + 1) <= s), down + 1).otherwise(down)


def threshold_sweep(df: DataFrame, label: str, score: str, steps: int = 100,
                    anomaly_label: int = 0) -> DataFrame:
    """M7: ``steps`` evenly spaced thresholds from min to max score; precision,
    recall, f1 and false-positive rate of flagging ``score >= threshold``."""
    s = F.col(q(score)).cast("double")
    base = df.where(F.col(q(score)).isNotNull()).select(s.alias("_s"), _is_anom(label, anomaly_label).alias("_a"))
    rng = base.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    rng = rng.withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(steps - 1)))
    j = _attach(base, rng)
    idx = F.when(F.col("_step") == 0, F.lit(steps - 1)).otherwise(
        _step_index(F.col("_s"), F.col("_lo"), F.col("_step"), steps))
    per = j.groupBy(idx.alias("i")).agg(F.count_if(F.col("_a")).alias("tp_i"), F.count_if(~F.col("_a")).alias("fp_i"))
    spark = df.sparkSession
    grid = spark.range(steps).select(F.col("id").cast("int").alias("i"))
    grid = _attach(grid, rng)
    thr = F.when(F.col("i") == steps - 1, F.col("_hi")).otherwise(F.col("_lo") + F.col("i").cast("double") * F.col("_step"))
    g = grid.join(per, "i", "left").fillna(0, ["tp_i", "fp_i"])
    # the grid has ``steps`` rows: a window over it is tiny
    w = Window.orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy()
    g = g.select("i", thr.alias("threshold"), F.sum("tp_i").over(w).alias("tp"), F.sum("fp_i").over(w).alias("fp"),
                 F.sum("tp_i").over(wt).alias("P"), F.sum("fp_i").over(wt).alias("N"))
    tp, fp = F.col("tp"), F.col("fp")
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, F.col("P"))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return g.select("i", "threshold", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    _ratio(fp, F.col("N")).alias("false_positive_rate"))


def best_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """M8: the sweep row maximising f1 / precision / recall (first step on
    ties), or with the lowest FPR among recall >= 0.5 (else best f1)."""
    if metric in ("f1", "precision", "recall"):
        return sweep.orderBy(F.col(metric).desc(), F.col("i").asc()).limit(1)
    if metric == "false_positive_rate":
        ok = sweep.where(F.col("recall") >= 0.5)
        cand = ok.orderBy(F.col("false_positive_rate").asc(), F.col("i").asc()).limit(1)
        fallback = sweep.orderBy(F.col("f1").desc(), F.col("i").asc()).limit(1)
        # 0 or 1 row from ``cand``; take the fallback only when it is empty
        both = cand.withColumn("_r", F.lit(0)).unionByName(fallback.withColumn("_r", F.lit(1)))
        return both.orderBy("_r").limit(1).drop("_r")
    raise ValueError(f"Unsupported metric: {metric}")


def score_histogram(df: DataFrame, label: str, score: str, bins: int = 50) -> DataFrame:
    """M9: per class, counts of ``bins`` equal-width bins over that class's range."""
    s = F.col(q(score)).cast("double")
    base = df.where(F.col(q(score)).isNotNull()).select(F.col(q(label)).alias("label"), s.alias("_s"))
    rng = base.groupBy("label").agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    j = base.join(F.broadcast(rng), "label")  # one row per class
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_s") - F.col("_lo")) / width).cast("int"), F.lit(bins - 1)))
    out = j.groupBy("label", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"),
                                                  F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return out.select("label", "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_start"), "count")


def comparison(named: dict) -> DataFrame:
    """M10 + I1: metric rows of several models, one row each, union by name
    (missing metrics become NULL)."""
    out = None
    for name, m in named.items():
        row = m.withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out


def entity_report(rows: DataFrame, entity_col: str, score: str, pred: str,
                  entity_scores: DataFrame) -> DataFrame:
    """Per entity, rows, rows flagged by the row model, mean row score and
    the entity's profile score (NULL when not flagged by the profile)."""
    per = rows.groupBy(F.col(q(entity_col)).alias("entity")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(q(pred)) == -1).alias("n_flagged"),
        F.avg(q(score)).alias("mean_score"))
    return per.join(entity_scores.select("entity", "anomaly_score"), "entity", "left")
