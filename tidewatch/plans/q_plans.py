"""Checks of the compositions (Q1-Q5) and of the sinks that persist their
results (A8-A13).  Written tables go to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import profile
from tidewatch.plans import q_eval as QE
from tidewatch.plans import q_prep as QR
from tidewatch.plans import q_profile as QP
from tidewatch.plans.q_models import _smote_sql as smote_sql
from tidewatch.plans.q_models import r6list
from tidewatch.plans.registry import ORACLES, qi, r6, register
from tidewatch.session import new_scratch_path
from tidewatch.sources import sinks
from tidewatch.sources.fixtures import event_flows, vectors

_Q1_COLS = ["flow_id", "Label", "duration_gap", "Destination Port", "protocol_gap"]
_H = QR.H15.format(k="flow_id")
_Q1_SQL = f"""with {QR.EF}, {QR.SPLIT_SQL},
tr as (select * from sp where split = 'train'),
md as (select quantile_cont(duration_gap, 0.5) as v from tr),
mo as (select protocol_gap as v from tr where protocol_gap is not null group by 1 order by count(*) desc, 1 limit 1),
f as (select flow_id, "Label", split, coalesce(duration_gap, (select v from md)) as dg, "Destination Port" as dp,
      coalesce(protocol_gap, (select v from mo)) as pg from sp),
codes as (select v, dense_rank() over (order by v) as code from (select distinct pg as v from f where split = 'train')),
st as (select avg(dg) as a1, stddev_pop(dg) as s1, avg(dp) as a2, stddev_pop(dp) as s2 from f where split = 'train'),
o as (select flow_id, "Label", split, (dg - a1) / s1 as duration_gap, (dp - a2) / s2 as "Destination Port",
      cast(coalesce(code, -1) as bigint) as protocol_gap from f left join codes on f.pg = codes.v, st),
tr2 as (select *, row_number() over (partition by "Label" order by {_H}, flow_id) as rn from o where split = 'train')
"""
_Q1_OUT = f'flow_id, "Label", {r6("duration_gap")} as duration_gap, {r6(qi("Destination Port"))} as "Destination Port", protocol_gap, split'


def _q1(spark, sf_dir, balance="undersample"):
    from tidewatch.plans.preprocess import preprocess
    df = event_flows(spark, sf_dir).select(*[f"`{c}`" for c in _Q1_COLS])
    return preprocess(df, "Label", "flow_id", encoding="label", scaling="standard",
                      balance_method=balance, ratio=0.5)


@register("q1_preprocess", _Q1_SQL + f"""select {_Q1_OUT} from o where split <> 'train'
union all select {_Q1_OUT} from tr2 where "Label" = 0 or rn <= (select cast(count(*) / 0.5 as bigint) from o
  where split = 'train' and "Label" = 0)""")
def q1_preprocess(spark, sf_dir):
    """Q1: split -> impute / encode / scale fitted on train -> undersample train."""
    out, _ = _q1(spark, sf_dir)
    return out.select("flow_id", "Label", "duration_gap", "`Destination Port`", "protocol_gap", "split")


_Q1_SMOTE_SQL = _Q1_SQL + f""", x as (
  select flow_id as vec_id, "Label" as label, split,
         list_concat([duration_gap, cast("Destination Port" as double)],
                     list_transform(range((select count(*) from codes)), lambda i: case when i + 1 = protocol_gap then 1.0::double else 0.0::double end)) as features
  from o),
xt as (select vec_id, features, label from x where split = 'train'), {smote_sql('xt')}
select vec_id as flow_id, label as "Label", {r6list('features')} as features, 'train' as split from bal
union all select vec_id, label, {r6list('features')} as features, split from x where split <> 'train'"""


@register("q1_preprocess_smote", _Q1_SMOTE_SQL)
def q1_preprocess_smote(spark, sf_dir):
    """Q1 as it is by default: sparse one-hot, standard scaling, SMOTE on train
    over all feature columns; the features are shown as one array."""
    from tidewatch.plans.preprocess import preprocess
    df = event_flows(spark, sf_dir).select(*[f"`{c}`" for c in _Q1_COLS])
    out, _ = preprocess(df, "Label", "flow_id", ratio=0.5)
    return out.select("flow_id", "Label", "features", "split")


@register("q2_transform_new_rows", _Q1_SQL + f"select {_Q1_OUT} from o where split = 'test'")
def q2_transform_new_rows(spark, sf_dir):
    """Q2: the stored fit applied to rows it never saw (no refit)."""
    out, fitted = _q1(spark, sf_dir, balance=None)
    from tidewatch.operators.sample import stratified_split
    raw = stratified_split(event_flows(spark, sf_dir).select(*[f"`{c}`" for c in _Q1_COLS]), "Label", "flow_id")
    new = fitted.transform(raw.where(F.col("split") == "test"))
    return new.select("flow_id", "Label", "duration_gap", "`Destination Port`", "protocol_gap", "split")


# ---- Q3 + A9 / A10 / A11 ------------------------------------------------------------

def _q3(spark, sf_dir):
    from tidewatch.plans.profiling import run_profiling
    out = new_scratch_path(spark, "profiling")
    res = run_profiling(event_flows(spark, sf_dir), QP.ENTITY, "Timestamp", QP.DAY, QP.STRICT, out_dir=out)
    return res, out


@register("q3_profile_report", ORACLES["j4_anomaly_report"])
def q3_profile_report(spark, sf_dir):
    """Q3: features -> profiles -> z -> report (+ clusters, A9, A10 written)."""
    res, _ = _q3(spark, sf_dir)
    return res.report


REPORT_SCHEMA = T.StructType([T.StructField("entity", T.LongType()), T.StructField("anomaly_score", T.DoubleType()),
                              T.StructField("num_anomalous_features", T.IntegerType()),
                              T.StructField("total_features", T.IntegerType())])


@register("a9_anomaly_table_csv", ORACLES["j2_anomalous_entities_strict"])
def a9_anomaly_table_csv(spark, sf_dir):
    """The four-column report written as CSV by Q3, read back."""
    res, out = _q3(spark, sf_dir)
    res.report.count()
    return spark.read.option("header", True).schema(REPORT_SCHEMA).csv(f"{out}/anomalous_entities.csv")


@register("a10_profiles_round_trip", ORACLES["f5_entity_profiles"])
def a10_profiles_round_trip(spark, sf_dir):
    """A10 + A11: profiles saved as Parquet and loaded back."""
    fw = QP.windows(spark, sf_dir)
    path = new_scratch_path(spark, "profiles")
    sinks.save_profiles(profile.entity_profiles(fw, QP.ENTITY), profile.global_profile(fw, QP.ENTITY),
                        profile.windows_per_entity(fw, QP.ENTITY), path)
    prof, _, _ = sinks.load_profiles(spark, path)
    return prof


@register("a10_wide_profiles", QP.with_sql(QP.LONG_SQL, QP.PROF_SQL, QP._WIDE_SQL) + "select entity, num_time_windows, " + ", ".join(
    f"{r6(qi(c))} as {qi(c)}" for c in QP._PCOLS if c != "num_time_windows") + " from wd")
def a10_wide_profiles(spark, sf_dir):
    """A10 as one wide row per entity, saved and loaded back."""
    fw = QP.windows(spark, sf_dir)
    path = new_scratch_path(spark, "profiles")
    sinks.save_profiles(profile.entity_profiles(fw, QP.ENTITY), profile.global_profile(fw, QP.ENTITY),
                        profile.windows_per_entity(fw, QP.ENTITY), path, features=QP.FEATURES)
    return sinks.load_wide_profiles(spark, path)


@register("a11_reloaded_scoring", ORACLES["j2_anomalous_entities_strict"])
def a11_reloaded_scoring(spark, sf_dir):
    """A11 (R9): scoring works after a reload because the population profile
    is stored beside the entity profiles."""
    fw = QP.windows(spark, sf_dir)
    path = new_scratch_path(spark, "profiles")
    sinks.save_profiles(profile.entity_profiles(fw, QP.ENTITY), profile.global_profile(fw, QP.ENTITY),
                        profile.windows_per_entity(fw, QP.ENTITY), path)
    prof, glob, _ = sinks.load_profiles(spark, path)
    return profile.anomalous_entities(profile.z_scores(prof, glob), QP.STRICT)


@register("a11_reloaded_population_statistics", ORACLES["f13_population_statistics"])
def a11_reloaded_population_statistics(spark, sf_dir):
    fw = QP.windows(spark, sf_dir)
    path = new_scratch_path(spark, "profiles")
    sinks.save_profiles(profile.entity_profiles(fw, QP.ENTITY), profile.global_profile(fw, QP.ENTITY),
                        profile.windows_per_entity(fw, QP.ENTITY), path)
    prof, _, _ = sinks.load_profiles(spark, path)
    return profile.population_statistics(prof)


METRICS_SCHEMA = T.StructType([T.StructField(c, T.DoubleType()) for c in
                               ["accuracy", "precision", "recall", "f1", "false_positive_rate"]])


@register("a8_metrics_csv", ORACLES["m2_metrics"])
def a8_metrics_csv(spark, sf_dir):
    """The metrics row written as CSV and read back."""
    from tidewatch.operators import evaluate as M
    path = new_scratch_path(spark, "metrics") + ".csv"
    sinks.write_metrics(M.metrics(QE.predicted(spark, sf_dir), QE.LABEL, "prediction"), path)
    return spark.read.option("header", True).schema(METRICS_SCHEMA).csv(path)


# ---- Q4 / Q5 / A12 / A13 (rows only: seeded random models) ----------------------------

_DET_COLS = ["flow_id", "Label", "Flow Duration", "Destination IP", "Destination Port"]


def _q4(spark, sf_dir):
    from tidewatch.plans.detection import run_detection
    df = event_flows(spark, sf_dir).select(*[f"`{c}`" for c in _DET_COLS])
    return run_detection(df, "Label", "flow_id", "isolation_forest", balance_method=None,
                         out_dir=new_scratch_path(spark, "detect"))


@register("q4_detect_metrics")
def q4_detect_metrics(spark, sf_dir):
    """Q4: preprocess -> forest on train -> threshold tuned on val (f1) ->
    metrics on test with the tuned threshold (R2)."""
    det, _, metrics = _q4(spark, sf_dir)
    return metrics.withColumn("threshold", F.lit(det.threshold))


@register("q5_combined_decision_metrics")
def q5_combined_decision_metrics(spark, sf_dir):
    """Q5: forest predictions AND entity-profile flags (B19) -> metrics."""
    from tidewatch.plans.detection import combined_decision
    det, rows, _ = _q4(spark, sf_dir)
    ent = event_flows(spark, sf_dir).select("flow_id", "`Source IP`")
    _, m = combined_decision(rows.where(F.col("split") == "test"), det, ent, "flow_id", "Source IP",
                             QP.zscores(spark, sf_dir), "Label", QP.STRICT)
    return m


@register("a12_model_round_trip")
def a12_model_round_trip(spark, sf_dir):
    """A fitted forest saved as tables and loaded back scores the same."""
    from tidewatch.operators.detect import AnomalyDetector
    v = vectors(spark, sf_dir).select("vec_id", "features", "label")
    det = AnomalyDetector("isolation_forest", key="vec_id", vec="features").fit(v)
    path = new_scratch_path(spark, "iforest")
    det.save(spark, path)
    loaded = AnomalyDetector.load(spark, path)
    a = det.score(v).select("vec_id", F.col("score").alias("s_fit"))
    b = loaded.score(v).select("vec_id", F.col("score").alias("s_loaded"))
    return a.join(b, "vec_id")


@register("a13_ensemble_round_trip")
def a13_ensemble_round_trip(spark, sf_dir):
    """Ensemble saved as one sub-directory per member plus voting."""
    from tidewatch.operators.detect import AnomalyDetector, EnsembleAnomalyDetector
    v = vectors(spark, sf_dir).select("vec_id", "features", "label")
    ens = EnsembleAnomalyDetector([AnomalyDetector("isolation_forest", key="vec_id", vec="features"),
                                   AnomalyDetector("local_outlier_factor", key="vec_id", vec="features")],
                                  voting="soft").fit(v)
    path = new_scratch_path(spark, "ensemble")
    ens.save(spark, path)
    loaded = EnsembleAnomalyDetector.load(spark, path)
    return loaded.predict(v).select("vec_id", "score", "prediction")
