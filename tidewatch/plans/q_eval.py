"""Checks of thresholding and evaluation (B18, B19, I1, A15, M1-M12) with
``Flow Duration`` of ``event_flows`` as the anomaly score and ``Label = 0``
(error events) as the anomaly class."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evaluate as M
from tidewatch.operators import profile
from tidewatch.plans import q_profile as QP
from tidewatch.plans.registry import r6, register
from tidewatch.sources import sinks
from tidewatch.sources.fixtures import EVENT_FLOWS_SQL, event_flows

SCORE, LABEL, THRESHOLD = "Flow Duration", "Label", 30.0
EF = f"ef as ({EVENT_FLOWS_SQL})"
PRED = f'case when "Flow Duration" >= {THRESHOLD} then -1 else 1 end'
CONF = f"""conf as (select count(*) filter (where "Label" = 0 and p = -1) as tp,
  count(*) filter (where "Label" <> 0 and p = -1) as fp, count(*) filter (where "Label" <> 0 and p = 1) as tn,
  count(*) filter (where "Label" = 0 and p = 1) as fn from (select *, {PRED} as p from ef))"""


def _met(c="conf"):
    prec = f"case when tp + fp > 0 then tp / (tp + fp) else 0.0 end"
    rec = f"case when tp + fn > 0 then tp / (tp + fn) else 0.0 end"
    f1 = f"case when ({prec}) + ({rec}) > 0 then 2 * ({prec}) * ({rec}) / (({prec}) + ({rec})) else 0.0 end"
    return (f"select {r6('(tp + tn) / (tp + fp + tn + fn)')} as accuracy, {r6(prec)} as precision, "
            f"{r6(rec)} as recall, {r6(f1)} as f1, "
            f"{r6('case when fp + tn > 0 then fp / (fp + tn) else 0.0 end')} as false_positive_rate from {c}")


AUC_SQL = """auc as (select (sum(case when "Label" = 0 then ar else 0 end) - p * (p + 1) / 2.0) / (p * n) as roc_auc
  from (select "Label", rank() over (order by "Flow Duration") + (count(*) over (partition by "Flow Duration") - 1) / 2.0 as ar,
               count(*) filter (where "Label" = 0) over () as p, count(*) filter (where "Label" <> 0) over () as n
        from ef) group by p, n)"""


def flows(spark, sf_dir):
    return event_flows(spark, sf_dir)


def predicted(spark, sf_dir):
    return M.predict(flows(spark, sf_dir), SCORE, THRESHOLD)


@register("b18_threshold_predict", f"with {EF} select flow_id, {PRED} as prediction from ef")
def b18_threshold_predict(spark, sf_dir):
    return predicted(spark, sf_dir).select("flow_id", "prediction")


@register("m1_confusion_matrix", f"""with {EF}, {CONF}
select -1 as actual, -1 as predicted, tp as "count" from conf union all select 1, -1, fp from conf
union all select 1, 1, tn from conf union all select -1, 1, fn from conf""")
def m1_confusion_matrix(spark, sf_dir):
    return M.confusion_table(predicted(spark, sf_dir), LABEL, "prediction")


@register("m2_metrics", f"with {EF}, {CONF} {_met()}")
def m2_metrics(spark, sf_dir):
    return M.metrics(predicted(spark, sf_dir), LABEL, "prediction")


@register("m6_false_positive_rate", f"""with {EF}, {CONF}
select {r6('case when fp + tn > 0 then fp / (fp + tn) else 0.0 end')} as false_positive_rate from conf""")
def m6_false_positive_rate(spark, sf_dir):
    return M.metrics(predicted(spark, sf_dir), LABEL, "prediction").select("false_positive_rate")


_CURVE = f"""cnt as (select "Flow Duration" as threshold, count(*) filter (where "Label" = 0) as tpa,
  count(*) filter (where "Label" <> 0) as fpa from ef group by 1),
cum as (select threshold, sum(tpa) over (order by threshold desc) as tp, sum(fpa) over (order by threshold desc) as fp,
  sum(tpa) over () as p, sum(fpa) over () as n from cnt)"""


@register("m3_pr_curve", f"""with {EF}, {_CURVE}
select {r6('threshold')} as threshold, {r6('case when tp + fp > 0 then tp / (tp + fp) else 0.0 end')} as precision,
  {r6('case when p > 0 then tp / p else 0.0 end')} as recall from cum""")
def m3_pr_curve(spark, sf_dir):
    return M.pr_curve(flows(spark, sf_dir), LABEL, SCORE)


@register("m4_roc_curve", f"""with {EF}, {_CURVE}
select {r6('threshold')} as threshold, {r6('case when n > 0 then fp / n else 0.0 end')} as fpr,
  {r6('case when p > 0 then tp / p else 0.0 end')} as tpr from cum""")
def m4_roc_curve(spark, sf_dir):
    return M.roc_curve(flows(spark, sf_dir), LABEL, SCORE)


@register("m5_roc_auc", f"with {EF}, {AUC_SQL} select {r6('roc_auc')} as roc_auc from auc")
def m5_roc_auc(spark, sf_dir):
    return M.roc_auc(flows(spark, sf_dir), LABEL, SCORE)


_SWEEP = f"""rng as (select min("Flow Duration") as lo, max("Flow Duration") as hi from ef),
grid as (select cast(i as integer) as i, case when i = 99 then hi else lo + i * ((hi - lo) / 99.0) end as t
  from rng, generate_series(0, 99) g(i)),
sw as (select i, t, count(*) filter (where "Label" = 0 and "Flow Duration" >= t) as tp,
  count(*) filter (where "Label" <> 0 and "Flow Duration" >= t) as fp,
  count(*) filter (where "Label" = 0) as p, count(*) filter (where "Label" <> 0) as n
  from grid, ef group by i, t),
sm as (select i, t, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as pr,
  case when p > 0 then tp / p else 0.0 end as rc, case when n > 0 then fp / n else 0.0 end as fpr from sw),
sm2 as (select *, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0.0 end as f1 from sm)"""
_SWEEP_OUT = (f"i, {r6('t')} as threshold, {r6('pr')} as precision, {r6('rc')} as recall, {r6('f1')} as f1, "
              f"{r6('fpr')} as false_positive_rate")


@register("m7_threshold_sweep", f"with {EF}, {_SWEEP} select {_SWEEP_OUT} from sm2")
def m7_threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(flows(spark, sf_dir), LABEL, SCORE)


@register("m8_best_threshold_f1", f"with {EF}, {_SWEEP} select {_SWEEP_OUT} from sm2 order by f1 desc, i limit 1")
def m8_best_threshold_f1(spark, sf_dir):
    return M.best_threshold(M.threshold_sweep(flows(spark, sf_dir), LABEL, SCORE), "f1")


@register("m8_best_threshold_fpr", f"""with {EF}, {_SWEEP}
select {_SWEEP_OUT} from sm2 where rc >= 0.5 order by fpr, i limit 1""")
def m8_best_threshold_fpr(spark, sf_dir):
    return M.best_threshold(M.threshold_sweep(flows(spark, sf_dir), LABEL, SCORE), "false_positive_rate")


@register("m9_score_histogram", f"""with {EF},
rng as (select "Label" as lbl, min("Flow Duration") as lo, max("Flow Duration") as hi from ef group by 1),
b as (select lbl as label, lo, (hi - lo) / 50.0 as w, case when (hi - lo) / 50.0 = 0 then 0 else
  least(cast(floor(("Flow Duration" - lo) / ((hi - lo) / 50.0)) as integer), 49) end as bin
  from ef join rng on ef."Label" = rng.lbl)
select label, bin, {r6('lo + bin * w')} as bin_start, count(*) as "count" from b group by label, bin, lo, w""")
def m9_score_histogram(spark, sf_dir):
    return M.score_histogram(flows(spark, sf_dir), LABEL, SCORE)


_CONF2 = CONF.replace("conf as", "conf2 as").replace('"Flow Duration" >=', '"Destination IP" >=') \
    .replace(f">= {THRESHOLD}", ">= 50")


@register("m10_model_comparison", f"""with {EF}, {CONF}, {_CONF2}, {AUC_SQL},
auc2 as (select (sum(case when "Label" = 0 then ar else 0 end) - p * (p + 1) / 2.0) / (p * n) as roc_auc
  from (select "Label", rank() over (order by "Destination IP") + (count(*) over (partition by "Destination IP") - 1) / 2.0 as ar,
        count(*) filter (where "Label" = 0) over () as p, count(*) filter (where "Label" <> 0) over () as n from ef)
  group by p, n)
select *, 'duration' as model, (select {r6('roc_auc')} from auc) as roc_auc from ({_met()})
union all select *, 'destination', (select {r6('roc_auc')} from auc2) from ({_met('conf2')})""")
def m10_model_comparison(spark, sf_dir):
    ef = flows(spark, sf_dir)
    a = M.metrics(M.predict(ef, SCORE, THRESHOLD), LABEL, "prediction", score=SCORE)
    b = M.metrics(M.predict(ef, "Destination IP", 50), LABEL, "prediction", score="Destination IP")
    return M.comparison({"duration": a, "destination": b})


@register("i1_union_metric_rows", f"""with {EF}, {CONF}, {AUC_SQL}
select *, 'duration' as model, (select {r6('roc_auc')} from auc) as roc_auc from ({_met()})
union all select *, 'duration_no_auc', null from ({_met()})""")
def i1_union_metric_rows(spark, sf_dir):
    """Rows with and without roc_auc, unioned by name."""
    p = predicted(spark, sf_dir)
    return M.comparison({"duration": M.metrics(p, LABEL, "prediction", score=SCORE),
                         "duration_no_auc": M.metrics(p, LABEL, "prediction")})


@register("a15_result_summary", f"""with {EF}, {CONF}, m as ({_met()})
unpivot (select round(accuracy, 4) as accuracy, round(precision, 4) as precision, round(recall, 4) as recall,
  round(f1, 4) as f1, round(false_positive_rate, 4) as false_positive_rate from m)
on accuracy, precision, recall, f1, false_positive_rate into name metric value value""")
def a15_result_summary(spark, sf_dir):
    return sinks.result_summary(M.metrics(predicted(spark, sf_dir), LABEL, "prediction"))


# ---- combined decision (row model AND entity profile) --------------------------------

_ENT = QP.with_sql(*QP._Z_CTES, QP._report_sql(QP.STRICT))[len("with "):]
_COMB = f"""cmb as (select ef.*, {PRED} as p, ("Source IP" in (select entity from rep)) as ent,
  case when ({PRED}) = -1 and ("Source IP" in (select entity from rep)) then -1 else 1 end as c from ef)"""


def combined(spark, sf_dir):
    rep = profile.anomalous_entities(QP.zscores(spark, sf_dir), QP.STRICT)
    rows = profile.entity_flag(predicted(spark, sf_dir), "Source IP", rep)
    return M.combine_flags(rows, "prediction", "entity_anomalous"), rep


@register("b19_combined_decision", f"with {_ENT}, {_COMB} select flow_id, c as combined from cmb")
def b19_combined_decision(spark, sf_dir):
    rows, _ = combined(spark, sf_dir)
    return rows.select("flow_id", "combined")


@register("m11_combined_metrics", f"""with {_ENT}, {_COMB},
conf as (select count(*) filter (where "Label" = 0 and c = -1) as tp, count(*) filter (where "Label" <> 0 and c = -1) as fp,
  count(*) filter (where "Label" <> 0 and c = 1) as tn, count(*) filter (where "Label" = 0 and c = 1) as fn from cmb)
{_met()}""")
def m11_combined_metrics(spark, sf_dir):
    rows, _ = combined(spark, sf_dir)
    return M.metrics(rows, LABEL, "combined")


@register("m12_entity_report", f"""with {_ENT}, {_COMB}
select "Source IP" as entity, count(*) as n_rows, count(*) filter (where p = -1) as n_flagged,
  {r6('avg("Flow Duration")')} as mean_score, {r6('(select anomaly_score from rep where rep.entity = cmb."Source IP")')} as anomaly_score
from cmb group by 1""")
def m12_entity_report(spark, sf_dir):
    rows, rep = combined(spark, sf_dir)
    return M.entity_report(rows, "Source IP", SCORE, "prediction", rep)
