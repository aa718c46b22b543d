"""Checks of missing values: NULL times and labels, NaN, integer gaps; and of
the second baseline, the ensemble's own evaluation and stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import balance, derive, describe, profile, schema
from tidewatch.operators import evaluate as M
from tidewatch.operators import preprocess as P
from tidewatch.operators import sample as S
from tidewatch.plans import q_eval as QE
from tidewatch.plans import q_models as QM
from tidewatch.plans import q_prep as QP
from tidewatch.plans import q_profile as QF
from tidewatch.plans import q_sources as QS
from tidewatch.plans.q_profile import ENTITY, with_sql
from tidewatch.plans.registry import floor_sql, r6, register, ts_sql
from tidewatch.session import materialize, new_scratch_path

EF = QP.EF
HOLES = ("hl as (select flow_id, case when flow_id % 11 = 0 then 'nan'::double when flow_id % 13 = 0 then null else \"Flow Duration\" end as duration, "
         "case when flow_id % 3 = 0 then null else cast(flow_id % 8 as integer) end as small, "
         "case when flow_id % 7 = 0 then null else \"Label\" end as label from ef)")
SEEN = "case when isnan(duration) then null else duration end"


def holes(spark, sf_dir):
    """event_flows with NaN and NULL durations, an integer column and a label with gaps."""
    k = F.col("flow_id")
    duration = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 13 == 0, F.lit(None)).otherwise(F.col("`Flow Duration`"))
    return QP.flows(spark, sf_dir).select(
        "flow_id", duration.alias("duration"), F.when(k % 3 != 0, (k % 8).cast("int")).alias("small"),
        F.when(k % 7 != 0, F.col("Label")).alias("label"))


@register("c1_missing_with_nan", f"""with {EF}, {HOLES}
select 'duration' as "column", count(*) filter (where duration is null or isnan(duration)) as n_missing from hl
union all select 'small', count(*) filter (where small is null) from hl
union all select 'label', count(*) filter (where label is null) from hl""")
def c1_missing_with_nan(spark, sf_dir):
    return describe.null_counts(holes(spark, sf_dir))


@register("c2_median_of_gaps", f"""with {EF}, {HOLES},
m as (select quantile_cont({SEEN}, 0.5) as d, quantile_cont(small::double, 0.5) as s from hl)
select flow_id, {r6(f'coalesce({SEEN}, d)')} as duration, {r6('coalesce(small::double, s)')} as small from hl, m""")
def c2_median_of_gaps(spark, sf_dir):
    """NaN is a gap like NULL, and an integer column takes a fractional median."""
    out, _ = P.impute(holes(spark, sf_dir), ["duration", "small"], [])
    return out.select("flow_id", "duration", "small")


@register("d6_standard_scale_with_nan", f"""with {EF}, {HOLES},
m as (select avg({SEEN}) as a, stddev_pop({SEEN}) as b from hl)
select flow_id, {r6(f'({SEEN} - a) / b')} as duration from hl, m""")
def d6_standard_scale_with_nan(spark, sf_dir):
    df = holes(spark, sf_dir).select("flow_id", "duration")
    out = P.fit_scaler(df, ["duration"], "standard").apply(df)
    return out.select("flow_id", F.when(~F.isnan("duration"), F.col("duration")).alias("duration"))


@register("f9_summary_with_nan", f"""with {EF}, {HOLES}
select 'duration' as "column", count({SEEN}) as "count", {r6(f'avg({SEEN})')} as mean, {r6(f'stddev_samp({SEEN})')} as std,
  {r6(f'min({SEEN})')} as "min", {r6(f'quantile_cont({SEEN}, 0.25)')} as q1, {r6(f'quantile_cont({SEEN}, 0.5)')} as median,
  {r6(f'quantile_cont({SEEN}, 0.75)')} as q3, {r6(f'max({SEEN})')} as "max" from hl""")
def f9_summary_with_nan(spark, sf_dir):
    return describe.summary(holes(spark, sf_dir), ["duration"])


@register("e6_undersample_null_labels", f"""with {EF}, {HOLES},
r as (select flow_id, label, row_number() over (partition by label order by {QP.H15.format(k='flow_id')}, flow_id) as rn from hl)
select flow_id, coalesce(label, -1) as label from r
where label is null or label = 0 or rn <= (select cast(count(*) / 0.5 as bigint) from hl where label = 0)""")
def e6_undersample_null_labels(spark, sf_dir):
    """Rows without a label stay and are no class."""
    out = S.undersample(holes(spark, sf_dir).select("flow_id", "label"), "label", "flow_id", 0.5)
    return out.select("flow_id", F.coalesce("label", F.lit(-1)).alias("label"))


@register("e9_balance_train_null_split", f"""with {EF}, {HOLES},
x as (select flow_id, "Label" as label, case when flow_id % 5 = 0 then null when flow_id % 5 = 1 then 'test' else 'train' end as split from ef),
r as (select *, row_number() over (partition by label, split order by {QP.H15.format(k='flow_id')}, flow_id) as rn from x)
select flow_id, label, split from r where split is null or split = 'test' or label = 0
  or rn <= (select cast(count(*) / 0.5 as bigint) from x where label = 0 and split = 'train')""")
def e9_balance_train_null_split(spark, sf_dir):
    """Only the train split is balanced; rows without a split pass through."""
    k = F.col("flow_id")
    split = F.when(k % 5 == 1, "test").when(k % 5 != 0, "train")
    df = QP.flows(spark, sf_dir).select("flow_id", F.col("Label").alias("label"), split.alias("split"))
    return balance.balance_train(df, label="label", key="flow_id", method="undersample", ratio=0.5)


@register("m1_confusion_null_labels", f"""with {EF}, {HOLES},
c as (select coalesce(label = 0, false) as a, coalesce(duration >= 30 or isnan(duration), false) as p from hl)
select count(*) filter (where a and p) as tp, count(*) filter (where not a and p) as fp,
       count(*) filter (where not a and not p) as tn, count(*) filter (where a and not p) as fn from c""")
def m1_confusion_null_labels(spark, sf_dir):
    """M1: every row is counted; a missing label or prediction counts as normal."""
    df = holes(spark, sf_dir).withColumn("p", F.when(F.col("duration").isNotNull(), F.when(F.col("duration") >= 30.0, -1).otherwise(1)))
    return M.confusion(df, "label", "p")


def _is_whole(name: str) -> bool:
    return name.endswith(("_nunique", "_count")) or name == "Total Backward Packets_sum"


def _whole(name: str) -> str:
    return f'coalesce(cast(w."{name}" as bigint), -1) as "{name}"'


@register("f2_row_window_null_times", f"""with {QS.STD_LI_SQL},
lg as (select * replace (case when l_linenumber = 3 then null else "Timestamp" end as "Timestamp") from li),
lw as (select *, {floor_sql('"Timestamp"', QS.WEEK)} as time_window from lg),
w as (select "Source IP", time_window, {', '.join(f'{e} as "{n}"' for n, e in QS._F2_AGGS)} from lw where time_window is not null group by 1, 2)
select lw.l_orderkey, lw.l_linenumber, lw."Source IP", {ts_sql('lw.time_window')} as time_window,
{', '.join(_whole(n) if _is_whole(n) else QS._f2_out(n) for n, _ in QS._F2_AGGS)}
from lw left join w on lw."Source IP" = w."Source IP" and lw.time_window = w.time_window""")
def f2_row_window_null_times(spark, sf_dir):
    """F1 + F2: flows without a time stay, without window features."""
    df = QS.std_lineitem(spark, sf_dir)
    df = df.withColumn("Timestamp", F.when(F.col("l_linenumber") != 3, F.col("Timestamp")))
    out = derive.row_window_features(df, "Timestamp", QS.WEEK)
    keep = ["l_orderkey", "l_linenumber", "Source IP", "time_window"] + [n for n, _ in QS._F2_AGGS]
    return out.select(*[F.coalesce(schema.q(c), F.lit(-1)).alias(c) if _is_whole(c) else schema.q(c) for c in keep])


@register("j1_z_scores_statistic_baseline", with_sql(QF.LONG_SQL, QF.PROF_SQL, QF.PLONG_SQL,
          "b as (select feature, stat, avg(value) as m, stddev_samp(value) as s from plong where value is not null group by 1, 2)") +
          f"select entity, p.feature, p.stat, {r6('value')} as value, {r6('abs((value - m) / s)')} as z "
          "from plong p join b on p.feature = b.feature and p.stat = b.stat where value is not null and s >= 1e-10")
def j1_z_scores_statistic_baseline(spark, sf_dir):
    """J1 with each statistic against the same statistic of all entities."""
    fw = materialize(QF.features(spark, sf_dir), "entity-windows")
    return profile.z_scores(profile.entity_profiles(fw, ENTITY), profile.global_profile(fw, ENTITY), baseline="statistic")


_ENS = QM._members_sql()


@register("l9_ensemble_metrics", _ENS + """, conf as (select count(*) filter (where "Label" = 0 and v = -1) as tp,
  count(*) filter (where "Label" <> 0 and v = -1) as fp, count(*) filter (where "Label" <> 0 and v = 1) as tn,
  count(*) filter (where "Label" = 0 and v = 1) as fn
  from (select "Label", case when p0 + p1 + p2 > 0 then 1 else -1 end as v from pr)) """ + QE._met())
def l9_ensemble_metrics(spark, sf_dir):
    """The ensemble's own evaluation (hard vote)."""
    ens, ef = QM._members(spark, sf_dir)
    return ens.evaluate(ef, "Label").select(*M.METRICS)


@register("l9_ensemble_best_threshold", _ENS + f""", ef2 as (select "Label", es as "Flow Duration" from pr), {QE._SWEEP.replace('ef', 'ef2')}
select {r6('t')} as threshold from sm2 order by f1 desc, i limit 1""")
def l9_ensemble_best_threshold(spark, sf_dir):
    """L9 + M7 + M8: the threshold tuned on the ensemble score."""
    ens, ef = QM._members(spark, sf_dir)
    return spark.range(1).select(F.lit(ens.find_optimal_threshold(ef, "Label")).alias("threshold"))


@register("a12_reloaded_scores_equal", f"with {QM.V} select count(*) as n_rows, 0 as n_different from v")
def a12_reloaded_scores_equal(spark, sf_dir):
    """Rows, and rows whose score changes when the model is loaded back."""
    from tidewatch.operators.detect import AnomalyDetector
    v = QM.vectors(spark, sf_dir).select("vec_id", "features")
    det = AnomalyDetector("isolation_forest", key="vec_id", vec="features").fit(v)
    path = det.save(spark, new_scratch_path(spark, "iforest"))
    both = det.score(v).select("vec_id", F.col("score").alias("a")).join(
        AnomalyDetector.load(spark, path).score(v).select("vec_id", F.col("score").alias("b")), "vec_id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("a") != F.col("b")).cast("int").alias("n_different"))


@register("l6_lof_offset", f"""with {QM.V},
fnn as (select * from (select a.vec_id as p, b.vec_id as o, list_distance(a.features, b.features) as d,
   row_number() over (partition by a.vec_id order by round(list_distance(a.features, b.features), 9), b.vec_id) as rk
   from v a join v b on a.vec_id <> b.vec_id) where rk <= {QM.LOF_K}),
kd as (select p as o, d as kdist from fnn where rk = {QM.LOF_K}),
lrd as (select f.p, 1 / (avg(greatest(kd.kdist, f.d)) + 1e-10) as lrd from fnn f join kd on f.o = kd.o group by f.p),
own as (select f.p, avg(b.lrd) / any_value(a.lrd) as lof from fnn f join lrd b on f.o = b.p join lrd a on f.p = a.p group by f.p)
select {r6('quantile_cont(lof, 0.9)')} as lof_offset from own""")
def l6_lof_offset(spark, sf_dir):
    """The offset is a quantile of the training rows' own LOF."""
    from tidewatch.operators.detect.lof import fit_lof
    model = fit_lof(QM.vectors(spark, sf_dir).select("vec_id", "features"), "vec_id", "features", QM.LOF_K, contamination=0.1)
    return spark.range(1).select(F.lit(float(model.offset)).alias("lof_offset"))
