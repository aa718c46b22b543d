"""Checks of the profiling and scoring operators (F, G3, G4, H, J, B14-B17)
on ``event_flows``: entity = Source IP (user), one-day windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import derive, profile
from tidewatch.plans.registry import floor_sql, qi, r6, register, ts_sql
from tidewatch.session import materialize
from tidewatch.sources.fixtures import EVENT_FLOWS_SQL, event_flows

DAY = 86400
ENTITY = "Source IP"
COUNT_COLS = ["Destination IP", "Destination Port", "Protocol"]
FLOW_COLS = ["Flow Duration"]
FEATURES = [f"{c}_{s}" for c in COUNT_COLS for s in ("nunique", "count")] + \
    [f"Flow Duration_{s}" for s in ("mean", "std", "min", "max", "sum")]
STRICT = 3.0


def features(spark, sf_dir, seconds=DAY):
    return derive.entity_window_features(event_flows(spark, sf_dir), ENTITY, "Timestamp", seconds)


def profiles(spark, sf_dir):
    return profile.entity_profiles(features(spark, sf_dir), ENTITY)


def windows(spark, sf_dir):
    """The window table, written once: profiles, population and views read it."""
    return materialize(features(spark, sf_dir), "entity-windows")


def zscores(spark, sf_dir, fw=None):
    fw = windows(spark, sf_dir) if fw is None else fw
    return profile.z_scores(profile.entity_profiles(fw, ENTITY), profile.global_profile(fw, ENTITY))


# ---- SQL building blocks (DuckDB) ------------------------------------------------------

def _fw_sql(seconds=DAY):
    aggs = []
    for c in COUNT_COLS:
        aggs.append(f"count(distinct {qi(c)}) as {qi(c + '_nunique')}")
        aggs.append(f"count({qi(c)}) as {qi(c + '_count')}")
    d = qi("Flow Duration")
    aggs += [f"avg({d}) as {qi('Flow Duration_mean')}", f"stddev_samp({d}) as {qi('Flow Duration_std')}",
             f"min({d}) as {qi('Flow Duration_min')}", f"max({d}) as {qi('Flow Duration_max')}",
             f"sum({d}) as {qi('Flow Duration_sum')}"]
    return (f"ef as ({EVENT_FLOWS_SQL}),\n"
            f"fw as (select {qi(ENTITY)}, {floor_sql(qi('Timestamp'), seconds)} as time_window, "
            f"{', '.join(aggs)} from ef where {qi(ENTITY)} is not null and {qi('Timestamp')} is not null "
            f"group by all)")


_CASTS = ", ".join(f"cast({qi(f)} as double) as {qi(f)}" for f in FEATURES)
_FEATS = ", ".join(qi(f) for f in FEATURES)
LONG_SQL = (f"lng as (unpivot (select {qi(ENTITY)} as entity, time_window, {_CASTS} from fw) "
            f"on {_FEATS} into name feature value value)")
PROF_SQL = ("prof as (select entity, feature, avg(value) as \"mean\", stddev_samp(value) as \"std\", "
            "min(value) as \"min\", max(value) as \"max\", quantile_cont(value, 0.5) as median, "
            "quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from lng group by all)")
GLOB_SQL = ("gprof as (select feature, avg(value) as \"mean\", stddev_samp(value) as \"std\", "
            "min(value) as \"min\", max(value) as \"max\", quantile_cont(value, 0.5) as median, "
            "quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from lng group by all)")
PLONG_SQL = ("plong as (unpivot prof on \"mean\", \"std\", \"min\", \"max\", median, q1, q3 "
             "into name stat value value)")
Z_SQL = ("z as (select p.entity, p.feature, p.stat, p.value, abs((p.value - g.\"mean\") / g.\"std\") as z "
         "from plong p join gprof g on p.feature = g.feature where g.\"std\" >= 1e-10 and p.value is not null)")


def with_sql(*ctes, seconds=DAY):
    return "with " + ",\n".join([_fw_sql(seconds), *ctes]) + "\n"


def _report_sql(t):
    return ("rep as (select entity, avg(z) as anomaly_score, "
            f"cast(count(*) filter (where z > {t}) as integer) as num_anomalous_features, "
            "cast(count(*) as integer) as total_features from z group by entity "
            f"having count(*) filter (where z > {t}) >= 1)")


_FW_OUT = ", ".join([qi(ENTITY), ts_sql("time_window") + " as time_window"] +
                    [(r6(qi(f)) if f.split("_")[-1] in ("mean", "std", "min", "max", "sum") else qi(f))
                     + f" as {qi(f)}" for f in FEATURES])
_STATS_OUT = ", ".join(f"{r6(qi(s))} as {qi(s)}" for s in ["mean", "std", "min", "max", "median", "q1", "q3"])


# ---- F ------------------------------------------------------------------------------

@register("f1_tumbling_window_300s", f"""
select flow_id, {ts_sql(floor_sql(qi('Timestamp'), 300))} as time_window
from ({EVENT_FLOWS_SQL})""")
def f1_tumbling_window(spark, sf_dir):
    ef = event_flows(spark, sf_dir)
    return derive.add_time_window(ef, "Timestamp", 300).select("flow_id", "time_window")


@register("f3_entity_window_features", with_sql() + f"select {_FW_OUT} from fw")
def f3_entity_window_features(spark, sf_dir):
    return features(spark, sf_dir)


@register("f3_entity_window_features_300s", with_sql(seconds=300) + f"select {_FW_OUT} from fw")
def f3_entity_window_features_300s(spark, sf_dir):
    return features(spark, sf_dir, 300)


@register("f5_entity_profiles", with_sql(LONG_SQL, PROF_SQL) + f"select entity, feature, {_STATS_OUT} from prof")
def f5_entity_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@register("f6_global_profile", with_sql(LONG_SQL, GLOB_SQL) + f"select feature, {_STATS_OUT} from gprof")
def f6_global_profile(spark, sf_dir):
    return profile.global_profile(windows(spark, sf_dir), ENTITY)


@register("f7_windows_per_entity", with_sql() +
          f"select {qi(ENTITY)} as entity, count(*) as num_time_windows from fw group by 1")
def f7_windows_per_entity(spark, sf_dir):
    return profile.windows_per_entity(features(spark, sf_dir), ENTITY)


@register("f12_distinct_entities", with_sql() +
          f"select count(distinct {qi(ENTITY)}) as n_entities, {len(FEATURES)} as n_features from fw")
def f12_distinct_entities(spark, sf_dir):
    return profile.distinct_entities(features(spark, sf_dir), ENTITY)


@register("f13_population_statistics", with_sql(LONG_SQL, PROF_SQL, PLONG_SQL) +
          "select feature, stat, " + ", ".join(
              f"{r6(f'{fn}(value)')} as {qi(a)}" for fn, a in
              [("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")]) +
          " from plong where value is not null group by feature, stat")
def f13_population_statistics(spark, sf_dir):
    return profile.population_statistics(profiles(spark, sf_dir))


# ---- J / G4 -------------------------------------------------------------------------

_Z_CTES = (LONG_SQL, PROF_SQL, GLOB_SQL, PLONG_SQL, Z_SQL)


@register("j1_z_scores", with_sql(*_Z_CTES) +
          f"select entity, feature, stat, {r6('value')} as value, {r6('z')} as z from z")
def j1_z_scores(spark, sf_dir):
    """J1 + G4: each statistic against the population of its feature."""
    return zscores(spark, sf_dir)


@register("j2_anomalous_entities", with_sql(*_Z_CTES, _report_sql(2.0)) +
          f"select entity, {r6('anomaly_score')} as anomaly_score, num_anomalous_features, total_features from rep")
def j2_anomalous_entities(spark, sf_dir):
    return profile.anomalous_entities(zscores(spark, sf_dir), 2.0)


@register("j2_anomalous_entities_strict", with_sql(*_Z_CTES, _report_sql(STRICT)) +
          f"select entity, {r6('anomaly_score')} as anomaly_score, num_anomalous_features, total_features from rep")
def j2_anomalous_entities_strict(spark, sf_dir):
    return profile.anomalous_entities(zscores(spark, sf_dir), STRICT)


@register("j3_explanations", with_sql(*_Z_CTES) +
          f"select entity, feature || '_' || stat as feature_stat, {r6('z')} as z from z where z > {STRICT}")
def j3_explanations(spark, sf_dir):
    return profile.explanations(zscores(spark, sf_dir), STRICT)


@register("j4_anomaly_report", with_sql(*_Z_CTES, _report_sql(STRICT)) +
          f"select entity, {r6('anomaly_score')} as anomaly_score, num_anomalous_features, total_features "
          "from rep order by anomaly_score desc nulls last, entity")
def j4_anomaly_report(spark, sf_dir):
    """J4 + H2: the ranked four-column report."""
    return profile.anomaly_report(zscores(spark, sf_dir), STRICT)


# ---- H ------------------------------------------------------------------------------

_TOP_SQL = "top as (select entity from rep order by anomaly_score desc nulls last, entity limit {n})"


@register("h3_top_entities", with_sql(*_Z_CTES, _report_sql(STRICT)) +
          f"select entity, {r6('anomaly_score')} as anomaly_score, num_anomalous_features, total_features "
          "from rep order by anomaly_score desc nulls last, entity limit 10")
def h3_top_entities(spark, sf_dir):
    return profile.top_n(profile.anomalous_entities(zscores(spark, sf_dir), STRICT), 10, "anomaly_score")


@register("h5_most_anomalous_series", with_sql(*_Z_CTES, _report_sql(STRICT), _TOP_SQL.format(n=1)) +
          f"select {_FW_OUT} from fw where {qi(ENTITY)} in (select entity from top)")
def h5_most_anomalous_series(spark, sf_dir):
    fw = windows(spark, sf_dir)
    z = zscores(spark, sf_dir, fw)
    return profile.most_anomalous_series(fw, ENTITY, profile.anomalous_entities(z, STRICT))


def _top_entities(spark, sf_dir, n, fw):
    return profile.top_n(profile.anomalous_entities(zscores(spark, sf_dir, fw), STRICT), n, "anomaly_score")


@register("h6_entity_over_time", with_sql(*_Z_CTES, _report_sql(STRICT), _TOP_SQL.format(n=1)) +
          f"select {_FW_OUT} from fw where {qi(ENTITY)} = (select entity from top)")
def h6_entity_over_time(spark, sf_dir):
    """H6 + B14: the windows of one entity in time order (entity = top scorer)."""
    fw = windows(spark, sf_dir)
    top = _top_entities(spark, sf_dir, 1, fw).first()["entity"]
    return profile.entity_over_time(fw, ENTITY, top)


@register("h7_entities_side_by_side", with_sql(LONG_SQL, *_Z_CTES[1:], _report_sql(STRICT), _TOP_SQL.format(n=3)) +
          f"select entity, {ts_sql('time_window')} as time_window, feature, {r6('value')} as value "
          f"from (unpivot (select {qi(ENTITY)} as entity, time_window, "
          + ", ".join(f"cast({qi(f)} as double) as {qi(f)}" for f in FEATURES[:5]) +
          " from fw where " + qi(ENTITY) + " in (select entity from top)) on "
          + ", ".join(qi(f) for f in FEATURES[:5]) + " into name feature value value)")
def h7_entities_side_by_side(spark, sf_dir):
    """H7 + B15: first five features of the three top scorers (semi join on a DataFrame)."""
    fw = windows(spark, sf_dir)
    top = _top_entities(spark, sf_dir, 3, fw).select("entity")
    return profile.entities_side_by_side(fw, ENTITY, top, 5)


@register("f11_compare_entities", with_sql(LONG_SQL, *_Z_CTES[1:], _report_sql(STRICT), _TOP_SQL.format(n=3)) +
          "select entity, feature, " + ", ".join(
              f"{r6(f'{fn}(value)')} as {qi(a)}" for fn, a in
              [("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")]) +
          " from lng where entity in (select entity from top) group by entity, feature")
def f11_compare_entities(spark, sf_dir):
    fw = windows(spark, sf_dir)
    top = _top_entities(spark, sf_dir, 3, fw).select("entity")
    return profile.compare_entities(fw, ENTITY, top)


@register("g3_entity_flag", with_sql(*_Z_CTES, _report_sql(STRICT)) +
          f"select flow_id, ({qi(ENTITY)} in (select entity from rep)) as entity_anomalous from ef")
def g3_entity_flag(spark, sf_dir):
    rep = profile.anomalous_entities(zscores(spark, sf_dir), STRICT)
    return profile.entity_flag(event_flows(spark, sf_dir), ENTITY, rep).select("flow_id", "entity_anomalous")


@register("b15_flagged_entity_rows", with_sql(*_Z_CTES, _report_sql(STRICT)) +
          f"select {_FW_OUT} from fw where {qi(ENTITY)} in (select entity from rep)")
def b15_flagged_entity_rows(spark, sf_dir):
    fw = windows(spark, sf_dir)
    rep = profile.anomalous_entities(zscores(spark, sf_dir, fw), STRICT)
    return profile.filter_entities(fw, ENTITY, materialize(rep.select("entity"), "entities"))


# ---- K: clustering of entities --------------------------------------------------------

_PCOLS = [f"{f}_{s}" for f in FEATURES for s in profile.STATS] + ["num_time_windows"]


def wide(spark, sf_dir):
    fw = windows(spark, sf_dir)
    return profile.wide_profiles(profile.entity_profiles(fw, ENTITY), profile.windows_per_entity(fw, ENTITY),
                                 FEATURES)


_WIDE_SQL = ("wd as (select p.entity, " + ", ".join(
    f"max(case when p.feature = '{f}' then p.\"{s}\" end) as {qi(f + '_' + s)}"
    for f in FEATURES for s in profile.STATS) +
    f", (select count(*) from fw where fw.{qi(ENTITY)} = p.entity) as num_time_windows from prof p group by p.entity)")
_K1_OUT = ", ".join(
    f"{r6(f'(coalesce({qi(c)}, 0) - avg(coalesce({qi(c)}, 0)) over ()) / coalesce(nullif(stddev_pop(coalesce({qi(c)}, 0)) over (), 0), 1)')} as {qi(c)}"
    for c in _PCOLS)


@register("k1_profile_matrix", with_sql(LONG_SQL, PROF_SQL, _WIDE_SQL) + f"select entity, {_K1_OUT} from wd")
def k1_profile_matrix(spark, sf_dir):
    """K1 + B17 + A10 layout: wide profile, missing -> 0, standardised."""
    from tidewatch.operators.cluster import standardized_profiles
    return standardized_profiles(wide(spark, sf_dir))


def _pca(spark, sf_dir):
    from tidewatch.operators.cluster import fit_pca, profile_matrix
    mat, names = profile_matrix(wide(spark, sf_dir))
    fit = fit_pca(mat, len(names))
    return fit, fit.transform(mat).select("entity", "pca"), names


@register("k2_pca_scores")
def k2_pca_scores(spark, sf_dir):
    """K2 (rows only): PCA to min(10, d) components, fixed sign."""
    _, scores, _ = _pca(spark, sf_dir)
    return scores.select("entity", "pca")


@register("k3_kmeans_clusters")
def k3_kmeans_clusters(spark, sf_dir):
    """K3 (rows only): k-means, k = 5, seed 42, on the PCA scores."""
    from tidewatch.operators.cluster import kmeans
    _, scores, _ = _pca(spark, sf_dir)
    return kmeans(scores).select("entity", "cluster")


@register("k5_projection_2d")
def k5_projection_2d(spark, sf_dir):
    """K5 (rows only): first two components with the k-means cluster."""
    from tidewatch.operators.cluster import kmeans, projection_2d
    _, scores, _ = _pca(spark, sf_dir)
    return projection_2d(kmeans(scores))


@register("k6_pca_loadings")
def k6_pca_loadings(spark, sf_dir):
    """K6 (rows only): |loading| of the first ten features on components 1, 2."""
    fit, _, names = _pca(spark, sf_dir)
    return fit.loadings(spark, names, top=10, components=2)


@register("f10_kmeans_cluster_sizes")
def f10_kmeans_cluster_sizes(spark, sf_dir):
    from tidewatch.operators.cluster import cluster_sizes, kmeans
    _, scores, _ = _pca(spark, sf_dir)
    return cluster_sizes(kmeans(scores))
