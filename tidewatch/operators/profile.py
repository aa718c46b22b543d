"""Entity profiles, population profile, z-score scoring and reports
(F5-F7, F11-F13, G3, G4, J1-J4, H1-H7).

Profiles are kept long: (entity, feature) rows with seven statistics, or
(entity, feature, stat, value) rows.  That keeps every aggregate at seven
expressions whatever the number of features (a wide form with hundreds of
aggregates overflows whole-stage codegen) and makes the population join a
join on ``feature``, whose size is bounded by the schema, so it is broadcast.

Scale notes
* F5 per-entity quantiles use exact ``percentile`` per (entity, feature): its
  memory is the number of windows of one entity, bounded by time span /
  window length, not by data volume.  ``quantiles='sketch'`` uses
  ``percentile_approx`` instead.
* F6 population quantiles would put a whole feature in one task with
  ``percentile``; they come from the wide aggregates of
  ``tidewatch.functions.wide_quantiles`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import nan_to_null
from tidewatch.functions.wide_quantiles import column_quantiles
from tidewatch.session import materialize
from tidewatch.operators.schema import q

STATS = ["mean", "std", "min", "max", "median", "q1", "q3"]
WINDOW_COL = "time_window"


def feature_columns(features: DataFrame, entity_col: str, window_col: str = WINDOW_COL) -> list[str]:
    return [c for c in features.columns if c not in (entity_col, window_col)]


def to_long(features: DataFrame, entity_col: str, window_col: str = WINDOW_COL) -> DataFrame:
    """(entity, window, feature, value) with missing values dropped."""
    cols = feature_columns(features, entity_col, window_col)
    cast = features.select(F.col(q(entity_col)).alias("entity"), F.col(q(window_col)).alias(window_col),
                           *[F.col(q(c)).cast("double").alias(c) for c in cols])
    long = cast.unpivot(["entity", window_col], cols, "feature", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def entity_profiles(features: DataFrame, entity_col: str, window_col: str = WINDOW_COL,
                    quantiles: str = "exact") -> DataFrame:
    """per (entity, feature): mean, std (sample), min, max, median, q1, q3."""
    long = to_long(features, entity_col, window_col)
    if quantiles == "sketch":
        pq = F.percentile_approx("value", [0.25, 0.5, 0.75], 10000)
    else:
        pq = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    prof = long.groupBy("entity", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), pq.alias("_q"))
    return prof.select("entity", "feature", "mean", "std", "min", "max",
                       F.col("_q")[1].cast("double").alias("median"),
                       F.col("_q")[0].cast("double").alias("q1"),
                       F.col("_q")[2].cast("double").alias("q3"))


def windows_per_entity(features: DataFrame, entity_col: str) -> DataFrame:
    """number of windows per entity."""
    return features.groupBy(F.col(q(entity_col)).alias("entity")).agg(
        F.count(F.lit(1)).alias("num_time_windows"))


def global_profile(features: DataFrame, entity_col: str, window_col: str = WINDOW_COL) -> DataFrame:
    """the seven statistics per feature over all (entity, window) rows; a
    feature without values has no row.  ``features`` is read a few times, so it
    should be a written table."""
    cols = feature_columns(features, entity_col, window_col)
    stats = column_quantiles(features, cols, [0.25, 0.5, 0.75], {"mean": F.avg, "std": F.stddev_samp})
    rows = [(c, s.other["mean"], s.other["std"], s.min, s.max, s.quantiles[1], s.quantiles[0], s.quantiles[2]) for c, s in stats.items() if s.count]
    return features.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"{c} double" for c in STATS))


def profile_long(profiles: DataFrame) -> DataFrame:
    """(entity, feature, stat, value) form of a profile table."""
    return profiles.unpivot(["entity", "feature"], STATS, "stat", "value")


def z_scores(profiles: DataFrame, global_prof: DataFrame, min_std: float = 1e-10,
             baseline: str = "window") -> DataFrame:
    """J1 + G4: |stat - global mean| / global std for each of the seven
    statistics; features whose global std is below ``min_std`` are skipped and a
    NULL statistic gives no z (R10).  ``baseline='window'`` compares every
    statistic with the mean and std of the window values;
    ``baseline='statistic'`` with the mean and std of that statistic over all
    entities (R19)."""
    long = profile_long(profiles).where(F.col("value").isNotNull())
    if baseline == "window":
        g, on = global_prof.select("feature", F.col("mean").alias("g_mean"), F.col("std").alias("g_std")), ["feature"]
    elif baseline == "statistic":
        g, on = long.groupBy("feature", "stat").agg(F.avg("value").alias("g_mean"), F.stddev_samp("value").alias("g_std")), ["feature", "stat"]
    else:
        raise ValueError(f"baseline is 'window' or 'statistic', not {baseline!r}")
    g = g.where(F.col("g_std") >= F.lit(min_std))
    z = F.abs((F.col("value") - F.col("g_mean")) / F.col("g_std"))
    # one row per schema column (and statistic)
    return long.join(F.broadcast(g), on).select("entity", "feature", "stat", "value",
                                                       z.alias("z"))


def anomalous_entities(z: DataFrame, threshold: float = 2.0, keep_all: bool = False) -> DataFrame:
    """Per entity the mean z (anomaly_score), the number of statistics with
    z > threshold and the number scored; entities with at least one kept."""
    out = z.groupBy("entity").agg(
        F.avg("z").alias("anomaly_score"),
        F.count_if(F.col("z") > F.lit(threshold)).cast("int").alias("num_anomalous_features"),
        F.count(F.lit(1)).cast("int").alias("total_features"))
    return out if keep_all else out.where(F.col("num_anomalous_features") >= 1)


def explanations(z: DataFrame, threshold: float = 2.0) -> DataFrame:
    """J3 (long form): the statistics above the threshold with their z."""
    return z.where(F.col("z") > F.lit(threshold)).select(
        "entity", F.concat_ws("_", "feature", "stat").alias("feature_stat"), "z")


def explanation_map(z: DataFrame, threshold: float = 2.0) -> DataFrame:
    """``anomalous_features`` as a map feature_stat -> z, one row per entity."""
    ex = explanations(z, threshold)
    return ex.groupBy("entity").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("feature_stat", "z")))).alias("anomalous_features"))


def anomaly_report(z: DataFrame, threshold: float = 2.0, with_explanation: bool = False) -> DataFrame:
    """J4 + H2: entity, anomaly_score, num_anomalous_features, total_features,
    ranked by score (descending, NULLs last, ties by entity)."""
    rep = anomalous_entities(z, threshold)
    if with_explanation:
        rep = rep.join(explanation_map(z, threshold), "entity", "left")
    return rep.orderBy(F.col("anomaly_score").desc_nulls_last(), F.col("entity").asc())


def top_n(df: DataFrame, n: int, by: str, entity: str = "entity") -> DataFrame:
    """H3: top-n rows by a column (TakeOrdered: each task keeps n rows)."""
    return df.orderBy(F.col(q(by)).desc_nulls_last(), F.col(q(entity)).asc()).limit(n)


def population_statistics(profiles: DataFrame) -> DataFrame:
    """mean, std, min, max of every profile statistic across entities."""
    long = profile_long(profiles).where(F.col("value").isNotNull())
    return long.groupBy("feature", "stat").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def filter_entities(features: DataFrame, entity_col: str, entities) -> DataFrame:
    """Rows of the given entities; a DataFrame of entities is used as
    a left-semi join, a Python list as IN.  Raises when nothing matches."""
    if isinstance(entities, DataFrame):
        key = entities.columns[0]
        out = features.join(entities.select(F.col(key).alias(entity_col)).distinct(),
                            on=entity_col, how="left_semi")
    else:
        vals = list(entities) if isinstance(entities, (list, tuple, set)) else [entities]
        out = features.where(F.col(q(entity_col)).isin(vals))
    if out.isEmpty():
        raise ValueError("none of the given entities has a row")
    return out


def compare_entities(features: DataFrame, entity_col: str, entities,
                     window_col: str = WINDOW_COL) -> DataFrame:
    """mean, std, min, max per (entity, feature) for the chosen entities."""
    sub = filter_entities(features, entity_col, entities)
    cols = feature_columns(sub, entity_col, window_col)
    long = sub.select(F.col(q(entity_col)).alias("entity"), F.col(window_col),
                      *[F.col(q(c)).cast("double").alias(c) for c in cols]) \
        .unpivot(["entity", window_col], cols, "feature", "value").withColumn("value", nan_to_null(F.col("value")))
    return long.groupBy("entity", "feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def entity_over_time(features: DataFrame, entity_col: str, entity,
                     window_col: str = WINDOW_COL) -> DataFrame:
    """H6 (+H1): one entity's windows in time order."""
    return filter_entities(features, entity_col, [entity]).orderBy(window_col)


def entities_side_by_side(features: DataFrame, entity_col: str, entities, n_features: int | None = None,
                          window_col: str = WINDOW_COL) -> DataFrame:
    """H7: the features of several entities (the first ``n_features``, if
    given), keyed (feature, window, entity)."""
    sub = filter_entities(features, entity_col, entities)
    cols = feature_columns(sub, entity_col, window_col)[:n_features]
    return sub.select(F.col(q(entity_col)).alias("entity"), F.col(window_col),
                      *[F.col(q(c)).cast("double").alias(c) for c in cols]) \
        .unpivot(["entity", window_col], cols, "feature", "value")


def most_anomalous_series(features: DataFrame, entity_col: str, report: DataFrame,
                          window_col: str = WINDOW_COL) -> DataFrame:
    """H5: windows of the highest-scoring entity (top-1 joined to F3)."""
    top = report.orderBy(F.col("anomaly_score").desc_nulls_last(), F.col("entity").asc()).limit(1)
    return features.join(top.select(F.col("entity").alias(entity_col)), on=entity_col,
                         how="left_semi").orderBy(window_col)


def entity_flag(df: DataFrame, entity_col: str, flagged: DataFrame,
                out: str = "entity_anomalous") -> DataFrame:
    """Does the row's entity belong to the flagged set (left join on the
    distinct flagged entities, NULL-safe)."""
    keys = flagged.select(F.col("entity").alias("_fe")).distinct().withColumn("_hit", F.lit(True))
    j = df.join(keys, F.col(q(entity_col)) == F.col("_fe"), "left")
    return j.withColumn(out, F.coalesce(F.col("_hit"), F.lit(False))).drop("_fe", "_hit")


def wide_profiles(profiles: DataFrame, windows: DataFrame, features: list[str]) -> DataFrame:
    """One wide row per entity: ``<feature>_<stat>`` columns + num_time_windows
    (K1 / A10).  The feature list comes from the schema, so the pivot needs no
    extra job."""
    long = profile_long(profiles).withColumn("name", F.concat_ws("_", "feature", "stat"))
    names = [f"{f}_{s}" for f in features for s in STATS]
    wide = long.groupBy("entity").pivot("name", names).agg(F.first("value"))
    return wide.join(windows, "entity")


def distinct_entities(features: DataFrame, entity_col: str, approx: bool = False) -> DataFrame:
    """distinct entity count and number of feature columns."""
    c = F.col(q(entity_col))
    agg = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    n_feat = len(feature_columns(features, entity_col))
    return features.agg(agg.alias("n_entities")).withColumn("n_features", F.lit(n_feat))


