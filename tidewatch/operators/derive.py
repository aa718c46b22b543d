"""Derived flow features, tumbling windows and window aggregates
(B9-B11, F1-F4, G1, G2, A4).

Scale notes
* F2/F3 group by (entity, window): partial aggregation runs map-side, so a hot
  entity costs one partial row per (entity, window) per input split.  A hot
  entity's windows still spread over many reducers because the window is in
  the key.
* Exact ``count_distinct`` makes Catalyst expand rows once per distinct
  column; ``approx=True`` switches to HyperLogLog (``approx_count_distinct``).
* F2 puts window aggregates on rows in one shuffle: distinct counts come from
  dense ranks within the window, not from rows expanded per distinct column.
* F4/G2 join per-source counts back to the rows.  The count table grows with
  the number of sources, so it is not force-broadcast: AQE broadcasts it at
  run time when it is small and splits skewed sources otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.exprs import guarded_ratio, window_start, without_nan, zero_as_one
from tidewatch.operators.schema import (binarize_label, find_time_column, parse_timestamp, q,
                                        rename_to_standard)
from tidewatch.session import materialize

# Fixed values that must equal the reference: entity-window feature columns.
COUNT_COLUMNS = ["Destination IP", "Destination Port", "Protocol"]
FLOW_COLUMNS = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Flow Bytes/s", "Flow Packets/s",
]
# Per-row behaviour features (column -> aggregates) of the time-window step.
ROW_WINDOW_AGGS = [
    ("Destination IP", ["nunique", "count"]),
    ("Destination Port", ["nunique", "count"]),
    ("Protocol", ["nunique", "count"]),
    ("Flow Duration", ["mean", "std", "min", "max"]),
    ("Total Fwd Packets", ["mean", "sum"]),
    ("Total Backward Packets", ["mean", "sum"]),
    ("Total Length of Fwd Packets", ["mean", "sum"]),
    ("Total Length of Bwd Packets", ["mean", "sum"]),
]
HOT_ROWS = 1_000_000  # rows of a (source, window) that one task takes whole
FLOW_STATS = ["mean", "std", "min", "max", "sum"]
COUNT_STATS = ["nunique", "count"]


def _agg(column: str, stat: str, approx: bool = False):
    c = F.col(q(column))
    if stat == "nunique":
        return F.approx_count_distinct(c) if approx else F.count_distinct(c)
    if stat == "count":
        return F.count(c)
    if stat == "mean":
        return F.avg(c.cast("double"))
    if stat == "std":
        return F.stddev_samp(c.cast("double"))
    if stat == "min":
        return F.min(c)
    if stat == "max":
        return F.max(c)
    if stat == "sum":
        return F.sum(c)
    raise ValueError(f"unknown aggregate {stat}")


def add_flow_ratios(df: DataFrame) -> DataFrame:
    """Bytes per packet and packet ratios, each only when its inputs exist."""
    cols = set(df.columns)
    new = {}
    if {"Total Fwd Packets", "Total Length of Fwd Packets"} <= cols:
        new["Fwd Bytes per Packet"] = guarded_ratio(F.col(q("Total Length of Fwd Packets")),
                                                    F.col(q("Total Fwd Packets")))
    if {"Total Backward Packets", "Total Length of Bwd Packets"} <= cols:
        new["Bwd Bytes per Packet"] = guarded_ratio(F.col(q("Total Length of Bwd Packets")),
                                                    F.col(q("Total Backward Packets")))
    if {"Total Fwd Packets", "Total Backward Packets"} <= cols:
        total = F.col(q("Total Fwd Packets")) + F.col(q("Total Backward Packets"))
        new["Fwd Packet Ratio"] = F.col(q("Total Fwd Packets")).cast("double") / zero_as_one(total).cast("double")
        new["Bwd Packet Ratio"] = F.col(q("Total Backward Packets")).cast("double") / zero_as_one(total).cast("double")
    return df.withColumns(new) if new else df


def add_distinct_destinations(df: DataFrame, source: str = "Source IP",
                              dest: str = "Destination IP", approx: bool = False,
                              out: str = "Distinct Destinations Count") -> DataFrame:
    """F4 + G2: distinct destinations per source put on every row, whatever the
    number of rows (the columns of a result depend on the schema only)."""
    if source not in df.columns or dest not in df.columns:
        return df
    counts = df.groupBy(q(source)).agg(_agg(dest, "nunique", approx).alias(out))
    return df.join(counts, on=source, how="left")


def load_flow_dataset(df: DataFrame, target: str = "label") -> DataFrame:
    """A4: binarise label, rename to standard names, parse time, derive features."""
    df = binarize_label(df, target)
    df = rename_to_standard(df)
    tcol = find_time_column(df)
    if tcol:
        df = parse_timestamp(df, tcol)
    df = add_flow_ratios(df)
    df = add_distinct_destinations(df)
    return df


def add_time_window(df: DataFrame, time_col: str, seconds: int = 300,
                    out: str = "time_window") -> DataFrame:
    """floor the time to ``seconds`` from the epoch; a row without a time
    stays and has no window."""
    return df.withColumn(out, window_start(F.col(q(time_col)), seconds))


def entity_window_features(df: DataFrame, entity_col: str = "Source IP",
                           time_col: str | None = None, window_seconds: int = 300,
                           count_columns=None, flow_columns=None,
                           approx: bool = False) -> DataFrame:
    """one row per (entity, window) with ``<col>_<agg>`` features for the
    columns present.  Rows with a NULL entity or time are left out (the
    reference's group-by drops them)."""
    time_col = time_col or find_time_column(df)
    if time_col is None:
        raise ValueError("No time column found")
    count_columns = COUNT_COLUMNS if count_columns is None else count_columns
    flow_columns = FLOW_COLUMNS if flow_columns is None else flow_columns
    aggs = []
    for c in count_columns:
        if c in df.columns:
            aggs += [_agg(c, s, approx).alias(f"{c}_{s}") for s in COUNT_STATS]
    for c in flow_columns:
        if c in df.columns:
            aggs += [_agg(c, s).alias(f"{c}_{s}") for s in FLOW_STATS]
    if not aggs:
        raise ValueError("the flow table has none of the columns that window features are made from")
    used = [c for c in count_columns + flow_columns if c in df.columns]
    base = without_nan(df.select(F.col(q(entity_col)), F.col(q(time_col)), *[F.col(q(c)) for c in used]))
    base = base.where(F.col(q(entity_col)).isNotNull() & F.col(q(time_col)).isNotNull())
    base = add_time_window(base, time_col, window_seconds)
    return base.groupBy(q(entity_col), "time_window").agg(*aggs)


def row_window_features(df: DataFrame, time_col: str = "Timestamp", window_seconds: int = 300,
                        source: str = "Source IP", approx: bool = False) -> DataFrame:
    """F2 + G1: per (source, window) aggregates of the columns present, on every
    row.  Rows without a source or a time keep their place with NULL features.

    Rows meet once by (source, window) and take the aggregates over it; only
    windows of more than ``HOT_ROWS`` rows are aggregated apart, spread by
    partial aggregation, and joined back."""
    if source not in df.columns:
        return df
    df = without_nan(add_time_window(df, time_col, window_seconds))
    aggs = []
    for c, stats in ROW_WINDOW_AGGS:
        if c in df.columns:
            aggs += [_agg(c, s, approx).alias(f"{c}_{s}") for s in stats]
    if not aggs:
        return df
    by = [source, "time_window"]
    has = F.col(q(source)).isNotNull() & F.col("time_window").isNotNull()
    known = df.where(has)
    order = by + [c for c in df.columns if c not in by]
    rows = known.groupBy(*map(q, by)).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialize(rows.where(F.col("_rows") > HOT_ROWS).drop("_rows"), "hot_windows")
    crowded = not hot.isEmpty()
    out = known.join(F.broadcast(hot), on=by, how="left_anti") if crowded else known
    window = Window.partitionBy(*map(q, by))
    places = {}  # place of a value among the distinct ones of its window
    for c, stats in ROW_WINDOW_AGGS:
        if c in df.columns and "nunique" in stats and not approx:
            places[c] = f"_place_{c}"
            out = out.withColumn(places[c], F.dense_rank().over(window.orderBy(F.col(q(c)).asc_nulls_last())))
    named = []
    for c, stats in ROW_WINDOW_AGGS:
        for stat in stats if c in df.columns else []:
            if stat == "nunique" and c in places:
                most = F.max(F.when(F.col(q(c)).isNotNull(), F.col(q(places[c])))).over(window)
                named.append(F.coalesce(most, F.lit(0)).cast("long").alias(f"{c}_{stat}"))
            else:
                named.append(_agg(c, stat, approx).over(window).alias(f"{c}_{stat}"))
    out = out.select(*map(q, order), *named)
    if crowded:
        loud = known.join(F.broadcast(hot), on=by, how="left_semi")
        feats = loud.groupBy(*map(q, by)).agg(*aggs)
        out = out.unionByName(loud.join(F.broadcast(feats), on=by, how="left"))
    kinds = {f.name: f.dataType for f in out.schema}
    without = df.where(~has).select(*map(q, order), *[F.lit(None).cast(kinds[c]).alias(c) for c in out.columns[len(order):]])
    return out.unionByName(without)
