"""Checks of scans, sinks, schema handling, derived features and table
descriptions (A, B, C1, F2, F4, F8, F9, G1, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import derive, describe, schema
from tidewatch.plans.registry import floor_sql, qi, r6, register, ts_sql
from tidewatch.session import new_scratch_path
from tidewatch.sources import readers, sinks
from tidewatch.sources.fixtures import (EVENT_FLOWS_SQL, LINEITEM_FLOWS_SQL, event_flows,
                                        lineitem_flows)

WEEK = 604800
EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
EVENTS_OUT_SQL = (f"select event_id, {ts_sql('ts')} as ts, user_id, event_type, {r6('value')} as value, props "
                  "from events")


def std_lineitem(spark, sf_dir):
    return schema.rename_to_standard(lineitem_flows(spark, sf_dir))


# standard-named lineitem flows in SQL
STD_LI_SQL = f"""li as (select l_orderkey, l_linenumber, src_ip as "Source IP", dst_ip as "Destination IP",
  src_port as "Source Port", dst_port as "Destination Port", protocol as "Protocol",
  timestamp as "Timestamp", duration as "Flow Duration", total_fwd_packets as "Total Fwd Packets",
  total_bwd_packets as "Total Backward Packets",
  total_length_of_fwd_packets as "Total Length of Fwd Packets",
  total_length_of_bwd_packets as "Total Length of Bwd Packets", label as "Label"
  from ({LINEITEM_FLOWS_SQL}))"""
STD_COLS = ["l_orderkey", "l_linenumber", "Source IP", "Destination IP", "Source Port", "Destination Port",
            "Protocol", "Timestamp", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
            "Total Length of Fwd Packets", "Total Length of Bwd Packets"]
_DOUBLE_STD = {"Flow Duration", "Total Fwd Packets", "Total Length of Fwd Packets",
               "Total Length of Bwd Packets"}


def _std_out(prefix=""):
    out = []
    for c in STD_COLS:
        e = f"{prefix}{qi(c)}"
        if c == "Timestamp":
            e = ts_sql(e)
        elif c in _DOUBLE_STD:
            e = r6(e)
        out.append(f"{e} as {qi(c)}")
    return ", ".join(out)


_RATIOS_SQL = """
  "Total Length of Fwd Packets" / (case when "Total Fwd Packets" = 0 then 1 else "Total Fwd Packets" end) as fbpp,
  "Total Length of Bwd Packets" / (case when "Total Backward Packets" = 0 then 1 else "Total Backward Packets" end) as bbpp,
  "Total Fwd Packets" / (case when "Total Fwd Packets" + "Total Backward Packets" = 0 then 1
                          else "Total Fwd Packets" + "Total Backward Packets" end) as fpr,
  "Total Backward Packets" / (case when "Total Fwd Packets" + "Total Backward Packets" = 0 then 1
                          else "Total Fwd Packets" + "Total Backward Packets" end) as bpr"""
_RATIO_OUT = (f'{r6("fbpp")} as "Fwd Bytes per Packet", {r6("bbpp")} as "Bwd Bytes per Packet", '
              f'{r6("fpr")} as "Fwd Packet Ratio", {r6("bpr")} as "Bwd Packet Ratio"')


# ---- A ------------------------------------------------------------------------------

@register("a1_csv_round_trip", EVENTS_OUT_SQL)
def a1_csv_round_trip(spark, sf_dir):
    """A1: write the table as CSV to the shared scratch folder, read it back
    with an explicit schema (no inference pass)."""
    path = new_scratch_path(spark, "events-csv") + ".csv"
    sinks.write_table(readers.read_table(spark, sf_dir, "events"), path, "csv")
    return readers.load_flows(spark, path, schema=EVENTS_SCHEMA)


@register("a2_parquet_scan", EVENTS_OUT_SQL)
def a2_parquet_scan(spark, sf_dir):
    return readers.load_flows(spark, f"{sf_dir}/events.parquet")


@register("a5_pruned_scan", f"select l_orderkey, {r6('l_extendedprice')} as l_extendedprice from lineitem")
def a5_pruned_scan(spark, sf_dir):
    """A5: only two columns reach the scan (ReadSchema holds two fields)."""
    return readers.load_flows(spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_extendedprice"])


@register("a7_row_count", "select count(*) as n_rows from lineitem")
def a7_row_count(spark, sf_dir):
    return readers.row_count(readers.read_table(spark, sf_dir, "lineitem"))


@register("a4_flow_dataset_load", f"""with {STD_LI_SQL},
dd as (select "Source IP", count(distinct "Destination IP") as n from li group by 1),
x as (select li.*, case when "Label" = 'Benign' then 1 else 0 end as lab, {_RATIOS_SQL} from li)
select {_std_out('x.')}, lab as "Label", {_RATIO_OUT}, dd.n as "Distinct Destinations Count"
from x left join dd on x."Source IP" = dd."Source IP" """)
def a4_flow_dataset_load(spark, sf_dir):
    """A4: binarise label, rename, parse time, derive."""
    return derive.load_flow_dataset(lineitem_flows(spark, sf_dir), target="label")


@register("a14_dataset_summary", f"""with ef as ({EVENT_FLOWS_SQL})
select sum(count(*)) over () as n_rows, 10 as n_columns, "Label" as class, count(*) as class_count
from ef group by "Label" """)
def a14_dataset_summary(spark, sf_dir):
    return describe.dataset_summary(event_flows(spark, sf_dir), "Label")


# ---- B ------------------------------------------------------------------------------

@register("b1_standard_rename", f"with {STD_LI_SQL} select {_std_out()} from li")
def b1_standard_rename(spark, sf_dir):
    return std_lineitem(spark, sf_dir).select(*[schema.q(c) for c in STD_COLS])


@register("b2_drop_target", f"with {STD_LI_SQL} select {_std_out()} from li")
def b2_drop_target(spark, sf_dir):
    """B2: the feature frame is the table without its target."""
    return schema.drop_columns(std_lineitem(spark, sf_dir), ["Label"])


@register("b6_parse_timestamp", """
select event_id, strftime(try_strptime(case when event_id % 7 = 0 then 'not a time'
       else strftime(ts, '%Y-%m-%d %H:%M:%S') end, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as ts_parsed
from events""")
def b6_parse_timestamp(spark, sf_dir):
    ev = readers.read_table(spark, sf_dir, "events")
    txt = F.when(F.col("event_id") % 7 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = ev.select("event_id", txt.alias("ts_parsed"))
    return schema.parse_timestamp(df, "ts_parsed", "yyyy-MM-dd HH:mm:ss")


@register("b7_text_label", f"""select l_orderkey, l_linenumber,
case when label in ('Normal', 'Benign', 'normal', 'benign') then 1 else 0 end as label
from ({LINEITEM_FLOWS_SQL})""")
def b7_text_label(spark, sf_dir):
    return schema.binarize_label(lineitem_flows(spark, sf_dir), "label").select(
        "l_orderkey", "l_linenumber", "label")


@register("b8_numeric_label", """select l_orderkey, l_linenumber,
case when l_linenumber - 1 = 0 then 1 else 0 end as label from lineitem""")
def b8_numeric_label(spark, sf_dir):
    """Label 0..6 (not binary, has 0, > 2 values) -> 0 is normal."""
    li = readers.read_table(spark, sf_dir, "lineitem")
    df = li.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 1).alias("label"))
    return schema.binarize_label(df, "label")


@register("b9_flow_ratios", f"""with {STD_LI_SQL}, x as (select li.*, {_RATIOS_SQL} from li)
select l_orderkey, l_linenumber, {_RATIO_OUT} from x""")
def b9_flow_ratios(spark, sf_dir):
    """B9 + B10: bytes per packet and packet ratios with zero guards."""
    out = derive.add_flow_ratios(std_lineitem(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "`Fwd Bytes per Packet`", "`Bwd Bytes per Packet`",
                      "`Fwd Packet Ratio`", "`Bwd Packet Ratio`")


@register("b11_derive_if_present", f"""with {STD_LI_SQL}, x as (select li.*, {_RATIOS_SQL} from li)
select l_orderkey, l_linenumber, {r6('fbpp')} as "Fwd Bytes per Packet" from x""")
def b11_derive_if_present(spark, sf_dir):
    """Without the backward packet column only the forward ratio exists."""
    df = std_lineitem(spark, sf_dir).drop("Total Backward Packets")
    out = derive.add_flow_ratios(df)
    derived = [c for c in out.columns if c not in df.columns]
    return out.select("l_orderkey", "l_linenumber", *[schema.q(c) for c in derived])


@register("b12_essential_projection", f"""select label, src_ip, dst_ip, {ts_sql('timestamp')} as timestamp,
protocol, src_port, dst_port, {r6('duration')} as duration, {r6('total_fwd_packets')} as total_fwd_packets,
total_bwd_packets, {r6('total_length_of_fwd_packets')} as total_length_of_fwd_packets,
{r6('total_length_of_bwd_packets')} as total_length_of_bwd_packets from ({LINEITEM_FLOWS_SQL})""")
def b12_essential_projection(spark, sf_dir):
    return schema.essential_projection(lineitem_flows(spark, sf_dir), 30)


@register("b13_label_sign", f"""select flow_id, case when "Label" = 0 then -1 else 1 end as y_sign
from ({EVENT_FLOWS_SQL})""")
def b13_label_sign(spark, sf_dir):
    return schema.label_to_sign(event_flows(spark, sf_dir), "Label").select("flow_id", "y_sign")


# ---- C1 / F8 / F9 -------------------------------------------------------------------

@register("c1_null_counts", f"""with ef as ({EVENT_FLOWS_SQL})
select * from (select 'duration_gap' as "column", count(*) filter (where duration_gap is null) as n_missing from ef
union all select 'protocol_gap', count(*) filter (where protocol_gap is null) from ef) where n_missing > 0""")
def c1_null_counts(spark, sf_dir):
    return describe.null_counts(event_flows(spark, sf_dir))


@register("f8_value_counts", f"""select "Protocol" as value, count(*) as "count" from ({EVENT_FLOWS_SQL})
group by 1 order by 2 desc, 1""")
def f8_value_counts(spark, sf_dir):
    return describe.value_counts(event_flows(spark, sf_dir), "Protocol")


@register("f8_class_distribution", f"""select "Label" as value, count(*) as "count" from ({EVENT_FLOWS_SQL})
group by 1 order by 2 desc, 1""")
def f8_class_distribution(spark, sf_dir):
    return describe.value_counts(event_flows(spark, sf_dir), "Label")


_F9_COLS = ["src_ip", "dst_ip", "src_port", "dst_port", "duration", "total_fwd_packets",
            "total_bwd_packets", "total_length_of_fwd_packets", "total_length_of_bwd_packets"]
_F9_CASTS = ", ".join(f"cast({c} as double) as {c}" for c in _F9_COLS)


@register("f9_summary_statistics", f"""with lng as (unpivot (select {_F9_CASTS} from ({LINEITEM_FLOWS_SQL}))
on {', '.join(_F9_COLS)} into name "column" value value)
select "column", count(value) as "count", {r6('avg(value)')} as "mean", {r6('stddev_samp(value)')} as "std",
{r6('min(value)')} as "min", {r6('quantile_cont(value, 0.25)')} as q1, {r6('quantile_cont(value, 0.5)')} as median,
{r6('quantile_cont(value, 0.75)')} as q3, {r6('max(value)')} as "max" from lng group by 1""")
def f9_summary_statistics(spark, sf_dir):
    """exact quartiles per column (bracketed selection, no column in one task)."""
    return describe.summary(lineitem_flows(spark, sf_dir), _F9_COLS)


# ---- F2 / G1 / F4 / G2 --------------------------------------------------------------

_F2_AGGS = []
for _c, _stats in derive.ROW_WINDOW_AGGS:
    for _s in _stats:
        fn = {"nunique": f"count(distinct {qi(_c)})", "count": f"count({qi(_c)})",
              "mean": f"avg({qi(_c)})", "std": f"stddev_samp({qi(_c)})", "min": f"min({qi(_c)})",
              "max": f"max({qi(_c)})", "sum": f"sum({qi(_c)})"}[_s]
        _F2_AGGS.append((f"{_c}_{_s}", fn))


def _f2_out(name):
    if name.endswith(("_nunique", "_count")) or name == "Total Backward Packets_sum":
        return f"cast(w.{qi(name)} as bigint) as {qi(name)}"
    return f"{r6('w.' + qi(name))} as {qi(name)}"


@register("f2_row_window_features", f"""with {STD_LI_SQL},
lw as (select *, {floor_sql('"Timestamp"', WEEK)} as time_window from li),
w as (select "Source IP", time_window, {', '.join(f'{e} as {qi(n)}' for n, e in _F2_AGGS)} from lw group by 1, 2)
select lw.l_orderkey, lw.l_linenumber, lw."Source IP", {ts_sql('lw.time_window')} as time_window,
{', '.join(_f2_out(n) for n, _ in _F2_AGGS)}
from lw left join w on lw."Source IP" = w."Source IP" and lw.time_window = w.time_window""")
def f2_row_window_features(spark, sf_dir):
    """F2 + G1: per (source, week) aggregates joined back to every flow."""
    out = derive.row_window_features(std_lineitem(spark, sf_dir), "Timestamp", WEEK)
    keep = ["l_orderkey", "l_linenumber", "Source IP", "time_window"] + [n for n, _ in _F2_AGGS]
    return out.select(*[schema.q(c) for c in keep])


@register("f4_distinct_destinations", f"""with {STD_LI_SQL},
dd as (select "Source IP", count(distinct "Destination IP") as n from li group by 1)
select li.l_orderkey, li.l_linenumber, li."Source IP", dd.n as "Distinct Destinations Count"
from li left join dd on li."Source IP" = dd."Source IP" """)
def f4_distinct_destinations(spark, sf_dir):
    """F4 + G2: distinct destinations of the source on every flow."""
    out = derive.add_distinct_destinations(std_lineitem(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "`Source IP`", "`Distinct Destinations Count`")
