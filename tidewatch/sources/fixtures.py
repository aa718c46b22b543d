"""Views of the driver's tables that stand in for network-flow tables.

``event_flows``   events read as flows, with the standard flow names.
``lineitem_flows`` lineitem read as a raw flow export (raw names, text label).
``vectors``       embeddings as feature vectors, ``label = 0`` is the anomaly.
All are lazy projections: Catalyst prunes and pushes filters to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.readers import read_table


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("flow_id"),
        F.col("user_id").alias("Source IP"),
        k.alias("Destination IP"),
        (k % 6).alias("Destination Port"),
        F.col("event_type").alias("Protocol"),
        F.col("ts").alias("Timestamp"),
        F.col("value").alias("Flow Duration"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.col("value")).alias("duration_gap"),
        F.when(F.col("event_id") % 10 == 3, F.lit(None)).otherwise(F.col("event_type")).alias("protocol_gap"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("Label"),
    )


EVENT_FLOWS_SQL = """
select event_id as flow_id, user_id as "Source IP",
       cast(json_extract_string(props, '$.k') as int) as "Destination IP",
       cast(json_extract_string(props, '$.k') as int) % 6 as "Destination Port",
       event_type as "Protocol", ts as "Timestamp", value as "Flow Duration",
       case when event_id % 10 = 0 then null else value end as duration_gap,
       case when event_id % 10 = 3 then null else event_type end as protocol_gap,
       case when event_type = 'error' then 0 else 1 end as "Label"
from events
"""


def lineitem_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.col("l_suppkey").alias("src_ip"),
        F.col("l_partkey").alias("dst_ip"),
        (F.col("l_orderkey") % 65536).alias("src_port"),
        F.col("l_linenumber").alias("dst_port"),
        F.col("l_returnflag").alias("protocol"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("duration"),
        F.col("l_quantity").alias("total_fwd_packets"),
        (F.col("l_linenumber") - 1).alias("total_bwd_packets"),
        F.col("l_extendedprice").alias("total_length_of_fwd_packets"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("total_length_of_bwd_packets"),
        F.when(F.col("l_linestatus") == "O", "Benign").otherwise("Attack").alias("label"),
    )


LINEITEM_FLOWS_SQL = """
select l_orderkey, l_linenumber, l_suppkey as src_ip, l_partkey as dst_ip,
       l_orderkey % 65536 as src_port, l_linenumber as dst_port,
       l_returnflag as protocol, l_shipdate as timestamp,
       l_extendedprice as duration, l_quantity as total_fwd_packets,
       l_linenumber - 1 as total_bwd_packets,
       l_extendedprice as total_length_of_fwd_packets,
       l_extendedprice * l_discount as total_length_of_bwd_packets,
       case when l_linestatus = 'O' then 'Benign' else 'Attack' end as label
from lineitem
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("label") == 0, 0).otherwise(1).alias("label"),
        F.col("label").alias("digit"),
    )


VECTORS_SQL = """
select vec_id, cast(embedding as double[]) as features,
       case when label = 0 then 0 else 1 end as label, label as digit
from embeddings
"""
