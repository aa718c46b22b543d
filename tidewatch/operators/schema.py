"""Column roles, renaming, label and time parsing.

Roles come from the schema and from column names; both are driver-side walks
of ``df.schema`` and touch no data.  Only the numeric-label test (B8) runs one
small aggregate.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.exprs import is_numeric, is_time

# Fixed values that must equal the reference: raw flow-export name -> standard name.
STANDARD_NAMES = {
    "src_ip": "Source IP",
    "dst_ip": "Destination IP",
    "src_port": "Source Port",
    "dst_port": "Destination Port",
    "protocol": "Protocol",
    "timestamp": "Timestamp",
    "duration": "Flow Duration",
    "total_fwd_packets": "Total Fwd Packets",
    "total_bwd_packets": "Total Backward Packets",
    "total_length_of_fwd_packets": "Total Length of Fwd Packets",
    "total_length_of_bwd_packets": "Total Length of Bwd Packets",
    "fwd_packet_length_max": "Fwd Packet Length Max",
    "fwd_packet_length_min": "Fwd Packet Length Min",
    "fwd_packet_length_mean": "Fwd Packet Length Mean",
    "bwd_packet_length_max": "Bwd Packet Length Max",
    "bwd_packet_length_min": "Bwd Packet Length Min",
    "bwd_packet_length_mean": "Bwd Packet Length Mean",
    "flow_bytes_per_s": "Flow Bytes/s",
    "flow_packets_per_s": "Flow Packets/s",
    "label": "Label",
}

# Text labels read as normal traffic.
NORMAL_LABELS = ["Normal", "Benign", "normal", "benign"]

# Name fragments used to pick columns.
TARGET_HINTS = ["label", "class", "target"]
FEATURE_HINTS = ["flow", "packet", "byte", "port", "protocol"]
ESSENTIAL_RAW = ["label", "src_ip", "dst_ip", "timestamp", "protocol"]
ESSENTIAL_MAPPED = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp",
                    "duration", "total_fwd_packets", "total_bwd_packets",
                    "total_length_of_fwd_packets", "total_length_of_bwd_packets", "label"]
ESSENTIAL_EXTRA_HINTS = ["byte", "packet", "flow", "port"]


def q(name: str) -> str:
    """Backtick-quote a column name (names hold spaces and '/')."""
    return "`" + name.replace("`", "``") + "`"


def rename_to_standard(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """B1: rename raw names to standard names; only names present are renamed."""
    mapping = mapping or STANDARD_NAMES
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def drop_columns(df: DataFrame, columns) -> DataFrame:
    """B2."""
    return df.drop(*[c for c in columns if c in df.columns])


def column_roles(df: DataFrame, target: str | None = None,
                 exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numerical (every numeric width) and categorical (string, boolean)
    columns, target and ``exclude`` left out; time columns are in neither."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name == target or f.name in exclude:
            continue
        if isinstance(f.dataType, T.BooleanType) or isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif is_numeric(f.dataType):
            num.append(f.name)
    return num, cat


def _tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[\s_/\-.]+", name.lower()) if t]


def name_roles(columns, match: str = "token") -> dict[str, list[str]]:
    """Ip, time and flow-feature columns by name.

    ``match='substring'`` is the letter of the reference (so 'description'
    counts as an ip column); the default matches whole name parts.
    """
    def has(name, frag):
        if match == "substring":
            return frag in name.lower()
        toks = _tokens(name)
        return any(t == frag or t.startswith(frag) for t in toks)

    cols = list(columns)
    return {
        "ip": [c for c in cols if has(c, "ip")],
        "time": [c for c in cols if has(c, "time")],
        "feature": [c for c in cols if any(has(c, k) for k in FEATURE_HINTS)],
    }


def find_target(columns, target: str) -> str | None:
    """The target if present, else the first column naming a label/class/target."""
    cols = list(columns)
    if target in cols:
        return target
    for c in cols:
        if any(h in c.lower() for h in TARGET_HINTS):
            return c
    return None


def find_time_column(df: DataFrame) -> str | None:
    """Time column: a timestamp-typed column first, else the first name holding 'time'."""
    for f in df.schema.fields:
        if is_time(f.dataType):
            return f.name
    for c in df.columns:
        if "time" in c.lower():
            return c
    return None


def parse_timestamp(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Parse a string time column; unparsable values become NULL."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    c = F.col(q(column))
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(column, parsed)


def binarize_label(df: DataFrame, target: str, normal_values=None) -> DataFrame:
    """1 = normal, 0 = anomaly.

    Text labels: the normal names map to 1, anything else (NULL too) to 0.
    Numeric labels are mapped only when not already within {0, 1}, 0 occurs and
    there are more than two distinct values: then 0 -> 1, others -> 0.
    """
    if target not in df.columns:
        return df
    c = F.col(q(target))
    dt = df.schema[target].dataType
    if isinstance(dt, T.StringType):
        normals = list(normal_values or NORMAL_LABELS)
        return df.withColumn(target, F.when(c.isin(normals), 1).otherwise(0))
    if is_numeric(dt):
        if normal_values is not None:
            return df.withColumn(target, F.when(c.isin(list(normal_values)), 1).otherwise(0))
        st = df.agg(
            F.count_if(~c.isin(0, 1) | c.isNull()).alias("outside"),
            F.count_if(c == 0).alias("zeros"),
            F.count_distinct(c).alias("nd"),
        ).first()
        if st["outside"] > 0 and st["zeros"] > 0 and st["nd"] > 2:
            return df.withColumn(target, F.when(c == 0, 1).otherwise(0))
    return df


def label_to_sign(df: DataFrame, label: str = "Label", out: str = "y_sign") -> DataFrame:
    """0/1 label -> -1/1 (anomaly = -1)."""
    return df.withColumn(out, F.when(F.col(q(label)) == 0, -1).otherwise(1))


def essential_columns(columns, limit: int | None = None) -> list[str]:
    """Core raw names present, then mapped raw names present, then other
    byte/packet/flow/port columns (until ``limit`` columns, if given, are chosen)."""
    cols = list(columns)
    chosen: list[str] = []
    for c in ESSENTIAL_RAW + ESSENTIAL_MAPPED:
        if c in cols and c not in chosen:
            chosen.append(c)
    for c in cols:
        if limit is not None and len(chosen) >= limit:
            break
        if c not in chosen and any(h in c.lower() for h in ESSENTIAL_EXTRA_HINTS):
            chosen.append(c)
    return chosen


def essential_projection(df: DataFrame, limit: int | None = None) -> DataFrame:
    return df.select(*[q(c) for c in essential_columns(df.columns, limit)])
