"""Small column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_as_one(c) -> Column:
    """Denominator guard: a zero divisor is read as one (reference semantics)."""
    c = col(c)
    return F.when(c == 0, F.lit(1)).otherwise(c)


def guarded_ratio(num, den) -> Column:
    return col(num).cast("double") / zero_as_one(den).cast("double")


def nan_to_null(c) -> Column:
    """NaN is a missing value everywhere; infinities are values and stay."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame, columns=None) -> DataFrame:
    """NaN read as NULL in the given float columns (default: all of them)."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
             and (columns is None or f.name in columns)]
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in names}) if names else df


def window_start(ts, seconds: int) -> Column:
    """Floor a timestamp to ``seconds`` from the epoch (tumbling window start).
    Plain arithmetic: a NULL time gives a NULL window and the row stays."""
    micros = F.unix_micros(col(ts).cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(int(seconds) * 1_000_000)))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_time(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


ROUND_NUDGE = 0.00737


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation for result comparison: doubles rounded, timestamps as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 10^d + nudge) / 10^d, written the same way in the SQL oracle:
            # exact decimal ties (means of 2-decimal data) are common, and summation
            # order moves them by an ulp; the nudge keeps both engines on one side.
            scale = float(10 ** digits)
            c = F.round(c.cast("double") * F.lit(scale) + F.lit(ROUND_NUDGE)) / F.lit(scale)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType,
                                                                (T.DoubleType, T.FloatType)):
            scale = float(10 ** digits)
            c = F.transform(c, lambda x: F.round(x.cast("double") * F.lit(scale) + F.lit(ROUND_NUDGE))
                            / F.lit(scale))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)
