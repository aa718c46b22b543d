"""Missing values, categorical encoders and scalers.

Each fit is one aggregation job whose result is bounded by the schema (one
value per column) or by a column's cardinality (encoder tables); applying a
fit is a projection (constants folded into the plan) or a join against the
fit table.  Fitted state can be reused on new rows (C4, D5, D8).

Scale notes
* Medians take a few wide aggregates over all columns (sketch, count, rank the
  few values around the middle).
* The mode is ``groupBy(column, value).count()`` then ``min(struct(-count,
  value))`` per column: partial aggregation, ties to the smallest value.
* Dense one-hot names a column per value, so the distinct values reach the
  driver; above ``max_categories`` it refuses.  ``sparse=True`` keeps one sparse
  vector per column (Spark ML indexer + encoder) and has no such limit; the
  preprocessing composition uses it unless told otherwise.
* Ordinal codes are contiguous ranks of the distinct values computed with a
  range-partitioned global index, not a single-partition window; code tables
  grow with cardinality, so they are joined (AQE broadcasts small ones).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.exprs import nan_to_null, without_nan
from tidewatch.functions.wide_quantiles import column_quantiles
from tidewatch.functions.ranking import global_index
from tidewatch.operators.schema import q

ENCODINGS = ("onehot", "label", "target", "binary")
SCALINGS = ("standard", "minmax")


# ---- C: missing values ----------------------------------------------------------------

@dataclass
class FillValues:
    numeric: dict = field(default_factory=dict)
    categorical: dict = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """C4: fill with the stored values (no refit on new data)."""
        fills = {}
        for c, v in {**self.numeric, **self.categorical}.items():
            if c not in df.columns or v is None:
                continue
            if c in self.numeric:  # a median need not fit an integer column: the column widens to double
                fills[c] = F.coalesce(nan_to_null(F.col(q(c)).cast("double")), F.lit(float(v)))
            else:
                fills[c] = F.coalesce(F.col(q(c)), F.lit(v).cast(df.schema[c].dataType))
        return df.withColumns(fills) if fills else df


def fit_fill_values(df: DataFrame, numeric, categorical) -> FillValues:
    """C2 (median of numeric columns) and C3 (most frequent value, ties to the
    smallest) in a few jobs whatever the number of columns."""
    out = FillValues()
    numeric, categorical = list(numeric), list(categorical)
    if numeric:
        out.numeric = {c: s.quantiles[0] for c, s in column_quantiles(df, numeric, [0.5]).items()}
    if categorical:
        long = df.select(*[F.col(q(c)).cast("string").alias(c) for c in categorical]) \
            .unpivot([], categorical, "column", "value").where(F.col("value").isNotNull())
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("b"))
        got = {r["column"]: r["b"]["value"] for r in best.collect()}
        out.categorical = {c: got.get(c) for c in categorical}
    return out


def missing_columns(df: DataFrame, columns) -> list[str]:
    """Columns (of ``columns``) holding at least one NULL or NaN, in one pass."""
    cols = list(columns)
    if not cols:
        return []
    df = without_nan(df.select(*[q(c) for c in cols]))
    row = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] > 0]


def impute(df: DataFrame, numeric, categorical, only_missing: bool = True):
    """C2 + C3: fit on ``df`` and fill; returns (filled frame, FillValues)."""
    if only_missing:
        miss = set(missing_columns(df, list(numeric) + list(categorical)))
        numeric = [c for c in numeric if c in miss]
        categorical = [c for c in categorical if c in miss]
    fv = fit_fill_values(df, numeric, categorical)
    return fv.apply(df), fv


# ---- D: encoders -------------------------------------------------------------------------

@dataclass
class Encoder:
    method: str
    columns: list
    values: dict = field(default_factory=dict)      # onehot: column -> sorted values
    codes: DataFrame | None = None                   # label/binary: (column, value, code)
    n_codes: dict = field(default_factory=dict)      # binary: column -> number of values
    target: DataFrame | None = None                  # target: (column, value, enc)
    prior: float | None = None
    sparse_model: object | None = None               # onehot, sparse form: fitted Spark ML pipeline

    def apply(self, df: DataFrame) -> DataFrame:
        """Apply to any frame with the same columns."""
        if not self.columns:
            return df
        if self.method == "onehot" and self.sparse_model is not None:
            out = self.sparse_model.transform(df)
            return out.drop(*self.columns, *[f"_{c}_idx" for c in self.columns])
        if self.method == "onehot":
            return _apply_onehot(df, self.columns, self.values)
        if self.method == "label":
            return _apply_codes(df, self.columns, self.codes, binary=None)
        if self.method == "binary":
            return _apply_codes(df, self.columns, self.codes, binary=self.n_codes)
        if self.method == "target":
            return _apply_target(df, self.columns, self.target, self.prior)
        raise ValueError(f"Unsupported encoding method: {self.method}")


def _value_name(v) -> str:
    if isinstance(v, float) and v.is_integer():
        return str(v)
    return str(v)


def _apply_onehot(df, columns, values):
    keep = [q(c) for c in df.columns if c not in columns]
    new = []
    for c in columns:
        for v in values[c]:
            new.append(F.when(F.col(q(c)) == F.lit(v), 1.0).otherwise(0.0).alias(f"{c}_{_value_name(v)}"))
    return df.select(*keep, *new)


def _apply_codes(df, columns, codes, binary):
    out = df
    for c in columns:
        t = codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        out = out.join(t, F.col(q(c)).cast("string") == F.col("_v"), "left")
        code = F.coalesce(F.col("_code"), F.lit(-1))
        if binary is None:
            out = out.withColumn(c, code.cast("long")).drop("_v", "_code")
        else:
            digits = max(1, int(binary[c]).bit_length())
            # unseen values (code -1) get all-zero digits
            bits = [F.when(code < 0, F.lit(0)).otherwise(F.shiftright(code, digits - 1 - i).bitwiseAND(1))
                    .cast("long").alias(f"{c}_{i}") for i in range(digits)]
            others = [F.col(q(x)) for x in out.columns if x not in (c, "_v", "_code")]
            out = out.select(*others, *bits)
    return out


def _apply_target(df, columns, table, prior):
    out = df
    for c in columns:
        t = table.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("enc").alias("_enc"))
        out = out.join(t, F.col(q(c)).cast("string") == F.col("_v"), "left")
        out = out.withColumn(c, F.coalesce(F.col("_enc"), F.lit(prior))).drop("_v", "_enc")
    return out


def _fit_sparse_onehot(df: DataFrame, cols: list[str]):
    """One-hot as a sparse vector per column (``<col>_vec``) for high
    cardinality: categories in sorted order, unseen values -> all zeros
    (the indexer's extra slot for unseen values is the dropped last one)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}_idx", stringOrderType="alphabetAsc",
                            handleInvalid="keep") for c in cols]
    stages.append(OneHotEncoder(inputCols=[f"_{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols],
                                dropLast=True))
    return Pipeline(stages=stages).fit(df)


def fit_encoder(df: DataFrame, columns, method: str = "onehot", target: str | None = None,
                max_categories: int = 1000, min_samples_leaf: int = 20,
                smoothing: float = 10.0, sparse: bool = False) -> Encoder:
    """D1-D4 fit (D9: unknown method raises).  ``sparse=True`` (one-hot) keeps
    one sparse vector column per categorical column, with no category cap."""
    if method not in ENCODINGS:
        raise ValueError(f"Unsupported encoding method: {method}")
    cols = list(columns)
    enc = Encoder(method, cols)
    if not cols:
        return enc
    if method == "onehot" and sparse:
        enc.sparse_model = _fit_sparse_onehot(df, cols)
        return enc
    long = df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols]) \
        .unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    if method == "onehot":
        card = long.groupBy("column").agg(F.count_distinct("value").alias("n")).collect()
        too_big = [r["column"] for r in card if r["n"] > max_categories]
        if too_big:
            raise ValueError(f"one-hot refused: more than {max_categories} values in {too_big}")
        rows = df.select(*[q(c) for c in cols]).distinct().collect() if len(cols) == 1 else None
        vals = {}
        for c in cols:
            d = rows if rows is not None else df.select(q(c)).distinct().collect()
            vals[c] = sorted(r[0] for r in d if r[0] is not None)
        enc.values = vals
        return enc
    if method in ("label", "binary"):
        distinct = long.distinct()
        idx = global_index(distinct, ["column", "value"], "gidx")
        first = idx.groupBy("column").agg(F.min("gidx").alias("base"))
        enc.codes = idx.join(F.broadcast(first), "column") \
            .select("column", "value", (F.col("gidx") - F.col("base") + 1).alias("code"))
        if method == "binary":
            enc.n_codes = {r["column"]: r["n"] for r in
                           enc.codes.groupBy("column").agg(F.max("code").alias("n")).collect()}
        return enc
    # target encoding (smoothed mean of the target per value)
    if target is None or target not in df.columns:
        raise ValueError("Target column not found in dataframe")
    y = F.col(q(target)).cast("double")
    prior = df.agg(F.avg(y).alias("p")).first()["p"]
    long_y = df.select(y.alias("_y"), *[F.col(q(c)).cast("string").alias(c) for c in cols]) \
        .unpivot(["_y"], cols, "column", "value").where(F.col("value").isNotNull())
    st = long_y.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"))
    w = 1.0 / (1.0 + F.exp(-(F.col("n") - F.lit(min_samples_leaf)) / F.lit(smoothing)))
    enc_val = F.when(F.col("n") == 1, F.lit(prior)).otherwise(F.lit(prior) * (1 - w) + F.col("m") * w)
    enc.target = st.select("column", "value", enc_val.alias("enc"))
    enc.prior = prior
    return enc


# ---- D: scalers -------------------------------------------------------------------------

@dataclass
class Scaler:
    method: str | None
    params: dict = field(default_factory=dict)   # column -> (shift, scale)

    def apply(self, df: DataFrame) -> DataFrame:
        """(x - shift) / scale with the stored row; ``None`` method skips."""
        if not self.method:
            return df
        new = {c: (F.col(q(c)).cast("double") - F.lit(a)) / F.lit(b)
               for c, (a, b) in self.params.items() if c in df.columns}
        return df.withColumns(new) if new else df


def fit_scaler(df: DataFrame, columns, method: str | None = "standard") -> Scaler:
    """D6 (population std, zero std -> 1) / D7 (min-max, constant column -> 0)."""
    if not method:
        return Scaler(None)
    if method not in SCALINGS:
        raise ValueError(f"Unsupported scaling method: {method}")
    cols = list(columns)
    if not cols:
        return Scaler(method)
    aggs = []
    for i, c in enumerate(cols):
        x = nan_to_null(F.col(q(c)).cast("double"))
        if method == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        else:
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    params = {}
    for i, c in enumerate(cols):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if a is None:
            continue
        if method == "standard":
            params[c] = (a, b if b else 1.0)
        else:
            rng = b - a
            params[c] = (a, rng if rng else 1.0)
    return Scaler(method, params)
