"""Preprocessing composition (Q1) and transform of new rows (Q2).

Order: roles (B3) -> stratified split (E5) -> fit imputation, encoder and
scaler on the train split (R12; ``fit_on='all'`` reproduces the reference's
fit-before-split) -> apply to every split -> balance the train split only
(E9).  The fitted state (fill row, encoder table, scaler row) is kept in a
``FittedPreprocessor`` and reused for new rows without refitting.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import balance as B
from tidewatch.operators import preprocess as P
from tidewatch.operators.sample import stratified_split
from tidewatch.operators.schema import column_roles, q
from tidewatch.session import materialize


@dataclass
class FittedPreprocessor:
    target: str
    key: str
    numeric: list
    categorical: list
    fill: P.FillValues
    encoder: P.Encoder
    scaler: P.Scaler
    feature_columns: list = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        """Q2: fill, encode, scale with the stored state."""
        out = self.fill.apply(df)
        out = self.encoder.apply(out)
        return self.scaler.apply(out)

    def assemble(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Feature columns as one array<double> column (for the detectors);
        sparse one-hot vectors are written out at their place."""
        cols = [c for c in df.columns if c in self.feature_columns]
        parts = [vector_to_array(F.col(q(c))) if isinstance(df.schema[c].dataType, VectorUDT)
                 else F.array(F.col(q(c)).cast("double")) for c in cols]
        return df.withColumn(out, F.concat(*parts))


def preprocess(df: DataFrame, target: str, key: str, encoding: str = "onehot",
               scaling: str | None = "standard", balance_method: str | None = "smote",
               ratio: float = 0.5, exclude=(), fit_on: str = "train",
               seed: int = 42, sparse: bool = True) -> tuple[DataFrame, FittedPreprocessor]:
    """Q1: returns the preprocessed rows with a ``split`` column and the fit.
    One-hot columns are sparse vectors; ``sparse=False`` gives a column per value."""
    numeric, categorical = column_roles(df, target, exclude=(key, *exclude))
    keep = [key, target, *numeric, *categorical]
    base = df.select(*[q(c) for c in keep])
    split = materialize(stratified_split(base, target, key, seed=seed), "split")  # every fit and apply reads it
    fit_rows = split.where(F.col("split") == "train") if fit_on == "train" else split
    fill = P.fit_fill_values(fit_rows, numeric, categorical)
    filled_fit = fill.apply(fit_rows)
    enc = P.fit_encoder(filled_fit, categorical, encoding, target=target, sparse=sparse)
    scaler = P.fit_scaler(enc.apply(filled_fit), numeric, scaling)
    fitted = FittedPreprocessor(target, key, numeric, categorical, fill, enc, scaler)
    out = fitted.transform(split)
    fitted.feature_columns = [c for c in out.columns if c not in (key, target, "split")]
    if balance_method:
        if balance_method in ("smote", "both"):
            out = fitted.assemble(out)
        out = B.balance_train(out, label=target, key=key, vec="features" if "features" in out.columns else None,
                              method=balance_method, ratio=ratio, seed=seed)
    return out, fitted
