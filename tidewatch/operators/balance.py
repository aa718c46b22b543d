"""Class balancing (E6-E9): random undersampling and SMOTE.

SMOTE (Chawla et al. 2002): synthetic row j interpolates a minority row and
one of its k nearest minority neighbours, ``x + u * (neighbour - x)``.  The
base row, the neighbour rank and u are hash draws of (seed, j), so the result
is repeatable on any partitioning.  The synthetic ids come from
``spark.range`` (generated in parallel), base rows are found through a
contiguous index of the minority rows, and neighbours through the exact kNN
join; everything is an equi-join, nothing is collected.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.hashing import DEFAULT_SEED, hash_int, hash_unit
from tidewatch.functions.ranking import global_index
from tidewatch.operators.neighbors import knn
from tidewatch.operators.sample import class_counts, undersample
from tidewatch.operators.schema import q


def _new_keys(df: DataFrame, key: str, j):
    """Keys of synthetic rows that no row of ``df`` has."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.NumericType):
        least = df.agg(F.least(F.min(q(key)).cast("long"), F.lit(0))).first()[0] or 0
        return (F.lit(least) - j - 1).cast(kind)
    prefix = "synthetic-"
    while not df.where(F.col(q(key)).startswith(prefix)).isEmpty():
        prefix += "-"
    return F.concat(F.lit(prefix), j.cast("string")).cast(kind)


def smote(df: DataFrame, label: str, key: str, vec: str, ratio: float = 0.5, k: int = 5,
          seed: int = DEFAULT_SEED) -> DataFrame:
    """Add int(n_majority * ratio - n_minority) synthetic minority rows.
    Every numeric or vector column is interpolated between the same two rows
    with the same draw (integral columns are rounded); other columns are the
    base row's.  Synthetic keys are below the smallest key and zero, or, for
    text, begin with a prefix that no key has."""
    counts = class_counts(df, label)
    if len(counts) < 2:
        return df
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], counts[majority]
    n_new = int(n_maj * ratio - n_min)
    if n_new <= 0:
        return df
    if n_min < 2:
        raise ValueError("SMOTE needs at least two minority rows")
    kk = min(k, n_min - 1)
    spark = df.sparkSession
    rest = [f for f in df.schema.fields if f.name not in (key, vec, label)]
    minor = df.where(F.col(q(label)) == F.lit(minority)).select(
        F.col(q(key)).alias("_k"), F.col(q(vec)).alias("_v"), *[F.col(q(f.name)).alias(f"_o{i}") for i, f in enumerate(rest)])
    idx = global_index(minor, ["_k"], "_idx")
    points = minor.select("_k", "_v")
    nn = knn(points, points, "_k", "_v", kk, exclude_self=True) \
        .select(F.col("q_key").alias("_base_k"), F.col("rank").alias("_nb"), F.col("r_key").alias("_nb_k"))
    j = F.col("id")
    syn = spark.range(n_new).select(
        j.alias("_j"),
        F.pmod(hash_int(j, seed, ":b"), F.lit(n_min)).alias("_idx"),
        (F.pmod(hash_int(j, seed, ":n"), F.lit(kk)) + 1).cast("int").alias("_nb"),
        hash_unit(j, seed, ":u").alias("_u"))
    old = [f"_o{i}" for i in range(len(rest))]
    s = syn.join(idx.select("_idx", F.col("_k").alias("_base_k"), F.col("_v").alias("_bv"), *[F.col(o).alias("_b" + o) for o in old]), "_idx")
    s = s.join(nn, ["_base_k", "_nb"])
    s = s.join(minor.select(F.col("_k").alias("_nb_k"), F.col("_v").alias("_nv"), *[F.col(o).alias("_n" + o) for o in old]), "_nb_k")

    def between(a, b):
        return a + F.col("_u") * (b - a)

    def synthetic(o: str, dt):
        a, b = F.col("_b" + o), F.col("_n" + o)
        if isinstance(dt, VectorUDT):
            return array_to_vector(F.zip_with(vector_to_array(a), vector_to_array(b), between))
        if isinstance(dt, T.IntegralType):
            return F.round(between(a.cast("double"), b.cast("double"))).cast(dt)
        return between(a, b).cast(dt) if isinstance(dt, T.NumericType) else a

    made = {f.name: synthetic(o, f.dataType) for f, o in zip(rest, old)}
    new_vec = F.zip_with("_bv", "_nv", between)
    new_key = _new_keys(df, key, F.col("_j"))
    out_cols = []
    for f in df.schema.fields:
        if f.name == key:
            out_cols.append(new_key.alias(key))
        elif f.name == vec:
            out_cols.append(new_vec.cast(f.dataType).alias(vec))
        elif f.name == label:
            out_cols.append(F.lit(minority).cast(f.dataType).alias(label))
        else:
            out_cols.append(made[f.name].alias(f.name))
    return df.unionByName(s.select(*out_cols))


def balance(df: DataFrame, label: str, key: str, vec: str | None = None, method: str = "smote",
            ratio: float = 0.5, k: int = 5, seed: int = DEFAULT_SEED, enabled: bool = True) -> DataFrame:
    """E6 / E7 / E8 by name; ``enabled=False`` passes through."""
    if not enabled:
        return df
    if method == "undersample":
        return undersample(df, label, key, ratio, seed)
    if method == "smote":
        return smote(df, label, key, vec, ratio, k, seed)
    if method == "both":
        return smote(undersample(df, label, key, 0.1, seed), label, key, vec, ratio, k, seed)
    raise ValueError(f"balancing is 'undersample', 'smote' or 'both', not {method!r}")


def balance_train(df: DataFrame, split_col: str = "split", **kw) -> DataFrame:
    """Balance the train split only; other splits pass through."""
    train = df.where(F.col(split_col) == "train")
    rest = df.where(~F.col(split_col).eqNullSafe("train"))
    bal = balance(train.drop(split_col), **kw).withColumn(split_col, F.lit("train"))
    return rest.unionByName(bal.select(*df.columns))
