"""Clustering of entities.

K1 builds the standardised profile matrix (wide profile, missing -> 0,
population std).  K2/K3 use Spark ML (``PCA`` aggregates a d x d covariance,
d bounded by the schema; ``KMeans`` is distributed Lloyd / k-means||).  K4 is
DBSCAN without a table of pairs: the blocks of a metric tree count neighbours
(up to ``min_samples``) -> core points -> each block sends a spanning set of
links among its core points, a few scouts look into all blocks -> connected
components -> core points outside the largest one ask the blocks within reach,
only for links between components -> border points take the smallest
neighbouring cluster -> noise = -1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.components import connected_components
from tidewatch.functions.ranking import global_index
from tidewatch.operators.neighbors import BLOCK, DIGITS, Blocks, Cells, matrix
from tidewatch.operators.preprocess import fit_scaler
from tidewatch.session import materialize

SCOUTS = 16  # points of a block that look for links in all others, about


def standardized_profiles(wide: DataFrame, key: str = "entity") -> DataFrame:
    """K1 (+B17): every profile column, missing -> 0, standardised with the
    population std (zero std -> 1)."""
    cols = [c for c in wide.columns if c != key]
    filled = wide.select(F.col(key), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c)
                                       for c in cols])
    filled = materialize(filled, "profiles")  # scaler, PCA and k-means go over it again
    return fit_scaler(filled, cols, "standard").apply(filled)


def profile_matrix(wide: DataFrame, key: str = "entity") -> tuple[DataFrame, list[str]]:
    """K1 as (key, features array) plus the feature names."""
    cols = [c for c in wide.columns if c != key]
    scaled = standardized_profiles(wide, key)
    mat = scaled.select(key, F.array(*[F.col(f"`{c}`") for c in cols]).alias("features"))
    return materialize(mat, "profile_matrix"), cols  # PCA goes over it a few times


@dataclass
class PCAFit:
    model: object
    k: int

    def transform(self, df: DataFrame, vec: str = "features", out: str = "pca") -> DataFrame:
        v = df.withColumn("_vin", array_to_vector(F.col(vec)))
        r = self.model.transform(v)
        arr = vector_to_array(F.col("_vout"))
        # fixed sign: the largest-magnitude loading of each component is positive
        return r.withColumn(out, F.zip_with(arr, F.array(*[F.lit(s) for s in self.signs]),
                                            lambda a, s: a * s)).drop("_vin", "_vout")

    @property
    def signs(self):
        pc = self.model.pc.toArray()
        return [1.0 if pc[abs(pc[:, i]).argmax(), i] >= 0 else -1.0 for i in range(pc.shape[1])]

    def loadings(self, spark, names: list[str], top: int | None = None, components: int | None = None) -> DataFrame:
        """K6: |weight| of every feature on every component (of the first
        ``top`` features and ``components``, if given)."""
        pc = self.model.pc.toArray()
        top, components = top or len(names), components or pc.shape[1]
        rows = [(names[i], j + 1, float(abs(pc[i, j])))
                for j in range(min(components, pc.shape[1])) for i in range(min(top, len(names)))]
        return spark.createDataFrame(rows, "feature string, component int, weight double")


def fit_pca(df: DataFrame, n_features: int, vec: str = "features", max_components: int = 10) -> PCAFit:
    """K2: PCA to min(10, n_features) components."""
    k = min(max_components, n_features)
    model = PCA(k=k, inputCol="_vin", outputCol="_vout").fit(df.withColumn("_vin", array_to_vector(F.col(vec))))
    return PCAFit(model, k)


def kmeans(df: DataFrame, vec: str = "pca", k: int = 5, seed: int = 42, out: str = "cluster") -> DataFrame:
    """K3: k-means on the PCA scores."""
    # starts and rounds read the written scores: without it, each computes them again
    v = materialize(df, "scores").withColumn("_kin", array_to_vector(F.col(vec)))
    model = KMeans(k=k, seed=seed, featuresCol="_kin", predictionCol=out).fit(v)
    return model.transform(v).drop("_kin")


def projection_2d(df: DataFrame, key: str = "entity", vec: str = "pca") -> DataFrame:
    """K5: first two components of every entity with its cluster."""
    cols = [key, F.col(vec)[0].alias("pc1"), F.col(vec)[1].alias("pc2")]
    if "cluster" in df.columns:
        cols.append("cluster")
    return df.select(*cols)


def cluster_sizes(clustered: DataFrame, col: str = "cluster") -> DataFrame:
    """F10."""
    return clustered.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def _elsewhere(blocks: Blocks, rows: DataFrame, bound) -> DataFrame:
    """``rows`` of some blocks once per other block within ``bound``."""
    rows = rows.withColumnsRenamed({"leaf": "_leaf", "chunk": "_chunk"})
    return blocks.within(rows, bound).where("leaf <> _leaf or chunk <> _chunk").drop("_leaf", "_chunk")


def _components(nodes: DataFrame, edges: DataFrame, name: str, out: str = "comp") -> DataFrame:
    """Component of every one of ``nodes``, those without edges included."""
    joined = connected_components(edges).select(F.col("node").alias(name), F.col("comp").alias("_joined"))
    return materialize(nodes.join(joined, name, "left").select(name, F.coalesce("_joined", name).alias(out)), "components")


def dbscan(df: DataFrame, key: str, vec: str, eps: float = 0.5, min_samples: int = 5,
           out: str = "cluster") -> DataFrame:
    """K4: DBSCAN (Ester et al. 1996): distance <= eps inclusive, a row counts
    itself; cluster ids 0.. ordered by their smallest core key; noise -1."""
    # copies of a point are one counted point
    points = df.groupBy(F.col(vec).alias("vec")).agg(F.min(key).alias("node"), F.count(F.lit(1)).alias("copies"))
    points = materialize(points, "points")
    rows = points.where("vec is not null").select(F.col("node").alias("id"), F.col("vec").cast("array<double>").alias("v"), "copies")
    kind = points.schema["node"].dataType.simpleString()
    blocks = Blocks(rows, BLOCK)
    d, reach = blocks.d, float(eps)

    def degrees(q: pa.Table, r: pa.Table) -> pa.Table:
        deg = np.zeros(q.num_rows, dtype=np.int64)
        if q.num_rows and r.num_rows:
            deg = Cells(matrix(r, d)).counts(matrix(q, d), r.column("copies").to_numpy(), reach, min_samples)
        return pa.table({"node": q.column("id"), "deg": np.minimum(deg, min_samples)})

    def links(q: pa.Table, r: pa.Table) -> pa.Table:
        a = b = q.column("id").combine_chunks().slice(0, 0)
        if q.num_rows and r.num_rows:
            q, group = q.sort_by([("away", "ascending")]), None
            name = "id"
            if "comp" in r.column_names:  # what is joined already needs no links
                name, comps = "comp", r.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
                group = np.unique(comps, return_index=True)[1][comps]
            qs, rs, first, other = Cells(matrix(r, d)).spanning(matrix(q, d), reach, group)
            qid, rid = (x.column(name).combine_chunks() for x in (q, r))
            a = pa.concat_arrays([qid.take(pa.array(qs)), rid.take(pa.array(first))])
            b = pa.concat_arrays([rid.take(pa.array(rs)), rid.take(pa.array(other))])
        return pa.table({"a": a, "b": b})

    def nearest_cluster(q: pa.Table, r: pa.Table) -> pa.Table:
        best = np.full(q.num_rows, -1, dtype=np.int32)
        if q.num_rows and r.num_rows:
            cid = r.column("cid").to_numpy()
            for part in Cells(matrix(r, d)).pairs(matrix(q, d), np.full(q.num_rows, reach)):
                if part is not None:
                    i, j, dist = part
                    ok = np.round(dist, DIGITS) <= reach
                    low = np.full(q.num_rows, np.iinfo(np.int32).max, dtype=np.int32)
                    np.minimum.at(low, i[ok], cid[j[ok]])
                    hit = low < np.iinfo(np.int32).max
                    best[hit] = np.where(best[hit] < 0, low[hit], np.minimum(best[hit], low[hit]))
        return pa.table({"node": q.column("id"), "bid": best})

    near = F.lit(reach)
    # the own block first: where it has neighbours enough, the others are not asked
    many = len(blocks.tree.first) > 1 or bool(blocks.chunks)
    own = blocks.points.select("id", "v", "leaf", "chunk")
    deg = materialize(blocks.solve(own, degrees, f"node {kind}, deg long"), "own_degrees")
    if many:
        few = deg.where(F.col("deg") < min_samples).select(F.col("node").alias("id"))
        rest = _elsewhere(blocks, own.join(few, "id", "left_semi"), near)
        deg = deg.union(blocks.solve(rest, degrees, f"node {kind}, deg long"))
    deg = materialize(deg.groupBy("node").agg(F.sum("deg").alias("deg")), "degrees")
    core = deg.where(F.col("deg") >= min_samples).select("node")
    cores = core.withColumnRenamed("node", "id")
    core_points = materialize(blocks.points.join(cores, "id", "left_semi"), "core_points")
    # links inside the blocks, and of a few scouts with all blocks; what that joins to the
    # largest component asks no more, every other core point asks all blocks within reach
    inside = core_points.select("id", "v", "leaf", "chunk")
    asked = blocks.short(inside.withColumn("away", F.lit(0)))
    if many:
        scouts = inside.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(max(1, BLOCK // SCOUTS))) == 0)
        asked = asked.unionByName(_elsewhere(blocks, scouts, near).withColumn("away", F.lit(1)))
    comp = _components(core, blocks.solve(asked, links, f"a {kind}, b {kind}", core_points), "node")
    if many:
        main = comp.where("comp is not null").groupBy("comp").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "comp").first()
        known = core_points.join(comp.withColumnRenamed("node", "id"), "id")
        left = known.where(F.col("comp") != F.lit(main.comp if main else None)).select("id", "v", "leaf", "chunk", "comp")
        left = materialize(left, "outside_main")
        if not left.isEmpty():
            more = blocks.solve(_elsewhere(blocks, left, near).withColumn("away", F.lit(1)), links, f"a {kind}, b {kind}", known)
            joined = _components(comp.select("comp").distinct(), more, "comp", "main")
            comp = materialize(comp.join(joined, "comp", "left").select("node", F.col("main").alias("comp")), "components")
    ids = global_index(comp.select("comp").distinct(), ["comp"], "cid")
    core_lab = materialize(comp.join(ids, "comp").select(F.col("node"), F.col("cid").cast("int").alias("cid")), "core_labels")
    others = rows.select("id", "v").join(cores, "id", "left_anti")
    labelled = core_points.join(core_lab.withColumnRenamed("node", "id"), "id")
    border = blocks.solve(blocks.within(others, near), nearest_cluster, f"node {kind}, bid int", labelled)
    border = border.where("bid >= 0").groupBy("node").agg(F.min("bid").alias("bid"))
    lab = points.join(core_lab, "node", "left").join(border, "node", "left")
    lab = materialize(lab.select("vec", F.coalesce("cid", "bid", F.lit(-1)).cast("int").alias("_label")), "labels")
    same = F.col(vec).eqNullSafe(F.col("_point"))
    return df.join(lab.withColumnRenamed("vec", "_point"), same).withColumn(out, F.col("_label")).drop("_point", "_label")
