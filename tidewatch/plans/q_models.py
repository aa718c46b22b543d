"""Checks of the neighbour joins and the models built on them (G5, G6, E7,
E8, L5, K4) and of the Spark ML / Python-worker models (K, L) on ``vectors``
(embeddings; ``label = 0`` is the anomaly)."""

from __future__ import annotations

from tidewatch.operators import neighbors as N
from tidewatch.plans.registry import r6, r6list, register
from tidewatch.session import materialize
from tidewatch.sources.fixtures import VECTORS_SQL, vectors

V = f"v as ({VECTORS_SQL})"
EPS = 1.16
MIN_SAMPLES = 5
KNN_K = 5
LOF_K = 20


@register("g5_knn_exact", f"""with {V},
d as (select a.vec_id as q_key, b.vec_id as r_key, list_distance(a.features, b.features) as dist
      from v a join v b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by q_key order by round(dist, 9), r_key) as rank from d)
select q_key, r_key, {r6('dist')} as dist, cast(rank as integer) as rank from r where rank <= {KNN_K}""")
def g5_knn_exact(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return N.knn(v, v, "vec_id", "features", KNN_K, exclude_self=True)


@register("g6_radius_join", f"""with {V}
select a.vec_id as q_key, b.vec_id as r_key, {r6('list_distance(a.features, b.features)')} as dist
from v a join v b on list_distance(a.features, b.features) <= {EPS}""")
def g6_radius_join(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return N.radius_join(v, v, "vec_id", "features", EPS)


# ---- E7 / E8 / E9: SMOTE --------------------------------------------------------------

def _h15(expr, salt):
    return f"cast(('0x' || substr(md5('42:' || cast({expr} as varchar) || '{salt}'), 1, 15)) as bigint)"


def _u32(expr, salt):
    return f"(cast(('0x' || substr(md5('42:' || cast({expr} as varchar) || '{salt}'), 1, 8)) as bigint) / 4294967296.0)"


def _smote_sql(src: str, ratio: float = 0.5, k: int = 5) -> str:
    """SMOTE over the rows of CTE ``src`` (vec_id, features, label)."""
    return f"""cnt as (select count(*) filter (where label = 0) as nmin, count(*) filter (where label = 1) as nmaj from {src}),
mi as (select vec_id, features, row_number() over (order by vec_id) - 1 as midx from {src} where label = 0),
nn as (select * from (select a.vec_id as q, b.vec_id as r, row_number() over (partition by a.vec_id
        order by round(list_distance(a.features, b.features), 9), b.vec_id) as rk
      from mi a join mi b on a.vec_id <> b.vec_id) where rk <= least({k}, (select nmin from cnt) - 1)),
syn as (select j, {_h15('j', ':b')} % nmin as bidx,
        {_h15('j', ':n')} % least({k}, nmin - 1) + 1 as nb, {_u32('j', ':u')} as u
      from cnt, range(cast(trunc(nmaj * {ratio} - nmin) as bigint)) t(j)),
news as (select -(syn.j + 1) as vec_id,
        list_transform(list_zip(bm.features, rm.features), lambda x: x[1] + syn.u * (x[2] - x[1])) as features,
        0 as label from syn join mi bm on bm.midx = syn.bidx join nn on nn.q = bm.vec_id and nn.rk = syn.nb
        join mi rm on rm.vec_id = nn.r),
bal as (select vec_id, features, label from {src} union all select * from news)"""


@register("e7_smote", f"with {V}, {_smote_sql('v')} select vec_id, {r6list('features')} as features, label from bal")
def e7_smote(spark, sf_dir):
    from tidewatch.operators.balance import smote
    return smote(vectors(spark, sf_dir).drop("digit"), "label", "vec_id", "features", 0.5, 5)


_UNDER_SQL = f"""vu as (select * from (select *, row_number() over (partition by label order by {_h15('vec_id', '')}, vec_id) as rn
  from v) where label = 0 or rn <= (select cast(count(*) / 0.1 as bigint) from v where label = 0))"""


@register("e8_undersample_then_smote", f"""with {V}, {_UNDER_SQL}, {_smote_sql('vu')}
select vec_id, {r6list('features')} as features, label from bal""")
def e8_undersample_then_smote(spark, sf_dir):
    from tidewatch.operators.balance import balance
    return balance(vectors(spark, sf_dir).drop("digit"), "label", "vec_id", "features", method="both")


_VSPLIT = f"""vs as (select *, case when r <= floor(0.2 * n) then 'test' when r <= floor(0.4 * n) then 'val'
  else 'train' end as split from (select *, row_number() over (partition by label order by {_h15('vec_id', '')}, vec_id) as r,
  count(*) over (partition by label) as n from v)),
vtrain as (select vec_id, features, label from vs where split = 'train')"""


@register("e9_balance_train_only", f"""with {V}, {_VSPLIT}, {_smote_sql('vtrain')}
select vec_id, {r6list('features')} as features, label, 'train' as split from bal
union all select vec_id, {r6list('features')} as features, label, split from vs where split <> 'train'""")
def e9_balance_train_only(spark, sf_dir):
    from tidewatch.operators.balance import balance_train
    from tidewatch.operators.sample import stratified_split
    v = stratified_split(vectors(spark, sf_dir).drop("digit"), "label", "vec_id")
    return balance_train(v, label="label", key="vec_id", vec="features", method="smote")


# ---- L5: local outlier factor ---------------------------------------------------------

@register("l5_lof_scores", f"""with {V},
fit as (select * from v where label = 1),
fnn as (select * from (select a.vec_id as p, b.vec_id as o, list_distance(a.features, b.features) as d,
   row_number() over (partition by a.vec_id order by round(list_distance(a.features, b.features), 9), b.vec_id) as rk
   from fit a join fit b on a.vec_id <> b.vec_id) where rk <= {LOF_K}),
kd as (select p as o, d as kdist from fnn where rk = {LOF_K}),
lrd as (select f.p, 1 / (avg(greatest(kd.kdist, f.d)) + 1e-10) as lrd from fnn f join kd on f.o = kd.o group by f.p),
qnn as (select * from (select a.vec_id as q, b.vec_id as o, list_distance(a.features, b.features) as d,
   row_number() over (partition by a.vec_id order by round(list_distance(a.features, b.features), 9), b.vec_id) as rk
   from v a join fit b on true) where rk <= {LOF_K}),
sc as (select q, avg(lrd.lrd) / (1 / (avg(greatest(kd.kdist, qnn.d)) + 1e-10)) as lof
   from qnn join kd on qnn.o = kd.o join lrd on qnn.o = lrd.p group by q)
select q as vec_id, {r6('lof')} as lof, {r6('lof - 1.5')} as score from sc""")
def l5_lof_scores(spark, sf_dir):
    """L5 + L7: novelty LOF (k=20) fitted on normal rows, scored on all rows."""
    from pyspark.sql import functions as F
    from tidewatch.operators.detect.lof import fit_lof
    v = vectors(spark, sf_dir)
    model = fit_lof(v.where(F.col("label") == 1), "vec_id", "features", LOF_K)
    return model.score(v.select("vec_id", "features")).select("vec_id", "lof", "score")


# ---- K4 / F10: DBSCAN -----------------------------------------------------------------

_DBSCAN_SQL = f"""with recursive {V},
pairs as (select a.vec_id as a, b.vec_id as b from v a join v b on list_distance(a.features, b.features) <= {EPS}),
core as (select a as node from pairs group by a having count(*) >= {MIN_SAMPLES}),
ce as (select p.a, p.b from pairs p where p.a in (select node from core) and p.b in (select node from core)),
reach(node, comp) as (select node, node from core union select ce.b, reach.comp from reach join ce on reach.node = ce.a),
cc as (select node, min(comp) as comp from reach group by node),
ids as (select comp, dense_rank() over (order by comp) - 1 as cid from (select distinct comp from cc)),
corelab as (select cc.node, ids.cid from cc join ids using (comp)),
border as (select p.a as node, min(c.cid) as bid from pairs p join corelab c on p.b = c.node group by p.a),
lab as (select v.vec_id, cast(coalesce(corelab.cid, border.bid, -1) as integer) as cluster
  from v left join corelab on v.vec_id = corelab.node left join border on v.vec_id = border.node)
"""


def _dbscan(spark, sf_dir):
    from tidewatch.operators.cluster import dbscan
    return dbscan(vectors(spark, sf_dir).select("vec_id", "features"), "vec_id", "features", EPS, MIN_SAMPLES)


@register("k4_dbscan", _DBSCAN_SQL + "select vec_id, cluster from lab")
def k4_dbscan(spark, sf_dir):
    return _dbscan(spark, sf_dir).select("vec_id", "cluster")


@register("f10_cluster_sizes", _DBSCAN_SQL + "select cluster, count(*) as \"count\" from lab group by cluster")
def f10_cluster_sizes(spark, sf_dir):
    from tidewatch.operators.cluster import cluster_sizes
    return cluster_sizes(_dbscan(spark, sf_dir))


# ---- L: detectors ---------------------------------------------------------------------

def _iforest(spark, sf_dir):
    from tidewatch.operators.detect import AnomalyDetector
    v = vectors(spark, sf_dir)
    det = AnomalyDetector("isolation_forest", key="vec_id", vec="features").fit(v)
    return det, v


@register("l2_isolation_forest_scores")
def l2_isolation_forest_scores(spark, sf_dir):
    """L2 + L3 + L7 (rows only: seeded random trees): 100 trees of 256 rows."""
    det, v = _iforest(spark, sf_dir)
    return det.score(v).select("vec_id", "label", "raw", "score")


@register("l4_one_class_svm_scores")
def l4_one_class_svm_scores(spark, sf_dir):
    """L4 (rows only): random-feature one-class SVM, nu = 0.01."""
    from tidewatch.operators.detect import AnomalyDetector
    v = vectors(spark, sf_dir)
    det = AnomalyDetector("one_class_svm", key="vec_id", vec="features").fit(v)
    return det.predict(v).select("vec_id", "label", "raw", "score", "prediction")


@register("l9_ensemble_scores")
def l9_ensemble_scores(spark, sf_dir):
    """L9-L12 (rows only): forest + SVM + LOF fitted on normal rows; member
    scores, ensemble score and hard / soft votes."""
    from pyspark.sql import functions as F
    from tidewatch.operators.detect import AnomalyDetector, EnsembleAnomalyDetector
    v = vectors(spark, sf_dir).select("vec_id", "features", "label")
    ens = EnsembleAnomalyDetector([AnomalyDetector(t, key="vec_id", vec="features") for t in
                                   ("isolation_forest", "one_class_svm", "local_outlier_factor")])
    ens.fit(v.where(F.col("label") == 1))
    hard = ens.predict(v).withColumnRenamed("prediction", "hard_vote")
    soft = F.when(F.col("score") > 0, -1).otherwise(1).alias("soft_vote")
    return hard.select("vec_id", "label", "score_0", "score_1", "score_2", "score", "hard_vote", soft)


# L6-L8, L10-L12 on given raw scores (SQL-checkable combination logic) --------------------
_MEMBERS = ["Flow Duration", "Destination IP", "Destination Port"]
_C = 0.1


def _members_sql():
    from tidewatch.sources.fixtures import EVENT_FLOWS_SQL
    offs = ", ".join(f"quantile_cont(\"{c}\", {1 - _C}) as o{i}" for i, c in enumerate(_MEMBERS))
    scores = ", ".join(f"\"{c}\" - (select o{i} from offs) as s{i}" for i, c in enumerate(_MEMBERS))
    return f"""with ef as ({EVENT_FLOWS_SQL}), offs as (select {offs} from ef),
sc as (select flow_id, "Label", {scores} from ef),
pr as (select *, case when s0 > 0 then -1 else 1 end as p0, case when s1 > 0 then -1 else 1 end as p1,
  case when s2 > 0 then -1 else 1 end as p2, (s0 + s1 + s2) / 3.0 as es from sc)
"""


def _members(spark, sf_dir):
    from tidewatch.operators.detect import EnsembleAnomalyDetector, ScoreColumnDetector
    from tidewatch.sources.fixtures import event_flows
    ef = event_flows(spark, sf_dir).select("flow_id", "Label", *[f"`{c}`" for c in _MEMBERS])
    ens = EnsembleAnomalyDetector([ScoreColumnDetector(c) for c in _MEMBERS]).fit(ef, contamination=_C)
    return ens, ef


@register("l6_contamination_offset", _members_sql() +
          f"select {r6('o0')} as offset_0, {r6('o1')} as offset_1, {r6('o2')} as offset_2 from offs")
def l6_contamination_offset(spark, sf_dir):
    """offset = (1 - contamination) quantile of training scores."""
    from pyspark.sql import functions as F
    ens, _ = _members(spark, sf_dir)
    return spark.range(1).select(*[F.lit(m.offset).cast("double").alias(f"offset_{i}")
                                   for i, m in enumerate(ens.models)])


@register("l8_predict_own_cut", _members_sql() + f"select flow_id, {r6('s0')} as score, p0 as prediction from pr")
def l8_predict_own_cut(spark, sf_dir):
    """L7 + L8: score = raw - offset; anomaly when score > 0 (own cut)."""
    from pyspark.sql import functions as F
    ens, ef = _members(spark, sf_dir)
    s = ens.models[0].score(ef)
    return s.select("flow_id", "score", F.when(F.col("score") > 0, -1).otherwise(1).alias("prediction"))


@register("l10_hard_vote", _members_sql() +
          "select flow_id, case when p0 + p1 + p2 > 0 then 1 else -1 end as prediction from pr")
def l10_hard_vote(spark, sf_dir):
    ens, ef = _members(spark, sf_dir)
    ens.voting = "hard"
    return ens.predict(ef).select("flow_id", "prediction")


@register("l11_soft_vote", _members_sql() +
          "select flow_id, case when es > 0 then -1 else 1 end as prediction from pr")
def l11_soft_vote(spark, sf_dir):
    ens, ef = _members(spark, sf_dir)
    ens.voting = "soft"
    return ens.predict(ef).select("flow_id", "prediction")


@register("l12_ensemble_score", _members_sql() + f"select flow_id, {r6('es')} as score from pr")
def l12_ensemble_score(spark, sf_dir):
    ens, ef = _members(spark, sf_dir)
    return ens.score(ef).select("flow_id", "score")


# K2, K6, L4 by what holds of every right result -------------------------------------------
def _full_pca(spark, sf_dir):
    """PCA of the embeddings to all components: (fit, scores' variances by component, width)."""
    from pyspark.sql import functions as F
    from tidewatch.operators.cluster import fit_pca
    v = vectors(spark, sf_dir).select("vec_id", "features")
    width = v.select(F.size("features").alias("d")).first()["d"]
    fit = fit_pca(v, width, max_components=width)
    scores = fit.transform(v).select(F.posexplode("pca").alias("at", "score"))
    spread = scores.groupBy((F.col("at") + 1).alias("component")).agg(F.var_samp("score").alias("variance"))
    return fit, materialize(spread, "pca_spread"), width


_CELLS = """cells as (select vec_id, unnest(range(1, len(embedding) + 1)) as f, unnest(embedding)::double as x from embeddings)"""


@register("k2_pca_spectrum", f"""with {_CELLS},
cov as (select a.f, b.f as g, covar_samp(a.x, b.x) as c from cells a join cells b using (vec_id) group by all)
select count(distinct f)::bigint as components, {r6('sum(case when f = g then c end)')} as total, {r6('sum(c * c)')} as squares from cov""")
def k2_pca_spectrum(spark, sf_dir):
    """K2: the variances of all components sum to the trace of the covariance,
    their squares to its squared entries."""
    from pyspark.sql import functions as F
    _, spread, _ = _full_pca(spark, sf_dir)
    v = F.col("variance")
    return spread.agg(F.count(F.lit(1)).alias("components"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"))


@register("k6_loading_variances", f"""with {_CELLS}
select 'f' || f as feature, {r6('var_samp(x)')} as variance from cells group by f""")
def k6_loading_variances(spark, sf_dir):
    """K2, K6: squared loadings times the variances of their components give
    back the variance of every feature."""
    from pyspark.sql import functions as F
    fit, spread, width = _full_pca(spark, sf_dir)
    loadings = fit.loadings(spark, [f"f{i + 1}" for i in range(width)])
    back = F.sum(F.col("weight") * F.col("weight") * F.col("variance"))
    return loadings.join(spread, "component").groupBy("feature").agg(back.alias("variance"))


@register("l4_training_share", """select count(*)::bigint as n_rows, ceil(0.01 * (count(*) - 1))::bigint as n_outliers from embeddings""")
def l4_training_share(spark, sf_dir):
    """The one-class SVM with nu = 0.01 flags the training rows beyond
    the exact nu-quantile of its decision values."""
    from pyspark.sql import functions as F
    from tidewatch.operators.detect import AnomalyDetector
    v = vectors(spark, sf_dir)
    scored = AnomalyDetector("one_class_svm", key="vec_id", vec="features", nu=0.01).fit(v).predict(v)
    return scored.agg(F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("score") > 0).cast("long")).alias("n_outliers"))
