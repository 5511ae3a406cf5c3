"""Model queries: split, oversampling, scaling, fits, stacking, evaluation,
cross-validation, scoring, K-Means segmentation, nearest centroid
(M3-M16, A13-A15, W7, W9). Fits use the full ``Settings()``."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import churn as C
from tessera.operators import features as FE
from tessera.operators import segments as S
from tessera.plans.context import Ctx
from tessera.plans.q_features import churn_features, segment_features
from tessera.plans.registry import query
from tessera.plans.common import plain
from tessera.plans.sqlparts import cte, with_ctes
from tessera.plans.sqlparts import q as sq

SET = C.Settings()
SCORING = C.Settings.scoring()


def prepared(ctx):
    """(frame with key, label and numeric features, feature names)."""
    # one row per beneficiary, read by the one-hot value lists, the split,
    # the scaler and the fits: computed once, kept (spilling to disk)
    f = churn_features(ctx).persist(StorageLevel.MEMORY_AND_DISK)
    f = FE.one_hot(f, ["genre", "tranche_age", "statut_pass"])
    cols = [c for c in f.columns if c not in (C.KEY, C.LABEL)]
    return FE.clean_features(f, cols), cols


def train_test(ctx):
    df, cols = prepared(ctx)
    sp = C.stratified_split(df)
    train, test = sp.filter("split = 'train'").drop("split"), sp.filter("split = 'test'").drop("split")
    return train, test, cols


_SPLIT_SQL = f"""
SELECT beneficiaire_id, churned, CASE WHEN r <= t THEN 'test' ELSE 'train' END AS split
FROM (SELECT beneficiaire_id, churned,
             row_number() OVER (PARTITION BY churned ORDER BY md5(CAST(beneficiaire_id AS VARCHAR) || ':{SET.seed}'), beneficiaire_id) AS r FROM churn_feat) f
JOIN (SELECT churned, floor(n * 0.2) + CASE WHEN row_number() OVER (ORDER BY n * 0.2 - floor(n * 0.2) DESC, churned)
                                                 <= ceil(sum(n) OVER () * 0.2) - sum(floor(n * 0.2)) OVER () THEN 1 ELSE 0 END AS t
      FROM (SELECT churned, count(*) AS n FROM churn_feat GROUP BY churned) c) s USING (churned)"""


@query("q_stratified_split", with_ctes(_SPLIT_SQL))
def q_stratified_split(spark, sf):
    """Exact stratified 80/20 split by hashed key (M3)."""
    df, _ = prepared(Ctx(spark, sf))
    return C.stratified_split(df).select(C.KEY, C.LABEL, "split")


@query("q_smote")
def q_smote(spark, sf):
    """Minority of the raw training rows oversampled to parity (M4)."""
    train, _, cols = train_test(Ctx(spark, sf))
    return C.smote(train, cols)


@query("q_smote_neighbours")
def q_smote_neighbours(spark, sf):
    """The five nearest minority rows of every minority training row (M4)."""
    train, _, cols = train_test(Ctx(spark, sf))
    n = train.groupBy(C.LABEL).agg(F.count(F.lit(1)).alias("n"))
    least = n.agg(F.min_by(C.LABEL, F.struct("n", C.LABEL))).scalar()
    nn = C.nearest_neighbours(train.filter(F.col(C.LABEL) == least), cols)
    return nn.select(F.col("_a").alias(C.KEY), F.col("_r").cast("long").alias("rang"), F.col("_b").alias("voisin"))


def _std_sql():
    from tessera.plans.q_features import _NUM  # same numeric columns as the feature CTE
    cols = [*_NUM, "en_situation_handicap", "est_membre_association", "anciennete_jours"]
    parts = [f"""round(CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) OVER () = 0 THEN CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()
                 ELSE (CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER () END, 6)
                 AS {c}""" for c in cols]
    return cols, "SELECT beneficiaire_id, " + ", ".join(parts) + " FROM churn_feat"


_STD_COLS, _STD_SQL = _std_sql()


@query("q_standardize", with_ctes(_STD_SQL))
def q_standardize(spark, sf):
    """Scaling by population std, as the reference's scaler (M5)."""
    f = churn_features(Ctx(spark, sf))
    z = C.standardize(f, f, _STD_COLS)
    return z.select(C.KEY, *[F.round(c, 6).alias(c) for c in _STD_COLS])


def _fit_all(ctx):
    """Oversampled training rows and hold-out, both scaled by the statistics of the oversampled
    rows (trees do not depend on it), each computed once and kept for the fits that iterate over them."""
    train, test, cols = train_test(ctx)
    raw = C.smote(train, cols).persist(StorageLevel.MEMORY_AND_DISK)
    stats = C.population_stats(raw, cols)
    over = C.class_weights(C.standardize(raw, raw, cols, stats)).persist(StorageLevel.MEMORY_AND_DISK)
    test_z = C.standardize(raw, test, cols, stats).persist(StorageLevel.MEMORY_AND_DISK)
    n = over.count()
    raw.unpersist()     # the scaled rows are kept instead
    return over, test_z, cols, stats, n


@query("q_model_metrics")
def q_model_metrics(spark, sf):
    """Five classifiers fitted on the oversampled training rows, evaluated on
    the hold-out; best by F1 flagged (M6-M11, W9)."""
    over, test_z, cols, _, n = _fit_all(Ctx(spark, sf))
    return C.compare(over, test_z, cols, SET, n)[0]


@query("q_stack_scores")
def q_stack_scores(spark, sf):
    """Stacking (RF + GB + XGBoost as GBT on out-of-fold probabilities -> logistic meta)."""
    over, test_z, cols, _, _ = _fit_all(Ctx(spark, sf))
    bases, meta = C.fit_stack(over, cols, SET)
    scored = C.stack_transform(bases, meta, test_z)
    return scored.select(C.KEY, C.LABEL, C.probability().alias("p_stack"))


@query("q_feature_importance")
def q_feature_importance(spark, sf):
    """Top 20 importances of the best model by F1; the forest's where that is the stack (M12d)."""
    over, test_z, cols, _, n = _fit_all(Ctx(spark, sf))
    _, best, fitted = C.compare(over, test_z, cols, SET, n)
    imp = C.importances(fitted["Random Forest" if best == C.STACK else best], cols)
    df = spark.createDataFrame(imp, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(20)


@query("q_cv_f1")
def q_cv_f1(spark, sf):
    """5-fold stratified cross-validated F1 of the best model by F1, no oversampling (M12e); scaled
    as its training rows were (trees do not depend on it)."""
    ctx = Ctx(spark, sf)
    over, test_z, cols, stats, n = _fit_all(ctx)
    _, best, _ = C.compare(over, test_z, cols, SET, n)
    df, _ = prepared(ctx)
    rows = C.cross_val_f1(best, C.class_weights(C.standardize(df, df, cols, stats)), cols, SET)
    out = spark.createDataFrame(rows, "fold int, f1 double")
    return out.unionByName(out.agg(F.lit(-1).alias("fold"), F.avg("f1").alias("f1"))).unionByName(
        out.agg(F.lit(-2).alias("fold"), F.stddev_pop("f1").alias("f1")))


@query("q_churn_scores")
def q_churn_scores(spark, sf):
    """Stacking refitted on all oversampled rows, every beneficiary scored,
    probability as DECIMAL(5,4), predicted flag and risk bucket (M12f, P18)."""
    df, cols = prepared(Ctx(spark, sf))
    raw = C.smote(df, cols).persist(StorageLevel.MEMORY_AND_DISK)
    stats = C.population_stats(raw, cols)
    z = C.standardize(raw, df, cols, stats).persist(StorageLevel.MEMORY_AND_DISK)
    over = C.class_weights(C.standardize(raw, raw, cols, stats)).persist(StorageLevel.MEMORY_AND_DISK)
    bases, meta = C.fit_stack(over, cols, SCORING)
    return C.score_frame(C.stack_transform(bases, meta, z))


# ---- segmentation -----------------------------------------------------------------

def _vectors(ctx):
    f = segment_features(ctx).persist(StorageLevel.MEMORY_AND_DISK)
    return S.scaled_vectors(f, FE.SEGMENT_COLS), f


@query("q_kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    """Inertia and silhouette for k = 2..8."""
    vec, _ = _vectors(Ctx(spark, sf))
    return S.kmeans_sweep(vec.persist(StorageLevel.MEMORY_AND_DISK), range(2, 9))


@query("q_choose_k")
def q_choose_k(spark, sf):
    """Best silhouette, but 4 when within 90 % of the best."""
    vec, _ = _vectors(Ctx(spark, sf))
    return S.choose_k(S.kmeans_sweep(vec.persist(StorageLevel.MEMORY_AND_DISK), range(2, 9)))


def _segments(ctx):
    vec, raw = _vectors(ctx)
    vec = vec.persist(StorageLevel.MEMORY_AND_DISK)
    k = S.choose_k(S.kmeans_sweep(vec, range(2, 9))).first()["chosen_k"]
    seg = S.segment(vec, int(k)).select(C.KEY, "cluster")
    return S.name_segments(raw.join(seg, C.KEY))


@query("q_segments")
def q_segments(spark, sf):
    """Final K-Means of the chosen k with restarts, clusters named by engagement."""
    return _segments(Ctx(spark, sf)).select(C.KEY, "cluster", "segment")


@query("q_segment_writeback")
def q_segment_writeback(spark, sf):
    """Cluster and segment written back to the dimension; people without a segment keep NULL."""
    from tessera.operators.scoring import rewrite
    from tessera.sources import io
    ctx = Ctx(spark, sf)
    dim = ctx.b.dim_beneficiaire.select(C.KEY, "source_id", "tranche_age")
    return rewrite(dim, [(_segments(ctx), ["cluster", "segment"])], C.KEY, io.scratch(spark, "dwh_segments"), "dim_beneficiaire", "segments")


@query("q_cluster_profile")
def q_cluster_profile(spark, sf):
    """Mean frequency, mean monetary and engagement per cluster."""
    return S.profile(_segments(Ctx(spark, sf)))


@query("q_segment_radar")
def q_segment_radar(spark, sf):
    """Segment means min-max normalised; mean frequency/monetary per segment."""
    return S.radar(_segments(Ctx(spark, sf)))


@query("q_segment_names")
def q_segment_names(spark, sf):
    """Segment sizes and shares by name."""
    from tessera.operators.scoring import value_share
    return value_share(_segments(Ctx(spark, sf)), "segment")


# The profiles, names and radar of a grouping that SQL can state: bands of frequency instead of fitted clusters.
cte("seg_band", "SELECT *, CAST(least(floor(frequency / 12.0), 8) AS INTEGER) AS cluster FROM seg_feat")
cte("band_profile", """SELECT cluster, avg(CAST(frequency AS DOUBLE)) AS avg_frequency, avg(CAST(monetary AS DOUBLE)) AS avg_monetary, count(*) AS n,
       avg(CAST(frequency AS DOUBLE)) * avg(CAST(monetary AS DOUBLE)) AS engagement_score FROM seg_band GROUP BY cluster""")


def _banded(ctx):
    return segment_features(ctx).withColumn("cluster", F.least(F.floor(F.col("frequency") / 12.0), F.lit(8)).cast("int"))


@query("q_band_profile", with_ctes("""SELECT CAST(cluster AS BIGINT) AS cluster, round(avg_frequency, 4) AS avg_frequency,
  round(avg_monetary, 4) AS avg_monetary, CAST(n AS BIGINT) AS n, round(engagement_score, 2) AS engagement_score FROM band_profile"""))
def q_band_profile(spark, sf):
    """Mean frequency, mean monetary and engagement of every band."""
    out = S.profile(_banded(Ctx(spark, sf)))
    return out.select(F.col("cluster").cast("long").alias("cluster"), F.round("avg_frequency", 4).alias("avg_frequency"),
                      F.round("avg_monetary", 4).alias("avg_monetary"), "n", F.round("engagement_score", 2).alias("engagement_score"))


@query("q_band_names", with_ctes(f"""
SELECT b.beneficiaire_id, CAST(b.cluster AS BIGINT) AS cluster, coalesce(list_extract([{', '.join(sq(n) for n in S.SEGMENT_NAMES)}], r), 'Segment_' || r) AS segment
FROM seg_band b JOIN (SELECT cluster, CAST(row_number() OVER (ORDER BY engagement_score DESC, cluster) AS INTEGER) AS r FROM band_profile) p ON p.cluster = b.cluster"""))
def q_band_names(spark, sf):
    """Bands named by engagement rank, beyond the list by number."""
    return S.name_segments(_banded(Ctx(spark, sf))).select(C.KEY, F.col("cluster").cast("long").alias("cluster"), "segment")


@query("q_band_radar", with_ctes("""
SELECT CAST(cluster AS VARCHAR) AS segment, """ + ", ".join(
    f"round(avg(CAST({c} AS DOUBLE)), 4) AS {c}, round((avg(CAST({c} AS DOUBLE)) - any_value(lo_{c})) / (any_value(hi_{c}) - any_value(lo_{c}) + 1e-9), 6) AS {c}_norm"
    for c in S.RADAR) + """
FROM seg_band, (SELECT """ + ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in S.RADAR) + """ FROM seg_band) g
GROUP BY cluster"""))
def q_band_radar(spark, sf):
    """Means per band, min-max normalised by the global range."""
    out = S.radar(_banded(Ctx(spark, sf)).withColumn("segment", F.col("cluster").cast("string")))
    return out.select("segment", *[F.round(c, 4).alias(c) for c in S.RADAR], *[F.round(f"{c}_norm", 6).alias(f"{c}_norm") for c in S.RADAR])


@query("q_choose_k_rule", """
WITH s AS (SELECT CAST(l_linenumber + 1 AS INTEGER) AS k, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS silhouette FROM lineitem GROUP BY 1)
SELECT CAST(best_k AS BIGINT) AS best_k, best_silhouette, preferred_silhouette,
       CAST(CASE WHEN preferred_silhouette > 0.9 * best_silhouette THEN 4 ELSE best_k END AS BIGINT) AS chosen_k
FROM (SELECT arg_max(k, silhouette) AS best_k, max(silhouette) AS best_silhouette, max(silhouette) FILTER (k = 4) AS preferred_silhouette FROM s) t""")
def q_choose_k_rule(spark, sf):
    """The choice of k over a table of scores by k that SQL can state: mean quantities by line number."""
    li = Ctx(spark, sf).stg.t["lineitem"]
    sweep = li.groupBy((F.col("l_linenumber") + 1).cast("int").alias("k")).agg(
        F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("silhouette"), F.lit(0.0).alias("inertia"))
    return plain(S.choose_k(sweep))


_NEAREST_SQL = """
WITH e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos
           FROM embeddings),
c AS (SELECT label AS cid, pos, avg(x) AS cx FROM e GROUP BY 1, 2),
d AS (SELECT e.vec_id, c.cid, sum((e.x - c.cx) * (e.x - c.cx)) AS dist FROM e JOIN c ON e.pos = c.pos GROUP BY 1, 2)
SELECT vec_id, CAST(cid AS BIGINT) AS cluster, round(dist, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cid) AS r FROM d) z WHERE r = 1"""


@query("q_assign_nearest", _NEAREST_SQL)
def q_assign_nearest(spark, sf):
    """Assignment step against fixed centroids (per-label mean embeddings):
    arg-min squared distance with array functions, no vector x centroid join (M16)."""
    emb = Ctx(spark, sf).stg.t["embeddings"]
    cents = S.mean_vectors(emb, "label", "embedding")
    arr = S.centroid_array(cents, "label", "centroid")
    out = S.assign_nearest(emb.select("vec_id", "embedding"), "embedding", arr)
    return out.select("vec_id", F.col("cluster").cast("long").alias("cluster"),
                      F.round("distance", 6).alias("distance"))

