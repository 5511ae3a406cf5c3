"""Segmentation: K-Means sweep, choice of k, restarts, naming, profiles,
nearest-centroid assignment (M13-M16, A13-A15, W7)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kmeans
from tessera.operators.churn import KEY, standardize

# Segment names by engagement rank (then 'Segment_<rank>').
SEGMENT_NAMES = ["Super-Actif", "Régulier", "Occasionnel", "Dormant", "Très Dormant", "Débutant", "Explorateur"]
RADAR = ["frequency", "monetary", "nb_offres", "nb_jours_actifs", "frequence_mensuelle"]


def scaled_vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL/NaN/inf -> 0, population-std scaling (sklearn's), then a feature array."""
    from tessera.operators.features import clean_features
    df = clean_features(df, cols)
    z = standardize(df, df, cols)
    return z.withColumn("features", F.array(*[F.col(c).cast("double") for c in cols]))


def kmeans_sweep(vec: DataFrame, ks=range(2, 9), seed: int = 42, max_iter: int = 300, starts: int = 10,
                 key: str = KEY) -> DataFrame:
    """Inertia and Euclidean silhouette (bounded sample) per k, of the start with the lowest inertia.

    All k x starts models are fitted together."""
    blocks = kmeans.keep(vec, key)
    best = kmeans.best_per_k(kmeans.fit_many(blocks, list(ks), starts, seed, max_iter))
    rows = [(int(k), m.inertia, s) for (k, m), s in zip(best.items(), kmeans.silhouettes(blocks, list(best.values()), seed=seed))]
    blocks.unpersist()
    return vec.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def choose_k(sweep: DataFrame, prefer: int = 4, ratio: float = 0.9) -> DataFrame:
    """K with the best silhouette, but ``prefer`` when its score exceeds
    ``ratio`` x the best (one aggregate over the sweep table)."""
    return sweep.agg(
        F.max_by("k", "silhouette").alias("best_k"), F.max("silhouette").alias("best_silhouette"),
        F.max(F.when(F.col("k") == prefer, F.col("silhouette"))).alias("preferred_silhouette"),
    ).withColumn("chosen_k", F.when(F.col("preferred_silhouette") > ratio * F.col("best_silhouette"),
                                    F.lit(prefer)).otherwise(F.col("best_k")))


def segment(vec: DataFrame, k: int, restarts: int = 20, seed: int = 42, max_iter: int = 500, key: str = KEY) -> DataFrame:
    """Final fit with restarts, fitted together; the lowest inertia wins and every row takes its nearest centre."""
    blocks = kmeans.keep(vec, key)
    best = kmeans.best_per_k(kmeans.fit_many(blocks, [k], restarts, seed, max_iter)).get(k)
    blocks.unpersist()
    if best is None:
        return vec.withColumn("cluster", F.lit(None).cast("int"))
    cents = F.array(*[F.struct(F.lit(i).alias("cid"), F.array(*[F.lit(float(x)) for x in c]).alias("c"))
                      for i, c in enumerate(best.centres)])
    values = vector_to_array("features") if isinstance(vec.schema["features"].dataType, VectorUDT) else F.col("features")
    return assign_nearest(vec.withColumn("_x", values), "_x", cents).drop("_x", "distance")


def name_segments(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """A13 + W7: clusters ranked by mean frequency x mean monetary; rank ->
    name from the fixed list, beyond it 'Segment_<rank>'."""
    prof = profile(df, cluster)
    # bounded: one row per cluster
    w = Window.orderBy(F.col("engagement_score").desc(), F.col(cluster))
    names = F.array(*[F.lit(n) for n in SEGMENT_NAMES])
    prof = prof.withColumn("rang", F.row_number().over(w))
    prof = prof.withColumn("segment", F.coalesce(F.try_element_at(names, F.col("rang")),
                                                 F.concat(F.lit("Segment_"), F.col("rang").cast("string"))))
    return df.join(F.broadcast(prof.select(cluster, "segment")), cluster)


def profile(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean frequency, mean monetary and their product per cluster."""
    return (df.groupBy(cluster)
            .agg(F.avg(F.col("frequency").cast("double")).alias("avg_frequency"),
                 F.avg(F.col("monetary").cast("double")).alias("avg_monetary"),
                 F.count(F.lit(1)).alias("n"))
            .withColumn("engagement_score", F.col("avg_frequency") * F.col("avg_monetary")))


def radar(df: DataFrame, segment_col: str = "segment", cols: list[str] = RADAR) -> DataFrame:
    """A14 + A15: segment means min-max normalised by the global range (+1e-9)."""
    means = df.groupBy(segment_col).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])
    rng = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
                 *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols]).first()
    return means.select(segment_col, *cols, *[
        ((F.col(c) - F.lit(rng[f"lo_{c}"])) / F.lit(rng[f"hi_{c}"] - rng[f"lo_{c}"] + 1e-9)).alias(f"{c}_norm")
        for c in cols])


def centroid_array(centroids: DataFrame, id_col: str, vec_col: str) -> F.Column:
    """The fitted centroids (k x d numbers, the model's parameters) as a
    literal array of (id, vector) structs shipped with the task code."""
    rows = centroids.select(id_col, vec_col).collect()
    return F.array(*[F.struct(F.lit(r[0]).alias("cid"), F.array(*[F.lit(float(x)) for x in r[1]]).alias("c"))
                     for r in sorted(rows, key=lambda r: r[0])])


def assign_nearest(vectors: DataFrame, vec_col: str, cents) -> DataFrame:
    """Arg-min squared Euclidean distance to fixed centroids (ties: lower
    id), computed with array higher-order functions inside codegen."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    dists = F.transform(cents, lambda c: F.struct(
        F.aggregate(F.zip_with(v, c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)
        .alias("d"), c["cid"].alias("cid")))
    best = F.array_min(dists)
    return vectors.withColumn("_best", best).withColumn("cluster", F.col("_best.cid")).withColumn(
        "distance", F.col("_best.d")).drop("_best")


def mean_vectors(df: DataFrame, group: str, vec_col: str) -> DataFrame:
    """Per-group mean vector: positions exploded, averaged, gathered back."""
    e = df.select(group, F.posexplode(vec_col).alias("pos", "x"))
    m = e.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))),
                                            lambda s: s["x"]).alias("centroid"))
