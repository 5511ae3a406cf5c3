"""Per-beneficiary features: RFM, behaviour, period trends, churn label,
segmentation features, one-hot encoding (A1-A5, A11, J8-J10, M1, M2, P15, P17).

The reference builds five grouped frames and chains left joins; here every
feature of one key comes out of a single ``groupBy`` with conditional
aggregates, and beneficiaries without operations get their defaults through
one LEFT join + ``coalesce`` (recency 999, other features 0).

Distinct counts use ``size(collect_set(...))``: each set is bounded by a
small domain (offers, sectors, categories, regions, calendar days), so even a
beneficiary holding a third of all rows keeps a small set, and the plan
avoids the row expansion that several ``count(DISTINCT)`` would cause.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import clean_number, safe_ratio

NO_OPS_RECENCY = 999


def _n_distinct(c: Column) -> Column:
    return F.size(F.collect_set(c))


def _d(x) -> Column:
    return F.lit(x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)))


def rfm(ops: DataFrame, ref) -> DataFrame:
    """A1: recency (days since last operation), frequency, monetary per beneficiary."""
    return ops.groupBy("beneficiaire_id").agg(
        F.datediff(_d(ref), F.max("date_complete")).alias("recency"),
        F.sum("nb_operations").cast("long").alias("frequency"),
        F.sum("montant_reduction").alias("monetary"),
    )


def _behavior_aggs(obs: Column | None = None) -> list[Column]:
    """Behaviour aggregates, restricted to rows where ``obs`` holds (all rows if None)."""
    def w(c):
        return c if obs is None else F.when(obs, c)
    amount = F.col("montant_reduction")
    return [
        F.max(w(F.col("date_complete"))).alias("_last"),
        F.min(w(F.col("date_complete"))).alias("_first"),
        F.sum(w(F.col("nb_operations"))).cast("long").alias("frequency"),
        F.sum(w(amount)).alias("monetary"),
        F.count(w(amount)).alias("_n_amount"),
        F.stddev_samp(w(amount.cast("double"))).alias("montant_std"),
        F.max(w(amount)).alias("montant_max"),
        F.min(w(amount)).alias("montant_min"),
        _n_distinct(w(F.col("offre_id"))).alias("nb_offres_distinctes"),
        _n_distinct(w(F.col("secteur"))).alias("nb_secteurs_distincts"),
        _n_distinct(w(F.col("categorie"))).alias("nb_categories_distinctes"),
        _n_distinct(w(F.col("region"))).alias("nb_regions"),
        _n_distinct(w(F.col("date_complete"))).alias("nb_jours_actifs"),
        F.sum(w(F.col("est_weekend").cast("int"))).cast("long").alias("nb_weekends"),
    ]


def _derive_behavior(df: DataFrame, ref) -> DataFrame:
    return (df
            .withColumn("recency", F.datediff(_d(ref), F.col("_last")))
            .withColumn("montant_moyen", F.col("monetary").cast("double") / F.col("_n_amount"))
            .withColumn("montant_std", F.coalesce("montant_std", F.lit(0.0)))
            .withColumn("duree_activite_jours", F.datediff("_last", "_first"))
            .withColumn("frequence_mensuelle",
                        F.col("nb_jours_actifs") / F.greatest(F.col("duree_activite_jours") / 30.0, F.lit(1.0)))
            .withColumn("ratio_weekend", safe_ratio(F.col("nb_weekends"), F.col("frequency")))
            .withColumn("intensite", safe_ratio(F.col("monetary").cast("double"), F.col("nb_jours_actifs"))))


BEHAVIOR_COLS = ["montant_moyen", "montant_std", "montant_max", "montant_min", "nb_offres_distinctes",
                 "nb_secteurs_distincts", "nb_categories_distinctes", "nb_regions", "nb_jours_actifs", "nb_weekends",
                 "duree_activite_jours", "frequence_mensuelle", "ratio_weekend", "intensite"]
PERIOD_COLS = ["ops_h1", "montant_h1", "ops_h2", "montant_h2", "ops_last_q", "montant_last_q", "ops_last_6m"]
TREND_COLS = ["trend_ops", "trend_montant", "ratio_ops_recent", "ratio_ops_6m", "acceleration"]


def behavior(ops: DataFrame, ref) -> DataFrame:
    """A2: RFM + behaviour per beneficiary over all given operations."""
    g = ops.groupBy("beneficiaire_id").agg(*_behavior_aggs())
    return _derive_behavior(g, ref).select("beneficiaire_id", "recency", "frequency", "monetary", *BEHAVIOR_COLS)


def _period_aggs(obs: Column, mid, q_start, h_start) -> list[Column]:
    d = F.col("date_complete")
    n, m = F.col("nb_operations"), F.col("montant_reduction")

    def s(cond, c):
        return F.sum(F.when(obs & cond, c))
    return [
        s(d <= _d(mid), n).cast("long").alias("ops_h1"), s(d <= _d(mid), m).alias("montant_h1"),
        s(d > _d(mid), n).cast("long").alias("ops_h2"), s(d > _d(mid), m).alias("montant_h2"),
        s(d >= _d(q_start), n).cast("long").alias("ops_last_q"), s(d >= _d(q_start), m).alias("montant_last_q"),
        s(d >= _d(h_start), n).cast("long").alias("ops_last_6m"),
    ]


def _derive_trends(df: DataFrame) -> DataFrame:
    for c in PERIOD_COLS:
        zero = F.lit(0).cast(df.schema[c].dataType)
        df = df.withColumn(c, F.coalesce(F.col(c), zero))
    return (df
            .withColumn("trend_ops", F.col("ops_h2") - F.col("ops_h1"))
            .withColumn("trend_montant", F.col("montant_h2") - F.col("montant_h1"))
            .withColumn("ratio_ops_recent", safe_ratio(F.col("ops_last_q"), F.col("frequency")))
            .withColumn("ratio_ops_6m", safe_ratio(F.col("ops_last_6m"), F.col("frequency")))
            .withColumn("acceleration", safe_ratio(F.col("ops_h2"), F.col("ops_h1"))))


def period_trends(ops: DataFrame, cutoff, mid, q_start, h_start) -> DataFrame:
    """A3 + A4: period sums (all up to the cutoff) and trend ratios."""
    obs = F.col("date_complete") <= _d(cutoff)
    g = ops.groupBy("beneficiaire_id").agg(
        F.sum(F.when(obs, F.col("nb_operations"))).cast("long").alias("frequency"),
        *_period_aggs(obs, mid, q_start, h_start))
    g = g.filter(F.col("frequency").isNotNull())
    return _derive_trends(g).select("beneficiaire_id", *PERIOD_COLS, *TREND_COLS)


def churn_features(benef: DataFrame, ops: DataFrame, cutoff, mid, q_start, h_start) -> DataFrame:
    """M2 numeric part + label, one pass over the operations.

    Observed rows are those up to the cutoff; ``churned`` is 0 when the
    beneficiary has any operation after it (J10)."""
    obs = F.col("date_complete") <= _d(cutoff)
    g = ops.groupBy("beneficiaire_id").agg(
        *_behavior_aggs(obs), *_period_aggs(obs, mid, q_start, h_start),
        F.max(F.when(~obs, F.lit(1))).alias("_after"),
    )
    g = _derive_trends(_derive_behavior(g, cutoff))
    num = ["recency", "frequency", "monetary", *BEHAVIOR_COLS, *PERIOD_COLS, *TREND_COLS]
    g = g.select("beneficiaire_id", "_last", "_after", *num)
    b = benef.select("beneficiaire_id", "genre", "tranche_age", "statut_pass", "en_situation_handicap",
                     "est_membre_association", "date_inscription")
    f = b.join(g, "beneficiaire_id", "left")
    has_obs = F.col("_last").isNotNull()
    cols = [F.col("beneficiaire_id")]
    for c in num:
        default = NO_OPS_RECENCY if c == "recency" else 0
        cols.append(F.when(has_obs, F.col(c)).otherwise(F.lit(default).cast(g.schema[c].dataType)).alias(c))
    cols += [
        "genre", "tranche_age", "statut_pass",
        F.coalesce(F.col("en_situation_handicap").cast("int"), F.lit(0)).alias("en_situation_handicap"),
        F.coalesce(F.col("est_membre_association").cast("int"), F.lit(0)).alias("est_membre_association"),
        F.datediff(_d(cutoff), F.col("date_inscription")).alias("anciennete_jours"),
        F.when(F.col("_after").isNotNull(), 0).otherwise(1).alias("churned"),
    ]
    return f.select(*cols)


NUMERIC_CHURN = ["recency", "frequency", "monetary", *BEHAVIOR_COLS, *PERIOD_COLS, *TREND_COLS,
                 "en_situation_handicap", "est_membre_association", "anciennete_jours"]

SEGMENT_COLS = ["recency", "frequency", "monetary", "montant_moyen", "nb_offres", "nb_secteurs", "nb_regions",
                "nb_jours_actifs", "nb_weekends", "duree_activite", "frequence_mensuelle", "ratio_weekend",
                "diversite_offres", "intensite", "anciennete", "est_membre_association"]


def segment_features(benef: DataFrame, ops: DataFrame) -> DataFrame:
    """A5 + A11: 16 features per beneficiary; the reference date is the last
    operation date overall (a scalar subquery, no collect). One row per beneficiary is kept (spilling to disk), so
    that the reference date does not read and join the operations a second time."""
    g = ops.groupBy("beneficiaire_id").agg(
        F.max("date_complete").alias("_last"), F.min("date_complete").alias("_first"),
        F.sum("nb_operations").cast("long").alias("frequency"),
        F.sum("montant_reduction").alias("monetary"),
        (F.sum("montant_reduction").cast("double") / F.count("montant_reduction")).alias("montant_moyen"),
        _n_distinct(F.col("offre_id")).alias("nb_offres"),
        _n_distinct(F.col("secteur")).alias("nb_secteurs"),
        _n_distinct(F.col("region")).alias("nb_regions"),
        _n_distinct(F.col("date_complete")).alias("nb_jours_actifs"),
        F.sum(F.col("est_weekend").cast("int")).cast("long").alias("nb_weekends"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    ref = g.agg(F.max("_last")).scalar()
    g = (g.withColumn("recency", F.datediff(ref, F.col("_last")))
         .withColumn("duree_activite", F.datediff("_last", "_first"))
         .withColumn("frequence_mensuelle", F.col("frequency") / F.greatest(F.col("duree_activite") / 30.0, F.lit(1.0)))
         .withColumn("ratio_weekend", safe_ratio(F.col("nb_weekends"), F.col("frequency")))
         .withColumn("diversite_offres", safe_ratio(F.col("nb_offres"), F.col("frequency")))
         .withColumn("intensite", safe_ratio(F.col("monetary").cast("double"), F.col("nb_jours_actifs"))))
    b = benef.select("beneficiaire_id", "date_inscription", "est_membre_association")
    f = b.join(g, "beneficiaire_id", "left")
    has = F.col("_last").isNotNull()
    cols = [F.col("beneficiaire_id")]
    for c in SEGMENT_COLS[:-2]:
        default = NO_OPS_RECENCY if c == "recency" else 0
        cols.append(F.when(has, F.col(c)).otherwise(F.lit(default).cast(g.schema[c].dataType)).alias(c))
    cols += [F.datediff(ref, F.col("date_inscription")).alias("anciennete"),
             F.coalesce(F.col("est_membre_association").cast("int"), F.lit(0)).alias("est_membre_association")]
    return f.select(*cols)


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = True) -> DataFrame:
    """M1: 0/1 columns ``<col>_<value>`` over the sorted distinct values, the
    first (alphabetical) value dropped. The value lists are dimension domains
    (a handful of values), the only thing brought to the driver."""
    out = df
    for c in cols:
        values = sorted(r[0] for r in df.select(c).distinct().filter(F.col(c).isNotNull()).collect())
        for v in values[1:] if drop_first else values:
            out = out.withColumn(f"{c}_{v}", (F.col(c) == F.lit(v)).cast("int"))
        out = out.drop(c)
    return out


def clean_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL, NaN and infinities -> 0 before modelling."""
    return df.select(*[clean_number(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
