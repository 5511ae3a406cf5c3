"""Feature queries: RFM, behaviour, trends, churn features and label,
segmentation features, one-hot, cleaning, deterministic-score reports
(A1-A5, A9, A11, A12, A16, J8-J10, M1, M2, M11, M12a-c, P17, P18, H12-H14, S8, S9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import risk_segment
from tessera.operators import features as FE
from tessera.operators.measures import MEASURES
from tessera.operators.scoring import (class_report, confusion, metrics_table, roc_points, score_histogram,
                                       value_share, write_back)
from tessera.plans.common import plain, plain_sql
from tessera.plans.context import Ctx
from tessera.plans.registry import query
from tessera.plans.sqlparts import cte, d, with_ctes
from tessera.sources.bindings import CUTOFF, LAST_H, LAST_Q, MID

# ---- operation extract used by the models (rule-B star, strict grain) -----------


def ops_extract(star, until=None, after=None):
    """``until`` / ``after``: operations by date; the filter stands below the lookups and reaches the scan of the orders."""
    f = star.fait_operations(until=until, after=after)
    t = F.broadcast(star.dim_temps.select("temps_id", "date_complete", "est_weekend"))
    r = (star.dim_region.select("region_id", "region"))
    o = (star.dim_offre.select("offre_id", "secteur", "categorie"))
    return (f.join(t, "temps_id").join(r, "region_id").join(o, "offre_id")
            .select("beneficiaire_id", "montant_reduction", "nb_operations", "offre_id", "date_complete",
                    "est_weekend", "region", "secteur", "categorie"))


cte("ops_b", """
SELECT f.beneficiaire_id, f.montant_reduction, f.nb_operations, f.offre_id, t.date_complete, t.est_weekend,
       r.region, o.secteur, o.categorie
FROM fops_b f JOIN dim_temps t ON f.temps_id = t.temps_id JOIN dim_region_b r ON f.region_id = r.region_id
JOIN dim_offre o ON f.offre_id = o.offre_id""")

OBS = f"date_complete <= {d(CUTOFF)}"


def _w(expr, obs=OBS):
    return f"CASE WHEN {obs} THEN {expr} END" if obs else expr


def _behavior_sql(obs=OBS):
    return f"""max({_w('date_complete', obs)}) AS _last, min({_w('date_complete', obs)}) AS _first,
  CAST(sum({_w('nb_operations', obs)}) AS BIGINT) AS frequency, sum({_w('montant_reduction', obs)}) AS monetary,
  count({_w('montant_reduction', obs)}) AS _n_amount,
  stddev_samp({_w('CAST(montant_reduction AS DOUBLE)', obs)}) AS montant_std,
  max({_w('montant_reduction', obs)}) AS montant_max, min({_w('montant_reduction', obs)}) AS montant_min,
  count(DISTINCT {_w('offre_id', obs)}) AS nb_offres_distinctes,
  count(DISTINCT {_w('secteur', obs)}) AS nb_secteurs_distincts,
  count(DISTINCT {_w('categorie', obs)}) AS nb_categories_distinctes,
  count(DISTINCT {_w('region', obs)}) AS nb_regions,
  count(DISTINCT {_w('date_complete', obs)}) AS nb_jours_actifs,
  CAST(sum({_w('CAST(est_weekend AS INTEGER)', obs)}) AS BIGINT) AS nb_weekends"""


def _period_sql(obs=OBS):
    def s(cond, c):
        return f"sum(CASE WHEN {obs} AND {cond} THEN {c} END)"
    m, q_, h = d(MID), d(LAST_Q), d(LAST_H)
    return f"""CAST({s(f'date_complete <= {m}', 'nb_operations')} AS BIGINT) AS ops_h1,
  {s(f'date_complete <= {m}', 'montant_reduction')} AS montant_h1,
  CAST({s(f'date_complete > {m}', 'nb_operations')} AS BIGINT) AS ops_h2,
  {s(f'date_complete > {m}', 'montant_reduction')} AS montant_h2,
  CAST({s(f'date_complete >= {q_}', 'nb_operations')} AS BIGINT) AS ops_last_q,
  {s(f'date_complete >= {q_}', 'montant_reduction')} AS montant_last_q,
  CAST({s(f'date_complete >= {h}', 'nb_operations')} AS BIGINT) AS ops_last_6m"""


def _derived_behavior(ref):
    return f"""datediff('day', _last, {ref}) AS recency,
  CAST(monetary AS DOUBLE) / _n_amount AS montant_moyen, round(coalesce(montant_std, 0), 6) AS montant_std_r,
  datediff('day', _first, _last) AS duree_activite_jours,
  nb_jours_actifs / greatest(datediff('day', _first, _last) / 30.0, 1.0) AS frequence_mensuelle,
  nb_weekends / greatest(frequency, 1) AS ratio_weekend,
  CAST(monetary AS DOUBLE) / greatest(nb_jours_actifs, 1) AS intensite"""


_PER = ["ops_h1", "montant_h1", "ops_h2", "montant_h2", "ops_last_q", "montant_last_q", "ops_last_6m"]


def _derived_trends():
    z = ", ".join(f"coalesce({c}, 0) AS {c}_z" for c in _PER)
    return f"""{z},
  coalesce(ops_h2, 0) - coalesce(ops_h1, 0) AS trend_ops,
  coalesce(montant_h2, 0) - coalesce(montant_h1, 0) AS trend_montant,
  coalesce(ops_last_q, 0) / greatest(frequency, 1) AS ratio_ops_recent,
  coalesce(ops_last_6m, 0) / greatest(frequency, 1) AS ratio_ops_6m,
  coalesce(ops_h2, 0) / greatest(coalesce(ops_h1, 0), 1) AS acceleration"""


_BEH = ["montant_moyen", "montant_std", "montant_max", "montant_min", "nb_offres_distinctes", "nb_secteurs_distincts",
        "nb_categories_distinctes", "nb_regions", "nb_jours_actifs", "nb_weekends", "duree_activite_jours",
        "frequence_mensuelle", "ratio_weekend", "intensite"]
_TR = ["trend_ops", "trend_montant", "ratio_ops_recent", "ratio_ops_6m", "acceleration"]

cte("churn_g", f"""
SELECT *, {_derived_behavior(d(CUTOFF))}, {_derived_trends()}
FROM (SELECT beneficiaire_id, {_behavior_sql()}, {_period_sql()},
             max(CASE WHEN NOT ({OBS}) THEN 1 END) AS _after
      FROM ops_b GROUP BY beneficiaire_id) g""")


def _src(c):
    if c == "montant_std":
        return "g.montant_std_r"
    if c in _PER:
        return f"g.{c}_z"
    return f"g.{c}"


_NUM = ["recency", "frequency", "monetary", *_BEH, *_PER, *_TR]
cte("churn_feat", f"""
SELECT b.beneficiaire_id,
  {', '.join(f"CASE WHEN g._last IS NOT NULL THEN {_src(c)} ELSE {999 if c == 'recency' else 0} END AS {c}" for c in _NUM)},
  b.genre, b.tranche_age, b.statut_pass,
  coalesce(CAST(b.en_situation_handicap AS INTEGER), 0) AS en_situation_handicap,
  coalesce(CAST(b.est_membre_association AS INTEGER), 0) AS est_membre_association,
  datediff('day', b.date_inscription, {d(CUTOFF)}) AS anciennete_jours,
  CASE WHEN g._after IS NOT NULL THEN 0 ELSE 1 END AS churned
FROM dim_benef_b b LEFT JOIN churn_g g ON b.beneficiaire_id = g.beneficiaire_id""")

_FEAT_CASTS = ("recency:i,monetary:d,montant_max:d,montant_min:d,duree_activite_jours:i,montant_h1:d,montant_h2:d,"
               "montant_last_q:d,trend_montant:d,en_situation_handicap:i,est_membre_association:i,"
               "anciennete_jours:i,churned:i")


def churn_features(ctx):
    s = ctx.b
    f = FE.churn_features(s.dim_beneficiaire, ops_extract(s), CUTOFF, MID, LAST_Q, LAST_H)
    return f.withColumn("montant_std", F.round("montant_std", 6))


@query("q_churn_features", plain_sql(with_ctes("SELECT * FROM churn_feat"), _FEAT_CASTS))
def q_churn_features(spark, sf):
    """Churn feature matrix + label in one grouped pass."""
    return plain(churn_features(Ctx(spark, sf)))


@query("q_rfm", plain_sql(with_ctes(f"""
SELECT beneficiaire_id, datediff('day', max(date_complete), {d(CUTOFF)}) AS recency,
       CAST(sum(nb_operations) AS BIGINT) AS frequency, sum(montant_reduction) AS monetary
FROM ops_b WHERE {OBS} GROUP BY beneficiaire_id"""), "recency:i,monetary:d"))
def q_rfm(spark, sf):
    """RFM at the churn cutoff; the cutoff filter reaches the scan."""
    ops = ops_extract(Ctx(spark, sf).b, until=CUTOFF)
    return plain(FE.rfm(ops, CUTOFF))


@query("q_behavior", plain_sql(with_ctes(f"""
SELECT beneficiaire_id, recency, frequency, monetary,
  {', '.join('montant_std_r AS montant_std' if c == 'montant_std' else c for c in _BEH)}
FROM (SELECT *, {_derived_behavior(d(CUTOFF))}
      FROM (SELECT beneficiaire_id, {_behavior_sql(None)} FROM ops_b WHERE {OBS} GROUP BY beneficiaire_id) g) x"""),
    "recency:i,monetary:d,montant_max:d,montant_min:d,duree_activite_jours:i"))
def q_behavior(spark, sf):
    """Behaviour per beneficiary: mean, sample std (one row -> 0), distinct counts, spans (A2)."""
    ops = ops_extract(Ctx(spark, sf).b, until=CUTOFF)
    return plain(FE.behavior(ops, CUTOFF).withColumn("montant_std", F.round("montant_std", 6)))


@query("q_period_trends", plain_sql(with_ctes(f"""
SELECT beneficiaire_id, {', '.join(f'{c}_z AS {c}' for c in _PER)}, {', '.join(_TR)}
FROM (SELECT *, {_derived_trends()}
      FROM (SELECT beneficiaire_id, CAST(sum(CASE WHEN {OBS} THEN nb_operations END) AS BIGINT) AS frequency,
                   {_period_sql()} FROM ops_b GROUP BY beneficiaire_id) g
      WHERE frequency IS NOT NULL) x"""), "montant_h1:d,montant_h2:d,montant_last_q:d,trend_montant:d"))
def q_period_trends(spark, sf):
    """Half-year, last-quarter and last-6-month sums and trend ratios (A3, A4)."""
    return plain(FE.period_trends(ops_extract(Ctx(spark, sf).b), CUTOFF, MID, LAST_Q, LAST_H))


@query("q_benef_no_ops", plain_sql(with_ctes(
    "SELECT beneficiaire_id, recency, frequency, monetary, anciennete_jours FROM churn_feat WHERE frequency = 0 "
    "AND recency = 999"), "recency:i,monetary:d,anciennete_jours:i"))
def q_benef_no_ops(spark, sf):
    """Beneficiaries without an observed operation get the defaults."""
    f = churn_features(Ctx(spark, sf))
    return plain(f.filter((F.col("frequency") == 0) & (F.col("recency") == 999))
                 .select("beneficiaire_id", "recency", "frequency", "monetary", "anciennete_jours"))


@query("q_churn_label", with_ctes(f"""
SELECT b.beneficiaire_id, CASE WHEN a.beneficiaire_id IS NULL THEN 1 ELSE 0 END AS churned
FROM dim_benef_b b LEFT JOIN (SELECT DISTINCT beneficiaire_id FROM ops_b WHERE NOT ({OBS})) a
  ON b.beneficiaire_id = a.beneficiaire_id"""))
def q_churn_label(spark, sf):
    """Label by existence of an operation after the cutoff (J10, U4): one pass over the star, whose later operations
    are one row per beneficiary before they meet the dimension."""
    s = Ctx(spark, sf).b
    after = ops_extract(s, after=CUTOFF).groupBy("beneficiaire_id").agg(F.lit(0).alias("churned"))
    return (s.dim_beneficiaire.select("beneficiaire_id").join(after, "beneficiaire_id", "left")
            .select("beneficiaire_id", F.coalesce("churned", F.lit(1)).alias("churned")))


@query("q_churn_rate", with_ctes(
    "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(churned) AS BIGINT) AS n_churned, "
    "avg(CAST(churned AS DOUBLE)) AS churn_rate FROM churn_feat"))
def q_churn_rate(spark, sf):
    """Label count and rate."""
    f = churn_features(Ctx(spark, sf))
    return f.agg(F.count(F.lit(1)).alias("n"), F.sum("churned").cast("long").alias("n_churned"),
                 F.avg(F.col("churned").cast("double")).alias("churn_rate"))


_SEG_REF = "(SELECT max(date_complete) FROM ops_b)"
cte("seg_feat", f"""
SELECT b.beneficiaire_id,
  CASE WHEN g._last IS NULL THEN 999 ELSE datediff('day', g._last, {_SEG_REF}) END AS recency,
  coalesce(g.frequency, 0) AS frequency, coalesce(g.monetary, 0) AS monetary, coalesce(g.montant_moyen, 0) AS montant_moyen,
  coalesce(g.nb_offres, 0) AS nb_offres, coalesce(g.nb_secteurs, 0) AS nb_secteurs, coalesce(g.nb_regions, 0) AS nb_regions,
  coalesce(g.nb_jours_actifs, 0) AS nb_jours_actifs, coalesce(g.nb_weekends, 0) AS nb_weekends,
  coalesce(datediff('day', g._first, g._last), 0) AS duree_activite,
  coalesce(g.frequency / greatest(datediff('day', g._first, g._last) / 30.0, 1.0), 0) AS frequence_mensuelle,
  coalesce(g.nb_weekends / greatest(g.frequency, 1), 0) AS ratio_weekend,
  coalesce(g.nb_offres / greatest(g.frequency, 1), 0) AS diversite_offres,
  coalesce(CAST(g.monetary AS DOUBLE) / greatest(g.nb_jours_actifs, 1), 0) AS intensite,
  datediff('day', b.date_inscription, {_SEG_REF}) AS anciennete,
  coalesce(CAST(b.est_membre_association AS INTEGER), 0) AS est_membre_association
FROM dim_benef_b b LEFT JOIN (
  SELECT beneficiaire_id, max(date_complete) AS _last, min(date_complete) AS _first,
         CAST(sum(nb_operations) AS BIGINT) AS frequency, sum(montant_reduction) AS monetary,
         CAST(sum(montant_reduction) AS DOUBLE) / count(montant_reduction) AS montant_moyen,
         count(DISTINCT offre_id) AS nb_offres, count(DISTINCT secteur) AS nb_secteurs,
         count(DISTINCT region) AS nb_regions, count(DISTINCT date_complete) AS nb_jours_actifs,
         CAST(sum(CAST(est_weekend AS INTEGER)) AS BIGINT) AS nb_weekends
  FROM ops_b GROUP BY beneficiaire_id) g ON b.beneficiaire_id = g.beneficiaire_id""")
_SEG_CASTS = "recency:i,monetary:d,duree_activite:i,anciennete:i,est_membre_association:i"


def segment_features(ctx):
    s = ctx.b
    return FE.segment_features(s.dim_beneficiaire, ops_extract(s))


@query("q_segment_features", plain_sql(with_ctes("SELECT * FROM seg_feat"), _SEG_CASTS))
def q_segment_features(spark, sf):
    """16 segmentation features; reference date = last operation overall."""
    return plain(segment_features(Ctx(spark, sf)))


@query("q_one_hot", plain_sql(with_ctes("""
SELECT beneficiaire_id, CAST(genre = 'M' AS INTEGER) AS genre_M,
       CAST(tranche_age = '16-18' AS INTEGER) AS "tranche_age_16-18",
       CAST(tranche_age = '19-22' AS INTEGER) AS "tranche_age_19-22",
       CAST(tranche_age = '23-25' AS INTEGER) AS "tranche_age_23-25",
       CAST(tranche_age = '26-30' AS INTEGER) AS "tranche_age_26-30",
       CAST(statut_pass = 'Desactive' AS INTEGER) AS statut_pass_Desactive
FROM dim_benef_b"""), 'genre_M:i,"tranche_age_16-18":i,"tranche_age_19-22":i,"tranche_age_23-25":i,'
                      '"tranche_age_26-30":i,statut_pass_Desactive:i'))
def q_one_hot(spark, sf):
    """One-hot with the alphabetically first value dropped (M1)."""
    d_ = Ctx(spark, sf).b.dim_beneficiaire.select("beneficiaire_id", "genre", "tranche_age", "statut_pass")
    return plain(FE.one_hot(d_, ["genre", "tranche_age", "statut_pass"]))


@query("q_feature_clean", with_ctes("""
SELECT beneficiaire_id,
       CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE x END AS monetary_per_op,
       CASE WHEN y IS NULL OR isnan(y) OR isinf(y) THEN 0.0 ELSE y END AS growth
FROM (SELECT beneficiaire_id, CAST(monetary AS DOUBLE) / frequency AS x,
             CAST(ops_h2 AS DOUBLE) / ops_h1 AS y FROM churn_feat) t"""))
def q_feature_clean(spark, sf):
    """Raw ratios without guards (0 denominators give NULL/inf/NaN), then cleaned."""
    f = churn_features(Ctx(spark, sf)).select(
        "beneficiaire_id",
        F.try_divide(F.col("monetary").cast("double"), F.col("frequency").cast("double")).alias("monetary_per_op"),
        F.try_divide(F.col("ops_h2").cast("double"), F.col("ops_h1").cast("double")).alias("growth"))
    return FE.clean_features(f, ["monetary_per_op", "growth"])


# ---- deterministic score: least(recency / 1000, 1) -------------------------------

def scored(ctx):
    """Churn features with a deterministic score, so reports have exact oracles."""
    f = churn_features(ctx)
    p = F.least(F.col("recency") / 1000.0, F.lit(1.0))
    return f.select("beneficiaire_id", "churned", p.alias("churn_probability"))


cte("scored", "SELECT beneficiaire_id, churned, least(recency / 1000.0, 1.0) AS churn_probability FROM churn_feat")


@query("q_risk_segment", with_ctes("""
SELECT beneficiaire_id, CAST(round(churn_probability, 4) AS DOUBLE) AS churn_probability,
       churn_probability >= 0.5 AS churn_predicted,
       CASE WHEN churn_probability < 0.3 THEN 'Faible' WHEN churn_probability < 0.6 THEN 'Moyen' ELSE 'Eleve' END
         AS churn_risk_segment
FROM scored"""))
def q_risk_segment(spark, sf):
    """Probability -> DECIMAL(5,4), predicted flag, risk bucket."""
    s = scored(Ctx(spark, sf))
    p = F.col("churn_probability")
    return plain(s.select("beneficiaire_id", F.round(p, 4).cast("decimal(5,4)").alias("churn_probability"),
                          (p >= 0.5).alias("churn_predicted"), risk_segment(p).alias("churn_risk_segment")))


cte("scores_seg", """
SELECT beneficiaire_id, CAST(round(churn_probability, 4) AS DECIMAL(5,4)) AS churn_probability,
       churn_probability >= 0.5 AS churn_predicted,
       CASE WHEN churn_probability < 0.3 THEN 'Faible' WHEN churn_probability < 0.6 THEN 'Moyen' ELSE 'Eleve' END
         AS churn_risk_segment
FROM scored""")


def _score_cols(ctx):
    s = scored(ctx)
    p = F.col("churn_probability")
    return s.select("beneficiaire_id", F.round(p, 4).cast("decimal(5,4)").alias("churn_probability"),
                    (p >= 0.5).alias("churn_predicted"), risk_segment(p).alias("churn_risk_segment"))


@query("q_measures_churn", plain_sql(with_ctes("""
SELECT b.tranche_age,
  coalesce(CAST(count_if(s.churn_predicted) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 0) AS Taux_Churn_Predit,
  count_if(s.churn_risk_segment = 'Eleve') AS Nb_Beneficiaires_A_Risque,
  CAST(sum(s.churn_probability) AS DOUBLE) / count(s.churn_probability) AS Score_Churn_Moyen
FROM dim_benef_b b LEFT JOIN scores_seg s ON b.beneficiaire_id = s.beneficiaire_id
GROUP BY b.tranche_age"""), "Nb_Beneficiaires_A_Risque:i"))
def q_measures_churn(spark, sf):
    """Churn measures over the written-back dimension by age band."""
    c = Ctx(spark, sf)
    dim = c.b.dim_beneficiaire.join(_score_cols(c), "beneficiaire_id", "left")
    ms = MEASURES["beneficiaire"]
    return plain(dim.groupBy("tranche_age").agg(
        *[ms[n]().alias(n) for n in ("Taux_Churn_Predit", "Nb_Beneficiaires_A_Risque", "Score_Churn_Moyen")]))


@query("q_score_writeback", plain_sql(with_ctes("""
SELECT b.beneficiaire_id, b.source_id, b.tranche_age, s.churn_probability, s.churn_predicted, s.churn_risk_segment
FROM dim_benef_b b LEFT JOIN scores_seg s ON b.beneficiaire_id = s.beneficiaire_id"""), "churn_probability:d"))
def q_score_writeback(spark, sf):
    """Write-back: old score columns dropped, scores joined by key, dimension
    rewritten; the post-write check counts rows with a score > 0 (S8, S9)."""
    c = Ctx(spark, sf)
    dim = c.b.dim_beneficiaire.select("beneficiaire_id", "source_id", "tranche_age")
    out = write_back(dim, _score_cols(c), "beneficiaire_id",
                     ["churn_probability", "churn_predicted", "churn_risk_segment"])
    return plain(out)


@query("q_value_share", with_ctes("""
SELECT churn_risk_segment AS value, CAST(count(*) AS BIGINT) AS n,
       round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
FROM scores_seg GROUP BY churn_risk_segment"""))
def q_value_share(spark, sf):
    """Value counts with share of total (A9) over the risk groups."""
    return value_share(_score_cols(Ctx(spark, sf)), "churn_risk_segment")


@query("q_score_histogram", with_ctes("""
SELECT LEAST(CAST(floor((churn_probability - mn) / nullif((mx - mn) / 40.0, 0)) AS BIGINT), 39) AS bin,
       churned, CAST(count(*) AS BIGINT) AS n
FROM scored, (SELECT min(churn_probability) AS mn, max(churn_probability) AS mx FROM scored) b
GROUP BY 1, 2"""))
def q_score_histogram(spark, sf):
    """40-bin score histogram split by true class."""
    return score_histogram(scored(Ctx(spark, sf)), "churn_probability", "churned", 40)


@query("q_confusion", with_ctes("""
SELECT CAST(churned AS BIGINT) AS label, CAST(churn_probability >= 0.5 AS BIGINT) AS predicted, CAST(count(*) AS BIGINT) AS n
FROM scored GROUP BY 1, 2"""))
def q_confusion(spark, sf):
    """Confusion matrix."""
    return plain(confusion(scored(Ctx(spark, sf)), "churn_probability", "churned"))


cte("cm", """
SELECT count_if(churned = 1 AND churn_probability >= 0.5) AS tp, count_if(churned = 0 AND churn_probability >= 0.5) AS fp,
       count_if(churned = 1 AND churn_probability < 0.5) AS fn, count_if(churned = 0 AND churn_probability < 0.5) AS tn
FROM scored""")
cte("auc_t", """
SELECT sum(CASE WHEN churned = 1 THEN rk END) AS rank_sum, count_if(churned = 1) AS npos, count_if(churned = 0) AS nneg
FROM (SELECT churned, rank() OVER (ORDER BY churn_probability) + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2.0 AS rk
      FROM scored) r""")


@query("q_metrics_table", with_ctes("""
SELECT 'recency_score' AS model,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((rank_sum - npos * (npos + 1) / 2.0) / (npos * nneg), 6) AS auc
FROM cm, auc_t"""))
def q_metrics_table(spark, sf):
    """Accuracy, precision, recall, F1 and rank-statistic AUC."""
    return metrics_table(scored(Ctx(spark, sf)), "churn_probability", "churned", "recency_score")


@query("q_roc_points", with_ctes("""
SELECT churn_probability AS threshold,
  round(sum(pos) OVER w / (SELECT count_if(churned = 1) FROM scored), 9) AS tpr,
  round(sum(neg) OVER w / (SELECT count_if(churned = 0) FROM scored), 9) AS fpr
FROM (SELECT churn_probability, count_if(churned = 1) AS pos, count_if(churned = 0) AS neg FROM scored GROUP BY 1) s
WINDOW w AS (ORDER BY churn_probability DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def q_roc_points(spark, sf):
    """ROC points: cumulative sums over the distinct scores, descending."""
    return roc_points(scored(Ctx(spark, sf)), "churn_probability", "churned")


cte("cr_per", """
SELECT 'Actif' AS classe, tn AS tp_c, fn AS fp_c, fp AS fn_c, tn + fp AS support FROM cm
UNION ALL SELECT 'Churne', tp, fp, fn, tp + fn FROM cm""")
cte("cr_f", """
SELECT classe, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, support
FROM (SELECT classe, coalesce(tp_c / nullif(tp_c + fp_c, 0), 0) AS p, coalesce(tp_c / nullif(tp_c + fn_c, 0), 0) AS r,
             support FROM cr_per) m""")


@query("q_class_report", with_ctes("""
SELECT classe, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
FROM cr_f
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM cr_f
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM cr_f"""))
def q_class_report(spark, sf):
    """Per-class precision/recall/F1/support with macro and weighted averages."""
    return class_report(scored(Ctx(spark, sf)), "churn_probability", "churned")


@query("q_score_check", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(s.churn_probability > 0) AS BIGINT) AS n_scored
FROM dim_benef_b b LEFT JOIN scores_seg s ON b.beneficiaire_id = s.beneficiaire_id"""))
def q_score_check(spark, sf):
    """Post-write check: rows of the rewritten dimension and rows with a score > 0."""
    c = Ctx(spark, sf)
    dim = c.b.dim_beneficiaire.select("beneficiaire_id", "source_id", "tranche_age")
    out = write_back(dim, _score_cols(c), "beneficiaire_id",
                     ["churn_probability", "churn_predicted", "churn_risk_segment"])
    return out.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_if(F.col("churn_probability") > 0).alias("n_scored"))
