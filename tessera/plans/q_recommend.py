"""Recommendation queries."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tessera.functions.columns import ellipsis
from tessera.operators import recommend as R
from tessera.operators.scoring import value_share
from tessera.plans.common import plain, plain_sql
from tessera.plans.context import Ctx
from tessera.plans.registry import query
from tessera.plans.sqlparts import cte, d, q as sq, with_ctes
from tessera.sources.bindings import CUTOFF


def rec_ops(star, until=None):
    """Operations with their offer's sector (inner joins with region and offer)."""
    f = star.fait_operations(until=until)
    if until is not None:
        f = f.join(F.broadcast(star.dim_temps.select("temps_id")), "temps_id")
    r = (star.dim_region.select("region_id"))
    o = (star.dim_offre.select("offre_id", "secteur"))
    return f.join(r, "region_id").join(o, "offre_id").select("beneficiaire_id", "offre_id", "nb_operations", "secteur")


cte("rops", """
SELECT f.beneficiaire_id, f.offre_id, f.nb_operations, o.secteur
FROM fops_b f JOIN dim_region_b r ON f.region_id = r.region_id JOIN dim_offre o ON f.offre_id = o.offre_id""")
cte("rops_cut", f"""
SELECT f.beneficiaire_id, f.offre_id, f.nb_operations, o.secteur
FROM fops_b f JOIN dim_temps t ON f.temps_id = t.temps_id JOIN dim_region_b r ON f.region_id = r.region_id
JOIN dim_offre o ON f.offre_id = o.offre_id WHERE t.date_complete <= {d(CUTOFF)}""")


def _rec_sql(src: str) -> dict[str, str]:
    """CTEs of the reference recommender written with plain SQL (dense candidates)."""
    return {
        f"ui_{src}": f"SELECT beneficiaire_id AS u, offre_id AS i, CAST(sum(nb_operations) AS BIGINT) AS n FROM {src} GROUP BY 1, 2",
        f"dots_{src}": f"SELECT a.i, b.i AS j, CAST(sum(a.n * b.n) AS DOUBLE) AS dot FROM ui_{src} a JOIN ui_{src} b ON a.u = b.u GROUP BY 1, 2",
        f"sim_{src}": f"""SELECT x.i, x.j, x.dot / sqrt(di.dot * dj.dot) AS similarity FROM dots_{src} x
            JOIN dots_{src} di ON di.i = x.i AND di.j = x.i JOIN dots_{src} dj ON dj.i = x.j AND dj.j = x.j""",
        f"items_{src}": f"SELECT DISTINCT i FROM ui_{src}",
        f"cand_{src}": f"""SELECT us.u, it.i AS cand FROM (SELECT DISTINCT u FROM ui_{src}) us, items_{src} it
            WHERE NOT EXISTS (SELECT 1 FROM ui_{src} x WHERE x.u = us.u AND x.i = it.i)""",
        f"score_{src}": f"""SELECT c.u, c.cand, round(coalesce(sum(x.n * s.similarity), 0), 9) AS score
            FROM cand_{src} c JOIN ui_{src} x ON x.u = c.u LEFT JOIN sim_{src} s ON s.i = x.i AND s.j = c.cand
            GROUP BY 1, 2""",
        f"pop_{src}": f"""SELECT offre_id, total_ops, row_number() OVER (ORDER BY total_ops DESC, offre_id) AS rang
            FROM (SELECT offre_id, CAST(sum(nb_operations) AS BIGINT) AS total_ops FROM {src} GROUP BY 1) p""",
        f"top_{src}": f"""SELECT u, max(CASE WHEN r = 1 THEN cand END) AS rec_1, max(CASE WHEN r = 2 THEN cand END) AS rec_2,
            max(CASE WHEN r = 3 THEN cand END) AS rec_3
            FROM (SELECT u, cand, row_number() OVER (PARTITION BY u ORDER BY score DESC, cand) AS r FROM score_{src}) z
            WHERE r <= 3 GROUP BY u""",
        f"recs_{src}": f"""SELECT b.beneficiaire_id,
            CASE WHEN t.u IS NULL AND NOT EXISTS (SELECT 1 FROM ui_{src} x WHERE x.u = b.beneficiaire_id)
                 THEN (SELECT offre_id FROM pop_{src} WHERE rang = 1) ELSE t.rec_1 END AS rec_1,
            CASE WHEN t.u IS NULL AND NOT EXISTS (SELECT 1 FROM ui_{src} x WHERE x.u = b.beneficiaire_id)
                 THEN (SELECT offre_id FROM pop_{src} WHERE rang = 2) ELSE t.rec_2 END AS rec_2,
            CASE WHEN t.u IS NULL AND NOT EXISTS (SELECT 1 FROM ui_{src} x WHERE x.u = b.beneficiaire_id)
                 THEN (SELECT offre_id FROM pop_{src} WHERE rang = 3) ELSE t.rec_3 END AS rec_3
            FROM dim_benef_b b LEFT JOIN top_{src} t ON t.u = b.beneficiaire_id""",
        f"fav_{src}": f"""SELECT beneficiaire_id, secteur, total FROM (
            SELECT beneficiaire_id, secteur, total,
                   row_number() OVER (PARTITION BY beneficiaire_id ORDER BY total DESC, secteur) AS r
            FROM (SELECT beneficiaire_id, secteur, CAST(sum(nb_operations) AS BIGINT) AS total FROM {src} GROUP BY 1, 2) g) z
            WHERE r = 1""",
        f"topsec_{src}": f"SELECT secteur FROM {src} GROUP BY secteur ORDER BY count(*) DESC, secteur LIMIT 1",
    }


for _s in ("rops", "rops_cut"):
    for _k, _v in _rec_sql(_s).items():
        cte(_k, _v)


def _recs(ctx, until=None):
    s = ctx.b
    ops = rec_ops(s, until)
    return R.recommend(s.dim_beneficiaire, ops, s.dim_offre), ops


@query("q_user_item_pivot", with_ctes("SELECT u AS beneficiaire_id, i AS offre_id, n FROM ui_rops"))
def q_user_item_pivot(spark, sf):
    """User x offer counts in long (sparse) form."""
    return R.user_item(rec_ops(Ctx(spark, sf).b))


@query("q_item_similarity", with_ctes("SELECT i, j, round(similarity, 9) AS similarity FROM sim_rops"))
def q_item_similarity(spark, sf):
    """Item-item cosine over user counts."""
    ui = R.user_item(rec_ops(Ctx(spark, sf).b))
    return R.item_similarity(ui).withColumn("similarity", F.round("similarity", 9))


@query("q_recommend_scores", with_ctes("SELECT u AS beneficiaire_id, cand, score FROM score_rops"))
def q_recommend_scores(spark, sf):
    """Scores of all unused offers, zeros included."""
    # read by the similarity and by the product: computed once, kept (spilling to disk)
    ui = R.user_item(rec_ops(Ctx(spark, sf).b)).persist(StorageLevel.MEMORY_AND_DISK)
    return R.candidate_scores(ui, R.item_similarity(ui))


@query("q_popular_offers", with_ctes("""
SELECT p.offre_id, p.total_ops, o.nom_offre, o.secteur, CAST(p.rang AS BIGINT) AS rang
FROM pop_rops p LEFT JOIN dim_offre o ON o.offre_id = p.offre_id"""))
def q_popular_offers(spark, sf):
    """Global popularity ranked by total operations, ties by id."""
    s = Ctx(spark, sf).b
    return R.popularity(rec_ops(s), s.dim_offre).select("offre_id", "total_ops", "nom_offre", "secteur",
                                                          F.col("rang").cast("long").alias("rang"))


@query("q_fav_sector", with_ctes("SELECT * FROM fav_rops"))
def q_fav_sector(spark, sf):
    """Favourite sector per beneficiary."""
    return R.favourite_sector(rec_ops(Ctx(spark, sf).b))


@query("q_recommend_top3", with_ctes("SELECT * FROM recs_rops"))
def q_recommend_top3(spark, sf):
    """Top 3 unseen offers, zero scores and popularity as fill."""
    recs, _ = _recs(Ctx(spark, sf))
    return recs


@query("q_recommend_coldstart", with_ctes("""
SELECT r.* FROM recs_rops_cut r
WHERE NOT EXISTS (SELECT 1 FROM ui_rops_cut x WHERE x.u = r.beneficiaire_id)"""))
def q_recommend_coldstart(spark, sf):
    """As of the churn cutoff, beneficiaries without history get the global top 3."""
    c = Ctx(spark, sf)
    recs, ops = _recs(c, CUTOFF)
    seen = ops.select("beneficiaire_id").distinct()
    return recs.join(seen, "beneficiaire_id", "left_anti")


def _label_sql(src):
    def one(k, default, missing):
        return (f"CASE WHEN r.rec_{k} IS NULL THEN {sq(missing)} ELSE coalesce("
                f"(SELECT nom_offre || ' (' || nom_partenaire || ')' FROM dim_offre o WHERE o.offre_id = r.rec_{k} AND o.actif),"
                f" {sq(default)}) END AS recommandation_offre_{k}")
    cols = ", ".join(one(k + 1, R.DEFAULT_LABELS[k], R.MISSING_LABELS[k]) for k in range(3))
    return f"""SELECT r.beneficiaire_id, {cols},
        coalesce(f.secteur, (SELECT secteur FROM topsec_{src})) AS secteur_recommande
        FROM recs_{src} r LEFT JOIN fav_{src} f ON f.beneficiaire_id = r.beneficiaire_id"""


cte("labels_rops", _label_sql("rops"))


def _labelled(ctx):
    s = ctx.b
    recs, ops = _recs(ctx)
    lab = R.label(recs, s.dim_offre)
    sec = R.recommend_sector(s.dim_beneficiaire, ops)
    return lab.join(sec, "beneficiaire_id")


@query("q_recommend_labels", with_ctes("SELECT * FROM labels_rops"))
def q_recommend_labels(spark, sf):
    """Labels of the recommendations and the recommended sector."""
    return _labelled(Ctx(spark, sf))


@query("q_recommend_sector", with_ctes("""
SELECT b.beneficiaire_id, coalesce(f.secteur, (SELECT secteur FROM topsec_rops)) AS secteur_recommande
FROM dim_benef_b b LEFT JOIN fav_rops f ON f.beneficiaire_id = b.beneficiaire_id"""))
def q_recommend_sector(spark, sf):
    """Own favourite sector, else the global most frequent."""
    s = Ctx(spark, sf).b
    return R.recommend_sector(s.dim_beneficiaire, rec_ops(s))


@query("q_rec_report", with_ctes("""
SELECT secteur_recommande AS value, CAST(count(*) AS BIGINT) AS n,
       round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
FROM labels_rops GROUP BY 1"""))
def q_rec_report(spark, sf):
    """Recommended-sector counts and shares."""
    return value_share(_labelled(Ctx(spark, sf)), "secteur_recommande")


@query("q_top10_rec1", with_ctes("""
SELECT CASE WHEN length(recommandation_offre_1) > 35 THEN substr(recommandation_offre_1, 1, 35) || '...'
            ELSE recommandation_offre_1 END AS label, n
FROM (SELECT recommandation_offre_1, CAST(count(*) AS BIGINT) AS n FROM labels_rops GROUP BY 1
      ORDER BY n DESC, recommandation_offre_1 LIMIT 10) t"""))
def q_top10_rec1(spark, sf):
    """Ten most frequent first recommendations, label cut to 35 characters."""
    lab = _labelled(Ctx(spark, sf))
    top = (lab.groupBy("recommandation_offre_1").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), F.col("recommandation_offre_1")).limit(10))
    return top.select(ellipsis(F.col("recommandation_offre_1"), 35).alias("label"), "n")


@query("q_offer_label", with_ctes("""
SELECT offre_id, nom_offre || ' (' || nom_partenaire || ')' AS label,
       CASE WHEN length(nom_offre || ' (' || nom_partenaire || ')') > 35
            THEN substr(nom_offre || ' (' || nom_partenaire || ')', 1, 35) || '...'
            ELSE nom_offre || ' (' || nom_partenaire || ')' END AS label_35,
       substr(nom_offre || ' (' || nom_partenaire || ')', 1, 20) AS label_20
FROM dim_offre"""))
def q_offer_label(spark, sf):
    """Display labels: 'offer (partner)', cut to 35 + '...', and to 20."""
    from tessera.functions.columns import offer_label
    o = Ctx(spark, sf).a.dim_offre
    lab = offer_label(F.col("nom_offre"), F.col("nom_partenaire"))
    return o.select("offre_id", lab.alias("label"), ellipsis(lab, 35).alias("label_35"),
                    F.substring(lab, 1, 20).alias("label_20"))


@query("q_rec_matrix_shape", with_ctes("""
SELECT CAST(count(DISTINCT u) AS BIGINT) AS n_users, CAST(count(DISTINCT i) AS BIGINT) AS n_items,
       CAST(count(*) AS BIGINT) AS n_nonzero FROM ui_rops"""))
def q_rec_matrix_shape(spark, sf):
    """Shape of the user x offer matrix and its non-zero cells."""
    ui = R.user_item(rec_ops(Ctx(spark, sf).b))
    return ui.agg(F.count_distinct("beneficiaire_id").alias("n_users"), F.count_distinct("offre_id").alias("n_items"),
                  F.count(F.lit(1)).alias("n_nonzero"))


@query("q_dim_writeback", plain_sql(with_ctes("""
SELECT b.beneficiaire_id, b.source_id, b.cin, b.tranche_age, s.churn_probability, s.churn_predicted, s.churn_risk_segment,
       l.recommandation_offre_1, l.recommandation_offre_2, l.recommandation_offre_3, l.secteur_recommande
FROM dim_benef_b b LEFT JOIN scores_seg s ON b.beneficiaire_id = s.beneficiaire_id
LEFT JOIN labels_rops l ON b.beneficiaire_id = l.beneficiaire_id"""), "churn_probability:d"))
def q_dim_writeback(spark, sf):
    """Scores, recommendations and sector written back: the dimension is loaded, rewritten twice (the second time over its
    own old score columns) and read from the version that counts (S8)."""
    from tessera.operators.scoring import rewrite
    from tessera.plans.q_features import _score_cols
    from tessera.sources import io
    c = Ctx(spark, sf)
    base = io.scratch(spark, "dwh_scores")
    io.reload({"dim_beneficiaire": c.b.dim_beneficiaire.select("beneficiaire_id", "source_id", "cin", "tranche_age")}, base, "load")
    dim = spark.read.parquet(f"{io.current(spark, base)}/dim_beneficiaire")
    # joined by both rewrites: one row per beneficiary, computed once, kept (spilling to disk)
    scores = (_score_cols(c).persist(StorageLevel.MEMORY_AND_DISK), ["churn_probability", "churn_predicted", "churn_risk_segment"])
    offers = (_labelled(c), ["recommandation_offre_1", "recommandation_offre_2", "recommandation_offre_3", "secteur_recommande"])
    dim = rewrite(dim, [scores], "beneficiaire_id", base, "dim_beneficiaire", "scores")
    return plain(rewrite(dim, [scores, offers], "beneficiaire_id", base, "dim_beneficiaire", "recommendations"))
