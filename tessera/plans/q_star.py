"""Queries over the star: calendar, dimensions, facts, measures, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.calendar import calendar_spanning
from tessera.functions.columns import city_country, date_key, normalize_name
from tessera.operators.keys import with_surrogate
from tessera.operators.measures import star_model
from tessera.plans.common import plain, plain_sql
from tessera.plans.context import Ctx
from tessera.plans.registry import query
from tessera.plans.sqlparts import calendar_select, with_ctes
from tessera.plans.sqlparts import date_key as sql_date_key

# ---- calendar ------------------------------------------------------------------

_CAL_SPAN = calendar_select(
    "(SELECT CAST(g AS DATE) AS dc FROM (SELECT min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) AS e "
    "FROM orders) b, generate_series(make_date(year(b.s), 1, 1), make_date(year(b.e), 12, 31) + INTERVAL 1 DAY, "
    "INTERVAL 1 DAY) t(g)) sp")


@query("q_dim_temps", plain_sql(_CAL_SPAN, "temps_id:i,date_complete:s,jour:i,mois:i,annee:i,trimestre:i,"
                                            "jour_semaine:i,semaine_annee:i"))
def q_dim_temps(spark, sf):
    """Calendar spanning the order dates."""
    return plain(calendar_spanning(Ctx(spark, sf).stg.t["orders"], "o_orderdate"))


@query("q_date_key", f"SELECT o_orderkey, {sql_date_key('o_orderdate')}::BIGINT AS temps_id FROM orders")
def q_date_key(spark, sf):
    o = Ctx(spark, sf).stg.t["orders"]
    return plain(o.select("o_orderkey", date_key(F.to_date("o_orderdate")).alias("temps_id")))


# ---- dimensions ----------------------------------------------------------------

for _r in ("a", "b"):
    def _mk_region(r):
        def q_dim_region(spark, sf):
            return plain(Ctx(spark, sf).star(r).dim_region)
        return q_dim_region

    def _mk_benef(r):
        def q_dim_beneficiaire(spark, sf):
            return plain(Ctx(spark, sf).star(r).dim_beneficiaire)
        return q_dim_beneficiaire

    query(f"q_dim_region_{_r}", with_ctes(f"SELECT * FROM dim_region_{_r}"))(_mk_region(_r))
    query(f"q_dim_beneficiaire_{_r}", plain_sql(with_ctes(f"SELECT * FROM dim_benef_{_r}"),
                                                "date_naissance:s,date_inscription:s"))(_mk_benef(_r))


@query("q_dim_offre", plain_sql(with_ctes("SELECT * FROM dim_offre"),
                                "valeur_avantage:d,tarif_pass_jeunes:d,tarif_public:d,montant_a_debiter:d,montant_a_payer:d,"
                                "solde_initial:d,solde_mensuel:d"))
def q_dim_offre(spark, sf):
    return plain(Ctx(spark, sf).a.dim_offre)


@query("q_try_cast_price", plain_sql(with_ctes(
    "SELECT source_id, tarif_pass_jeunes_txt, tarif_pass_jeunes FROM dim_offre "
    "JOIN b_offre ON id = source_id"), "tarif_pass_jeunes:d"))
def q_try_cast_price(spark, sf):
    """Text price read with try_cast: non-numeric text becomes NULL."""
    c = Ctx(spark, sf)
    o = c.stg.offre().select(F.col("id").alias("source_id"), "tarif_pass_jeunes_txt")
    return plain(c.a.dim_offre.select("source_id", "tarif_pass_jeunes").join(o, "source_id"))


@query("q_dim_association", plain_sql(with_ctes("SELECT * FROM dim_association"), "nb_membres:i,date_creation:s"))
def q_dim_association(spark, sf):
    return plain(Ctx(spark, sf).a.dim_association)


@query("q_dim_maison", plain_sql(with_ctes("SELECT * FROM dim_maison"), "capacite_accueil:i,date_ouverture:s"))
def q_dim_maison(spark, sf):
    return plain(Ctx(spark, sf).a.dim_maison)


@query("q_city_country", with_ctes("SELECT region_id, ville || ', Morocco' AS ville_pays FROM dim_region_b"))
def q_city_country(spark, sf):
    r = Ctx(spark, sf).b.dim_region
    return plain(r.select("region_id", city_country(F.col("ville")).alias("ville_pays")))


@query("q_region_normalize", with_ctes(
    "SELECT lower(strip_accents(rtrim(region))) AS region_key, count(DISTINCT region) AS n_spellings, "
    "count(*) AS n_rows FROM dim_region_b GROUP BY 1"))
def q_region_normalize(spark, sf):
    """Accent/case-insensitive region key and how many spellings fold into it (P20)."""
    r = Ctx(spark, sf).b.dim_region
    return plain(r.groupBy(normalize_name(F.col("region")).alias("region_key"))
                 .agg(F.count_distinct("region").alias("n_spellings"), F.count(F.lit(1)).alias("n_rows")))


# ---- facts -----------------------------------------------------------------------

_FOPS = "montant_reduction:d,nb_operations:i,temps_id:i"
for _key, _r, _compat in (("a", "a", False), ("b", "b", True), ("compat", "a", True), ("strict", "b", False)):
    def _mk_ops(r, compat):
        def q_fait_operations(spark, sf):
            return plain(Ctx(spark, sf).star(r).fait_operations(compat=compat))
        return q_fait_operations
    _cte = f"fops_{_r}{'_compat' if _compat else ''}"
    query(f"q_fait_operations_{_key}", plain_sql(with_ctes(f"SELECT * FROM {_cte}"), _FOPS))(_mk_ops(_r, _compat))

for _key, _r, _compat in (("a", "a", False), ("compat", "a", True), ("strict", "b", False)):
    def _mk_mot(r, compat):
        def q_fait_motatawi3(spark, sf):
            return plain(Ctx(spark, sf).star(r).fait_motatawi3(compat=compat))
        return q_fait_motatawi3
    _cte = f"fmot_{_r}{'_compat' if _compat else ''}"
    query(f"q_fait_motatawi3_{_key}", plain_sql(with_ctes(f"SELECT * FROM {_cte}"), "temps_id:i"))(_mk_mot(_r, _compat))

for _r in ("a", "b"):
    def _mk_act(r):
        def q_fait_activites(spark, sf):
            return plain(Ctx(spark, sf).star(r).fait_activites())
        return q_fait_activites
    query(f"q_fait_activites_{_r}", plain_sql(with_ctes(f"SELECT * FROM fact_{_r}"),
                                              "temps_id:i,budget:d,nb_participants:i,taux_satisfaction:d,"
                                              "budget_consomme:d,duree_jours:i"))(_mk_act(_r))


@query("q_fait_solde", plain_sql(with_ctes("SELECT * FROM fsolde_a"),
                                 "temps_id:i,annee:i,credit_initial:d,credit_restant:d,credit_consomme:d"))
def q_fait_solde(spark, sf):
    return plain(Ctx(spark, sf).a.fait_solde())


@query("q_fact_surrogate", plain_sql(with_ctes(
    "SELECT CAST(row_number() OVER (ORDER BY beneficiaire_id, offre_id, annee) AS BIGINT) AS solde_id, * FROM fsolde_a"),
    "temps_id:i,annee:i,credit_initial:d,credit_restant:d,credit_consomme:d"))
def q_fact_surrogate(spark, sf):
    """Dense fact keys without a single-partition window."""
    f = Ctx(spark, sf).a.fait_solde()
    return plain(with_surrogate(f, ["beneficiaire_id", "offre_id", "annee"], "solde_id"))


@query("q_scan_star", plain_sql(with_ctes("""
SELECT f.beneficiaire_id, f.montant_reduction, f.nb_operations, f.offre_id, t.date_complete, t.mois, t.annee,
       t.trimestre, t.est_weekend, t.jour_semaine, r.region, o.secteur, o.categorie, o.type_avantage
FROM fops_a f JOIN dim_temps t ON f.temps_id = t.temps_id JOIN dim_region_a r ON f.region_id = r.region_id
JOIN dim_offre o ON f.offre_id = o.offre_id"""), "montant_reduction:d,nb_operations:i,date_complete:s,mois:i,annee:i,"
                                                   "trimestre:i,jour_semaine:i"))
def q_scan_star(spark, sf):
    """Star extract: operations with calendar, region and offer attributes."""
    return plain(_ops_extract(Ctx(spark, sf).a))


def _ops_extract(star):
    f = star.fait_operations()
    t = F.broadcast(star.dim_temps.select("temps_id", "date_complete", "mois", "annee", "trimestre",
                                          "est_weekend", "jour_semaine"))
    r = (star.dim_region.select("region_id", "region"))
    o = (star.dim_offre.select("offre_id", "secteur", "categorie", "type_avantage"))
    return (f.join(t, "temps_id").join(r, "region_id").join(o, "offre_id")
            .select("beneficiaire_id", "montant_reduction", "nb_operations", "offre_id", "date_complete", "mois",
                    "annee", "trimestre", "est_weekend", "jour_semaine", "region", "secteur", "categorie",
                    "type_avantage"))


# ---- measures --------------------------------------------------------------------

@query("q_measures_operations", plain_sql(with_ctes("""
SELECT t.annee, r.region, count(*) AS Total_Operations, sum(f.montant_reduction) AS Montant_Total_Reductions,
       count(DISTINCT f.beneficiaire_id) AS Nb_Beneficiaires_Actifs,
       CAST(sum(f.montant_reduction) AS DOUBLE) / count(f.montant_reduction) AS Montant_Moyen_Reduction
FROM fops_b f LEFT JOIN dim_temps t ON f.temps_id = t.temps_id LEFT JOIN dim_region_b r ON f.region_id = r.region_id
GROUP BY t.annee, r.region"""), "annee:i,Total_Operations:i,Montant_Total_Reductions:d,Nb_Beneficiaires_Actifs:i"))
def q_measures_operations(spark, sf):
    """Operation measures by year and region on the strict rule-B star (H1-H4)."""
    m = star_model(Ctx(spark, sf).b)
    return plain(m.query("operations", ["Total_Operations", "Montant_Total_Reductions", "Nb_Beneficiaires_Actifs",
                                        "Montant_Moyen_Reduction"], by=["annee", "region"]))


@query("q_measures_solde", plain_sql(with_ctes("""
SELECT t.annee, o.secteur, sum(credit_initial) AS Credit_Initial_Total, sum(credit_restant) AS Credit_Restant_Total,
       sum(credit_initial) - sum(credit_restant) AS Credit_Consomme_Total,
       coalesce(CAST(sum(credit_initial) - sum(credit_restant) AS DOUBLE) / nullif(CAST(sum(credit_initial) AS DOUBLE), 0), 0)
         AS Taux_Utilisation_Credit
FROM fsolde_a f LEFT JOIN dim_temps t ON f.temps_id = t.temps_id LEFT JOIN dim_offre o ON f.offre_id = o.offre_id
GROUP BY t.annee, o.secteur"""), "annee:i,Credit_Initial_Total:d,Credit_Restant_Total:d,Credit_Consomme_Total:d"))
def q_measures_solde(spark, sf):
    """Balance measures by year and sector, DIVIDE with alternate 0."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.query("solde", ["Credit_Initial_Total", "Credit_Restant_Total", "Credit_Consomme_Total",
                                   "Taux_Utilisation_Credit"], by=["annee", "secteur"]))


@query("q_measures_activites", plain_sql(with_ctes("""
SELECT r.zone_geo, t.annee, count(*) AS Total_Activites, sum(budget) AS Budget_Total_Activites,
       sum(budget_consomme) AS Budget_Consomme_Activites,
       CAST(sum(taux_satisfaction) AS DOUBLE) / count(taux_satisfaction) AS Satisfaction_Moyenne,
       sum(nb_participants) AS Total_Participants,
       CAST(sum(duree_jours) AS DOUBLE) / count(duree_jours) AS Duree_Moyenne_Jours
FROM fact_a f LEFT JOIN dim_temps t ON f.temps_id = t.temps_id LEFT JOIN dim_region_a r ON f.region_id = r.region_id
GROUP BY r.zone_geo, t.annee"""), "annee:i,Total_Activites:i,Budget_Total_Activites:d,Budget_Consomme_Activites:d,"
                                  "Total_Participants:i"))
def q_measures_activites(spark, sf):
    """Activity measures by zone and year (H8)."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.query("activites", ["Total_Activites", "Budget_Total_Activites", "Budget_Consomme_Activites",
                                       "Satisfaction_Moyenne", "Total_Participants", "Duree_Moyenne_Jours"],
                         by=["zone_geo", "annee"]))


@query("q_measures_volontaires", plain_sql(with_ctes("""
SELECT r.region, f.domaine_volontariat, count(*) AS Total_Volontaires
FROM fmot_a f LEFT JOIN dim_region_a r ON f.region_id = r.region_id
GROUP BY r.region, f.domaine_volontariat"""), "Total_Volontaires:i"))
def q_measures_volontaires(spark, sf):
    """Volunteer count by region and domain (H9); the default calendar key is not in the calendar."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.query("motatawi3", ["Total_Volontaires"], by=["region", "domaine_volontariat"]))


@query("q_measures_solde_profil", plain_sql(with_ctes("""
SELECT b.genre, b.tranche_age, sum(credit_initial) AS Credit_Initial_Total,
       sum(credit_initial) - sum(credit_restant) AS Credit_Consomme_Total
FROM fsolde_a f LEFT JOIN dim_benef_a b ON f.beneficiaire_id = b.beneficiaire_id
GROUP BY b.genre, b.tranche_age"""), "Credit_Initial_Total:d,Credit_Consomme_Total:d"))
def q_measures_solde_profil(spark, sf):
    """Balance measures by the beneficiary's profile (H5, J17 balances -> beneficiaries)."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.query("solde", ["Credit_Initial_Total", "Credit_Consomme_Total"], by=["genre", "tranche_age"]))


@query("q_measures_activites_lieu", plain_sql(with_ctes("""
SELECT a.domaine_activite, m.nom AS maison, count(*) AS Total_Activites, sum(f.budget) AS Budget_Total_Activites
FROM fact_a f LEFT JOIN dim_association a ON f.association_id = a.association_id
LEFT JOIN dim_maison m ON f.maison_id = m.maison_id
GROUP BY a.domaine_activite, m.nom"""), "Total_Activites:i,Budget_Total_Activites:d"))
def q_measures_activites_lieu(spark, sf):
    """Activity measures by the association's domain and the house (H8, J17 activities -> associations, houses)."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.query("activites", ["Total_Activites", "Budget_Total_Activites"], by=["domaine_activite", "maison"]))


@query("q_measures_volontaires_profil", plain_sql(with_ctes("""
SELECT b.genre, b.tranche_age, count(*) AS Total_Volontaires
FROM fmot_a f LEFT JOIN dim_benef_a b ON f.beneficiaire_id = b.beneficiaire_id
GROUP BY b.genre, b.tranche_age"""), "Total_Volontaires:i"))
def q_measures_volontaires_profil(spark, sf):
    """Volunteer count by the beneficiary's profile (H9, J17 volunteering -> beneficiaries)."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.query("motatawi3", ["Total_Volontaires"], by=["genre", "tranche_age"]))


@query("q_measures_engagement", plain_sql(with_ctes("""
SELECT tranche_age, count_if(est_membre_association) AS Nb_Beneficiaires_Membres_Associations,
       coalesce(CAST(count_if(est_membre_association) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0), 0)
         AS Taux_Engagement_Associatif
FROM dim_benef_b GROUP BY tranche_age"""), "Nb_Beneficiaires_Membres_Associations:i"))
def q_measures_engagement(spark, sf):
    """Membership count and rate by age band."""
    from tessera.operators.measures import MEASURES
    d = Ctx(spark, sf).b.dim_beneficiaire
    ms = MEASURES["beneficiaire"]
    return plain(d.groupBy("tranche_age").agg(
        ms["Nb_Beneficiaires_Membres_Associations"]().alias("Nb_Beneficiaires_Membres_Associations"),
        ms["Taux_Engagement_Associatif"]().alias("Taux_Engagement_Associatif")))


@query("q_rollup_calendar", plain_sql(with_ctes("""
SELECT t.annee, t.trimestre, t.mois, t.jour, GROUPING(t.annee, t.trimestre, t.mois, t.jour) AS niveau,
       count(*) AS Total_Operations, sum(f.montant_reduction) AS Montant_Total_Reductions,
       count(DISTINCT f.beneficiaire_id) AS Nb_Beneficiaires_Actifs
FROM fops_a f LEFT JOIN dim_temps t ON f.temps_id = t.temps_id
GROUP BY ROLLUP (t.annee, t.trimestre, t.mois, t.jour)"""),
    "annee:i,trimestre:i,mois:i,jour:i,niveau:i,Total_Operations:i,Montant_Total_Reductions:d,Nb_Beneficiaires_Actifs:i"))
def q_rollup_calendar(spark, sf):
    """Drill-down totals and distinct beneficiaries year > quarter > month > day."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.drill("operations", ["annee", "trimestre", "mois", "jour"],
                         ["Total_Operations", "Montant_Total_Reductions", "Nb_Beneficiaires_Actifs"]))


@query("q_rollup_geography", plain_sql(with_ctes("""
SELECT r.zone_geo, r.region, r.ville, GROUPING(r.zone_geo, r.region, r.ville) AS niveau,
       count(*) AS Total_Operations, sum(f.montant_reduction) AS Montant_Total_Reductions,
       count(DISTINCT f.beneficiaire_id) AS Nb_Beneficiaires_Actifs
FROM fops_a f LEFT JOIN dim_region_a r ON f.region_id = r.region_id
GROUP BY ROLLUP (r.zone_geo, r.region, r.ville)"""),
    "niveau:i,Total_Operations:i,Montant_Total_Reductions:d,Nb_Beneficiaires_Actifs:i"))
def q_rollup_geography(spark, sf):
    """Drill-down totals and distinct beneficiaries zone > region > city."""
    m = star_model(Ctx(spark, sf).a)
    return plain(m.drill("operations", ["zone_geo", "region", "ville"],
                         ["Total_Operations", "Montant_Total_Reductions", "Nb_Beneficiaires_Actifs"]))


@query("q_inscriptions_by_date", plain_sql(with_ctes("""
SELECT t.annee, t.mois, count(*) AS nb_inscriptions
FROM dim_benef_a b JOIN dim_temps t ON b.date_inscription = t.date_complete
GROUP BY t.annee, t.mois"""), "annee:i,mois:i,nb_inscriptions:i"))
def q_inscriptions_by_date(spark, sf):
    """Inactive relationship used on demand: registration date -> calendar."""
    s = Ctx(spark, sf).a
    cal = F.broadcast(s.dim_temps.select("date_complete", "annee", "mois"))
    b = s.dim_beneficiaire
    return plain(b.join(cal, b.date_inscription == cal.date_complete)
                 .groupBy("annee", "mois").agg(F.count(F.lit(1)).alias("nb_inscriptions")))
