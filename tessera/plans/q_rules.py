"""Business-rule queries taken from the source simulator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import benefit_amount, exact_age, pass_expiry, pass_status, resolve_city
from tessera.plans.common import plain, plain_sql
from tessera.plans.context import Ctx
from tessera.plans.registry import query
from tessera.plans.sqlparts import AS_OF_SQL, exact_age as sql_exact_age, with_ctes
from tessera.sources.bindings import AS_OF


@query("q_pass_expiry", plain_sql(with_ctes(
    "SELECT id, date_naissance, CAST(date_naissance + INTERVAL 30 YEAR AS DATE) AS date_expiration FROM b_benef"),
    "date_naissance:s,date_expiration:s"))
def q_pass_expiry(spark, sf):
    """Pass expiry = birth date + 30 years, 29 February -> 28 February (L1)."""
    b = Ctx(spark, sf).stg.beneficiaire()
    return plain(b.select("id", "date_naissance", pass_expiry(F.col("date_naissance")).alias("date_expiration")))


@query("q_exact_age", with_ctes(f"""
SELECT id, CAST({sql_exact_age('date_naissance', AS_OF_SQL)} AS BIGINT) AS age_as_of,
       CAST({sql_exact_age('date_naissance', 'date_inscription')} AS BIGINT) AS age_inscription
FROM b_benef"""))
def q_exact_age(spark, sf):
    """Completed years at the as-of date and at registration (L2)."""
    b = Ctx(spark, sf).stg.beneficiaire()
    return plain(b.select("id", exact_age(F.col("date_naissance"), F.lit(AS_OF)).alias("age_as_of"),
                          exact_age(F.col("date_naissance"), F.col("date_inscription")).alias("age_inscription")))


@query("q_pass_status", with_ctes(f"""
SELECT id, CASE WHEN {sql_exact_age('date_naissance', AS_OF_SQL)} <= 30 THEN 'Actif' ELSE 'Desactive' END AS statut_pass,
       count(*) OVER (PARTITION BY CASE WHEN {sql_exact_age('date_naissance', AS_OF_SQL)} <= 30 THEN 'Actif'
                                        ELSE 'Desactive' END) AS n_same_status
FROM b_benef"""))
def q_pass_status(spark, sf):
    """Pass status by exact age at the as-of date, with the size of each status (L3)."""
    b = Ctx(spark, sf).stg.beneficiaire().select(
        "id", pass_status(F.col("date_naissance"), F.lit(AS_OF)).alias("statut_pass"))
    n = b.groupBy("statut_pass").agg(F.count(F.lit(1)).alias("n_same_status"))
    return b.join(F.broadcast(n), "statut_pass").select("id", "statut_pass", "n_same_status")


@query("q_volunteer_eligible", with_ctes(f"""
SELECT m.id, m.beneficiaire_id, CAST({sql_exact_age('b.date_naissance', 'm.date_inscription')} AS BIGINT) AS age,
       b.statut_pass,
       ({sql_exact_age('b.date_naissance', 'm.date_inscription')} BETWEEN 18 AND 22 AND b.statut_pass = 'Actif')
         AS eligible
FROM b_motatawi3 m JOIN b_benef b ON b.id = m.beneficiaire_id"""))
def q_volunteer_eligible(spark, sf):
    """Volunteering eligibility: age 18-22 at registration and an active pass (L4)."""
    s = Ctx(spark, sf).stg
    b = s.beneficiaire().select(F.col("id").alias("_bid"), "date_naissance", "statut_pass")
    m = s.motatawi3().join(b, F.col("beneficiaire_id") == F.col("_bid"))
    age = exact_age(F.col("date_naissance"), F.col("date_inscription"))
    return plain(m.select("id", "beneficiaire_id", age.alias("age"), "statut_pass",
                          (age.between(18, 22) & (F.col("statut_pass") == "Actif")).alias("eligible")))


@query("q_benefit_amount", plain_sql(with_ctes("""
SELECT source_id, type_avantage, valeur_avantage, tarif_public,
       CASE WHEN type_avantage = 'Gratuite' THEN CAST(0 AS DECIMAL(10,2))
            WHEN type_avantage = 'Tarif fixe' THEN CAST(valeur_avantage AS DECIMAL(10,2))
            ELSE CAST(CAST(tarif_public AS DECIMAL(12,2)) * CAST(valeur_avantage AS DECIMAL(10,2)) / 100 AS DECIMAL(10,2))
       END AS montant_avantage
FROM dim_offre"""), "valeur_avantage:d,tarif_public:d,montant_avantage:d"))
def q_benefit_amount(spark, sf):
    """Benefit amount: free -> 0, fixed -> value, percentage -> price x value / 100."""
    o = Ctx(spark, sf).a.dim_offre
    return plain(o.select("source_id", "type_avantage", "valeur_avantage", "tarif_public",
                          benefit_amount(F.col("type_avantage"), F.col("valeur_avantage"),
                                         F.col("tarif_public")).alias("montant_avantage")))


@query("q_resolve_city", with_ctes("""
SELECT o.src_order, o.src_line, o.offre_id, f.ville AS ville_offre, b.ville AS ville_beneficiaire,
       CASE WHEN f.ville IN ('National', 'Multi-villes', 'Tout le Maroc') THEN b.ville ELSE f.ville END AS ville_resolue
FROM b_operation o JOIN b_offre f ON f.id = o.offre_id JOIN b_benef b ON b.id = o.beneficiaire_id"""))
def q_resolve_city(spark, sf):
    """Placeholder offer cities resolved to the beneficiary's city."""
    s = Ctx(spark, sf).stg
    f = (s.offre().select(F.col("id").alias("_oid"), F.col("ville").alias("ville_offre")))
    b = s.beneficiaire().select(F.col("id").alias("_bid"), F.col("ville").alias("ville_beneficiaire"))
    o = (s.operation().join(f, F.col("offre_id") == F.col("_oid"))
         .join(b, F.col("beneficiaire_id") == F.col("_bid")))
    return o.select("src_order", "src_line", "offre_id", "ville_offre", "ville_beneficiaire",
                    resolve_city(F.col("ville_offre"), F.col("ville_beneficiaire")).alias("ville_resolue"))


@query("q_balance_years", with_ctes(f"""
SELECT b.id AS beneficiaire_id, CAST(y.annee AS BIGINT) AS annee
FROM b_benef b JOIN (SELECT DISTINCT year(date_operation) AS annee FROM b_operation) y
  ON y.annee >= year(b.date_inscription) AND y.annee <= year({AS_OF_SQL})
WHERE b.statut_pass = 'Actif'"""))
def q_balance_years(spark, sf):
    """Balance years: active passes only, from the registration year.

    A beneficiary expands to the sequence of its years; those with operations stay (a semi join on the year, whose
    other side is a row per year)."""
    s = Ctx(spark, sf).stg
    years = s.operation().select(F.year("date_operation").alias("annee")).distinct()
    b = s.beneficiaire().filter((F.col("statut_pass") == "Actif") & (F.year("date_inscription") <= AS_OF.year))
    every = b.select(F.col("id").alias("beneficiaire_id"), F.explode(F.sequence(F.year("date_inscription"), F.lit(AS_OF.year))).alias("annee"))
    return plain(every.join(years, "annee", "left_semi").select("beneficiaire_id", "annee"))


@query("q_operation_balance", plain_sql(with_ctes("""
SELECT o.src_order, o.src_line, o.beneficiaire_id, o.offre_id, year(o.date_operation) AS annee,
       s.credit_initial, s.credit_restant
FROM b_operation o LEFT JOIN b_solde s ON s.beneficiaire_id = o.beneficiaire_id AND s.offre_id = o.offre_id
  AND s.annee = year(o.date_operation)"""), "src_line:i,annee:i,credit_initial:d,credit_restant:d"))
def q_operation_balance(spark, sf):
    """Each operation with its balance of (beneficiary, offer, year)."""
    s = Ctx(spark, sf).stg
    o = s.operation().withColumn("annee", F.year("date_operation"))
    sol = s.solde().select("beneficiaire_id", "offre_id", "annee", "credit_initial", "credit_restant")
    return plain(o.join(sol, ["beneficiaire_id", "offre_id", "annee"], "left")
                 .select("src_order", "src_line", "beneficiaire_id", "offre_id", "annee", "credit_initial",
                         "credit_restant"))
