"""Source/sink queries (S2-S7, S10, A10). Every written folder is a fresh one
under the cluster's shared checkpoint directory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.common import plain, plain_sql
from tessera.plans.context import Ctx
from tessera.plans.registry import query
from tessera.plans.sqlparts import with_ctes
from tessera.sources import io

# Staging schema of the beneficiary extract (all columns nullable).
STG_BENEFICIAIRE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("cin", T.StringType()), T.StructField("nom", T.StringType()),
    T.StructField("prenom", T.StringType()), T.StructField("genre", T.StringType()),
    T.StructField("date_naissance", T.DateType()), T.StructField("ville", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("email", T.StringType()),
    T.StructField("telephone", T.StringType()), T.StructField("nationalite", T.StringType()),
    T.StructField("type_statut", T.StringType()), T.StructField("en_situation_handicap", T.BooleanType()),
    T.StructField("date_inscription", T.DateType()), T.StructField("date_desactivation", T.DateType()),
    T.StructField("statut_pass", T.StringType()),
])

ORDERS_EXTRACT = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DecimalType(12, 2)),
    T.StructField("o_orderdate", T.DateType()), T.StructField("o_orderpriority", T.StringType()),
])

OFFER_RECORD = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("nom_partenaire", T.StringType()),
    T.StructField("categorie", T.StringType()), T.StructField("nom_offre", T.StringType()),
    T.StructField("type_avantage", T.StringType()), T.StructField("valeur_avantage", T.DecimalType(10, 2)),
    T.StructField("unite_avantage", T.StringType()), T.StructField("tarif_public", T.DecimalType(10, 2)),
    T.StructField("description", T.StringType()), T.StructField("conditions", T.StringType()),
    T.StructField("montant_a_debiter", T.DecimalType(10, 2)), T.StructField("montant_a_payer", T.DecimalType(10, 2)),
    T.StructField("solde_initial", T.DecimalType(10, 2)), T.StructField("solde_mensuel", T.DecimalType(10, 2)),
    T.StructField("ville", T.StringType()), T.StructField("region", T.StringType()),
])


@query("q_stage_copy", plain_sql(with_ctes("""
SELECT id, cin, nom, prenom, genre, date_naissance, ville, region, CAST(NULL AS VARCHAR) AS email,
       CAST(NULL AS VARCHAR) AS telephone, nationalite, type_statut, en_situation_handicap, date_inscription,
       CAST(NULL AS DATE) AS date_desactivation, statut_pass
FROM b_benef"""), "date_naissance:s,date_inscription:s,date_desactivation:s"))
def q_stage_copy(spark, sf):
    """Staging snapshot: explicit schema, columns by name, overwrite, read back."""
    b = Ctx(spark, sf).stg.beneficiaire()
    return plain(io.stage(b, io.scratch(spark, "stage_beneficiaire"), STG_BENEFICIAIRE))


@query("q_ingest_reject", with_ctes("""
SELECT CAST(count(*) AS BIGINT) AS n_good, CAST(0 AS BIGINT) AS n_rejected, CAST(1 AS BIGINT) AS min_id,
       CAST(count(*) AS BIGINT) AS max_id, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_keys
FROM orders"""))
def q_ingest_reject(spark, sf):
    """Bulk extract ingestion with bad-record capture and position ids (S3):
    the orders are exported as a CSV extract and read back permissively."""
    o = Ctx(spark, sf).stg.t["orders"].select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)"),
        F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    path = io.scratch(spark, "extract_orders")
    o.write.option("header", True).csv(path)
    good, bad = io.ingest(spark, path, ORDERS_EXTRACT, fmt="csv", header=True)
    g = good.agg(F.count(F.lit(1)).alias("n_good"), F.min("id").alias("min_id"), F.max("id").alias("max_id"),
                 F.count_distinct("o_orderkey").alias("n_keys"))
    n_rejected = bad.agg(F.count(F.lit(1))).scalar()
    return g.select("n_good", n_rejected.alias("n_rejected"), "min_id", "max_id", "n_keys")


@query("q_offer_catalog", plain_sql(with_ctes("""
SELECT id, nom_partenaire, categorie, nom_offre, type_avantage, valeur_avantage, unite_avantage, tarif_public, description,
       conditions, montant_a_debiter, montant_a_payer, solde_initial, solde_mensuel, ville, region, true AS actif
FROM b_offre"""), "valeur_avantage:d,tarif_public:d,montant_a_debiter:d,montant_a_payer:d,solde_initial:d,solde_mensuel:d"))
def q_offer_catalog(spark, sf):
    """Offer catalogue load from JSON records; absent keys read as NULL and
    every loaded offer is active (S4)."""
    off = Ctx(spark, sf).stg.offre().drop("actif", "tarif_pass_jeunes_txt")
    path = io.scratch(spark, "offer_catalog")
    off.write.json(path)  # NULL fields are omitted from the records
    cat = io.scan(spark, path, OFFER_RECORD, fmt="json")
    return plain(cat.withColumn("actif", F.lit(True)))


@query("q_catalog_counts", with_ctes("""
SELECT 'par_categorie' AS report, lower(categorie) AS cle, CAST(count(*) AS BIGINT) AS n FROM b_offre GROUP BY 2
UNION ALL
SELECT 'par_partenaire', cle, n FROM (
  SELECT lower(coalesce(nom_partenaire, 'Non precise')) AS cle, CAST(count(*) AS BIGINT) AS n FROM b_offre
  GROUP BY 1 ORDER BY n DESC, cle LIMIT 15) t
UNION ALL
SELECT 'nouvelles_par_categorie', lower(categorie), CAST(count(*) AS BIGINT) FROM b_offre WHERE actif GROUP BY 2"""))
def q_catalog_counts(spark, sf):
    """CSV report over the catalogue in a legacy encoding: counts by category,
    top 15 partners, counts of new offers by category; grouping ignores case (S5, A10)."""
    off = Ctx(spark, sf).stg.offre().select(
        F.col("categorie").alias("Categorie"),
        F.coalesce("nom_partenaire", F.lit("Non precise")).alias("Partenaire"),
        F.when(F.col("actif"), F.lit("nouveau.csv")).otherwise(F.lit("N/A")).alias("Fichier_Source"))
    path = io.scratch(spark, "offers_csv")
    io.csv_with_encoding(spark, "windows-1252")
    off.write.option("header", True).option("encoding", "windows-1252").csv(path)
    csv = io.read_csv(spark, path, "Categorie string, Partenaire string, Fichier_Source string", "windows-1252")
    by_cat = csv.groupBy(F.lower("Categorie").alias("cle")).agg(F.count(F.lit(1)).alias("n"))
    by_partner = (csv.groupBy(F.lower("Partenaire").alias("cle")).agg(F.count(F.lit(1)).alias("n"))
                  .orderBy(F.col("n").desc(), F.col("cle")).limit(15))
    new = (csv.filter(F.col("Fichier_Source") != "N/A").groupBy(F.lower("Categorie").alias("cle"))
           .agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, [
        by_cat.select(F.lit("par_categorie").alias("report"), "cle", "n"),
        by_partner.select(F.lit("par_partenaire").alias("report"), "cle", "n"),
        new.select(F.lit("nouvelles_par_categorie").alias("report"), "cle", "n")])


@query("q_sink_roundtrip", with_ctes("""
SELECT CAST(temps_id / 10000 AS BIGINT) AS annee, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(montant_reduction) AS DOUBLE) AS montant
FROM fops_a WHERE temps_id >= 20000101 GROUP BY 1"""))
def q_sink_roundtrip(spark, sf):
    """Fact sink partitioned by year; reading back with a year filter prunes
    partitions (S6)."""
    f = Ctx(spark, sf).a.fait_operations().withColumn("annee", F.floor(F.col("temps_id") / 10000).cast("int"))
    path = io.scratch(spark, "fait_operations")
    io.sink(f, path, ["annee"])
    back = spark.read.parquet(path).filter(F.col("annee") >= 2000)
    return back.groupBy(F.col("annee").cast("long").alias("annee")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("montant_reduction").cast("double").alias("montant"))


@query("q_reload_idempotent", with_ctes("""
SELECT 'dim_region' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, true AS same_as_previous FROM dim_region_a
UNION ALL SELECT 'dim_offre', CAST(count(*) AS BIGINT), true FROM dim_offre
UNION ALL SELECT 'fait_operations', CAST(count(*) AS BIGINT), true FROM fops_a"""))
def q_reload_idempotent(spark, sf):
    """Clear-and-reload twice (write new version, swap pointer); the second
    load equals the first (S7)."""
    s = Ctx(spark, sf).a
    tables = {"dim_region": s.dim_region, "dim_offre": s.dim_offre, "fait_operations": s.fait_operations()}
    base = io.scratch(spark, "dwh")
    first = io.reload(tables, base, "run1")
    second = io.reload(tables, base, "run2")
    assert io.current(spark, base) == second
    rows = []
    for name in tables:
        a = spark.read.parquet(f"{first}/{name}")
        b = spark.read.parquet(f"{io.current(spark, base)}/{name}")
        same = a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        rows.append(b.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
                          F.lit(same).alias("same_as_previous")))
    return reduce(DataFrame.unionByName, rows)


@query("q_etl_log", with_ctes("""
SELECT 'dim_region' AS nom_table, 'staging' AS source, CAST(count(*) AS BIGINT) AS nb_lignes_source,
       CAST(count(*) AS BIGINT) AS nb_lignes_insert, 'OK' AS statut, CAST(1 AS BIGINT) AS n FROM dim_region_a
UNION ALL SELECT 'fait_motatawi3', 'staging', (SELECT CAST(count(*) AS BIGINT) FROM b_motatawi3), CAST(count(*) AS BIGINT), 'OK', 2 FROM fmot_a
UNION ALL SELECT 'fait_motatawi3', 'staging', (SELECT CAST(count(*) AS BIGINT) FROM b_motatawi3), CAST(count(*) AS BIGINT), 'OK', 3 FROM fmot_a"""))
def q_etl_log(spark, sf):
    """Load audit log, accumulated over three loads; every frame is computed once."""
    c = Ctx(spark, sf)
    s, base = c.a, io.scratch(spark, "dwh_logged")
    io.observed_sink(s.dim_region, f"{base}/dim_region", "dim_region", "staging", log_base=base)
    for _ in range(2):
        io.observed_sink(s.fait_motatawi3(), f"{base}/fait_motatawi3", "fait_motatawi3", "staging", source_rows=c.stg.motatawi3(), log_base=base)
    return io.read_log(spark, base).select("nom_table", "source", "nb_lignes_source", "nb_lignes_insert", "statut", "n")


@query("q_keys_after_reload", """
WITH one AS (SELECT c_custkey AS source_id, row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 3 <> 0),
two AS (SELECT c_custkey AS source_id, (SELECT max(k) FROM one) + row_number() OVER (ORDER BY c_custkey) AS k FROM customer WHERE c_custkey % 3 = 0)
SELECT source_id, CAST(k AS BIGINT) AS beneficiaire_id, source_id % 3 <> 0 AS first_load FROM (SELECT * FROM one UNION ALL SELECT * FROM two) t""")
def q_keys_after_reload(spark, sf):
    """A second load with earlier ids inserted: old keys stay, new ids follow the highest key (W1, W2: IDENTITY)."""
    ids = Ctx(spark, sf).stg.t["customer"].select(F.col("c_custkey").alias("source_id"))
    base = io.scratch(spark, "keys")
    io.load_keys(spark, ids.where(F.col("source_id") % 3 != 0), base, "source_id", "beneficiaire_id")
    keys = io.load_keys(spark, ids, base, "source_id", "beneficiaire_id")
    return keys.withColumn("first_load", F.col("source_id") % 3 != 0)


@query("q_bucketed_profile", with_ctes("""
SELECT b.beneficiaire_id, b.genre, coalesce(o.n, 0) AS nb_operations, coalesce(o.montant, 0) AS montant_reduction,
       coalesce(s.credit, 0) AS credit_initial
FROM dim_benef_a b
LEFT JOIN (SELECT beneficiaire_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(montant_reduction) AS DOUBLE) AS montant FROM fops_a GROUP BY 1) o
  ON o.beneficiaire_id = b.beneficiaire_id
LEFT JOIN (SELECT beneficiaire_id, CAST(sum(credit_initial) AS DOUBLE) AS credit FROM fsolde_a GROUP BY 1) s ON s.beneficiaire_id = b.beneficiaire_id"""))
def q_bucketed_profile(spark, sf):
    """Operations and balances per beneficiary out of bucketed tables: neither join nor aggregate shuffles."""
    return bucketed_profile(star_tables(Ctx(spark, sf).a))


def star_tables(star, buckets: int | None = None) -> dict[str, DataFrame]:
    """The beneficiary dimension and its facts as tables bucketed by their common key, in a fresh shared folder."""
    spark = star.stg.spark
    base = io.scratch(spark, "bucketed")
    tag = base.rsplit("-", 1)[1]
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    frames = {"dim_beneficiaire": star.dim_beneficiaire, "fait_operations": star.fait_operations(), "fait_solde": star.fait_solde()}
    return {n: io.bucketed(df, f"{n}_{tag}", "beneficiaire_id", buckets, base) for n, df in frames.items()}


def bucketed_profile(t: dict[str, DataFrame]) -> DataFrame:
    key = "beneficiaire_id"
    ops = t["fait_operations"].groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("montant_reduction").cast("double").alias("montant"))
    solde = t["fait_solde"].groupBy(key).agg(F.sum("credit_initial").cast("double").alias("credit"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (t["dim_beneficiaire"].select(key, "genre").join(ops.hint("merge"), key, "left").join(solde.hint("merge"), key, "left")
            .select(key, "genre", zero("n").alias("nb_operations"), zero("montant").alias("montant_reduction"), zero("credit").alias("credit_initial")))
