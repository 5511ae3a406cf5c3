"""Dimension builders.

``rules`` selects the loading path: "a" (script load) or "b" (package load);
the two disagree on age bands, zones and the region source list, and both
are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import age_band, zone
from tessera.operators.keys import with_row_number, with_surrogate


def region_pairs(sources: list[DataFrame], rules: str = "a") -> DataFrame:
    """Distinct (ville, region) of several sources.

    Rule A keeps rows with both ville and region non-NULL; rule B keeps rows
    whose ville is neither NULL nor '' (a NULL region passes)."""
    def keep(df):
        df = df.select("ville", "region")
        if rules == "a":
            return df.filter(F.col("ville").isNotNull() & F.col("region").isNotNull())
        return df.filter(F.col("ville").isNotNull() & (F.col("ville") != ""))
    return reduce(DataFrame.union, [keep(s) for s in sources]).distinct()


def dim_region(sources: list[DataFrame], rules: str = "a") -> DataFrame:
    """dim_region(region_id, ville, region, zone_geo); ids by (ville, region)."""
    pairs = region_pairs(sources, rules).withColumn("zone_geo", zone(F.col("region"), rules))
    # bounded: one row per distinct (city, region) of the country
    return with_row_number(pairs, ["ville", "region"], "region_id").select("region_id", "ville", "region", "zone_geo")


def membership(persons: DataFrame) -> DataFrame:
    """Distinct non-NULL national ids of association members (J11, G9 mirror form)."""
    return persons.filter(F.col("jeune_cin").isNotNull()).select(F.col("jeune_cin").alias("cin")).distinct()


def dim_beneficiaire(stg: DataFrame, as_of, rules: str = "a", members: DataFrame | None = None,
                     load_ts=None, keys: DataFrame | None = None) -> DataFrame:
    """dim_beneficiaire with age band by rule set and the membership flag.

    The surrogate is W2 (the table grows with the population) over the ids alone (``beneficiaire_keys``); the
    attributes are joined to it, so that who needs only the keys never reads them."""
    df = stg.select(
        F.col("id").alias("source_id"), "cin", "nom", "prenom", "genre", "date_naissance",
        "nationalite", "type_statut", "en_situation_handicap", "statut_pass",
        age_band(F.col("date_naissance"), F.lit(as_of), rules).alias("tranche_age"),
        "date_inscription",
    )
    if members is not None:
        m = membership(members).withColumn("_m", F.lit(True))
        df = df.join(m, "cin", "left").withColumn("est_membre_association", F.coalesce("_m", F.lit(False))).drop("_m")
    else:
        df = df.withColumn("est_membre_association", F.lit(False))
    if load_ts is not None:
        df = df.withColumn("date_chargement", F.lit(load_ts).cast("timestamp"))
    return df.join(keys if keys is not None else beneficiaire_keys(stg), "source_id")


def beneficiaire_keys(stg: DataFrame) -> DataFrame:
    """(source_id, beneficiaire_id)."""
    return with_surrogate(stg.select(F.col("id").alias("source_id")), ["source_id"], "beneficiaire_id")


def dim_offre(stg: DataFrame) -> DataFrame:
    """dim_offre: partner default 'Non precise', category duplicated as sector,
    text price read with ``try_cast`` (P2, P3, P11)."""
    df = stg.select(
        F.col("id").alias("source_id"),
        F.coalesce("nom_partenaire", F.lit("Non precise")).alias("nom_partenaire"),
        F.col("categorie").alias("secteur"),
        "categorie", "nom_offre", "type_avantage", "valeur_avantage", "unite_avantage",
        F.expr("try_cast(tarif_pass_jeunes_txt AS decimal(10,2))").alias("tarif_pass_jeunes"),
        "tarif_public", "description", "conditions", "montant_a_debiter", "montant_a_payer", "solde_initial", "solde_mensuel",
        F.col("ville").alias("ville_offre"),
        F.col("region").alias("region_offre"),
        "actif",
    )
    # bounded: the offer catalogue
    return with_row_number(df, ["source_id"], "offre_id")


def dim_association(stg: DataFrame) -> DataFrame:
    df = stg.select(F.col("id").alias("source_id"), "nom", "type", "domaine_activite", "statut",
                    "nb_membres", "date_creation")
    # one row per association: grows with the country's associations, so no single-task window
    return with_surrogate(df, ["source_id"], "association_id")


def dim_maison(stg: DataFrame) -> DataFrame:
    df = stg.select(F.col("id").alias("source_id"), "nom", "capacite_accueil", "statut", "date_ouverture")
    return with_row_number(df, ["source_id"], "maison_id")
