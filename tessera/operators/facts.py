"""Fact builders (J1-J6, P7, P8, P12, W2) and the star assembly.

The calendar, whose size is fixed by its span, is broadcast, and so are the offers and the regions, which one task has
numbered (``with_row_number``): Spark knows no size of them beforehand and would shuffle all facts before it finds them
small. All other lookups carry no hint: AQE picks broadcast or shuffle from run-time statistics and splits skewed keys.
Facts join the beneficiary dimension's two key columns only.

Two rule sets:
  "a" - calendar looked up with a default key, activities join regions
        with a LEFT join, open-ended duration defaults to 1;
  "b" - calendar key computed from the date, activities need their house and
        region (INNER), duration stays NULL when open-ended.
``compat=True`` reproduces the city-only / region-only region lookups that
multiply rows when a city (or region) appears in several dim_region rows;
the default keeps the declared grain by taking the smallest region_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import date_key


def _temps(df: DataFrame, date_col: str, calendar: DataFrame | None, rules: str, default_key: int) -> DataFrame:
    d = F.to_date(F.col(date_col))
    if rules == "b" or calendar is None:
        return df.withColumn("temps_id", date_key(d))
    cal = F.broadcast(calendar.select(F.col("date_complete").alias("_d"), F.col("temps_id").alias("_tid")))
    return (df.withColumn("_dd", d).join(cal, F.col("_dd") == F.col("_d"), "left")
            .withColumn("temps_id", F.coalesce("_tid", F.lit(default_key))).drop("_dd", "_d", "_tid"))


def _region_lookup(dim_region: DataFrame, keys: list[str], compat: bool) -> DataFrame:
    lk = dim_region.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("region_id").alias("_rid"))
    if not compat:
        lk = lk.groupBy(*[f"_r_{k}" for k in keys]).agg(F.min("_rid").alias("_rid"))
    return lk


def _with_region(df: DataFrame, dim_region: DataFrame, on: dict[str, str], compat: bool,
                 how: str = "left", default: bool = True) -> DataFrame:
    """Attach region_id by the given fact->dimension columns."""
    lk = _region_lookup(dim_region, list(on.values()), compat)
    cond = None
    for fact_col, dim_col in on.items():
        c = F.col(fact_col) == F.col(f"_r_{dim_col}")
        cond = c if cond is None else cond & c
    out = df.join(F.broadcast(lk), cond, how)
    rid = F.col("_rid")
    if default:
        # the reference's "TOP 1 region_id" made deterministic: the smallest id
        rid = F.coalesce(rid, dim_region.agg(F.min("region_id")).scalar())
    return out.withColumn("region_id", rid.cast("long")).drop("_rid", *[f"_r_{k}" for k in on.values()])


def _benef_map(dim_benef: DataFrame) -> DataFrame:
    """source id -> surrogate (grows with the population: the join's kind is left to run-time statistics)."""
    return dim_benef.select(F.col("source_id").alias("_bsrc"), "beneficiaire_id")


def fait_operations(ops: DataFrame, dim_benef: DataFrame, dim_offre: DataFrame, dim_region: DataFrame,
                    calendar: DataFrame | None = None, rules: str = "a", compat: bool = False,
                    default_key: int = 20210101) -> DataFrame:
    b = _benef_map(dim_benef)
    o = F.broadcast(dim_offre.select(F.col("source_id").alias("_osrc"), "offre_id"))
    f = (ops.withColumnRenamed("beneficiaire_id", "_b").withColumnRenamed("offre_id", "_o")
         .join(b, F.col("_b") == F.col("_bsrc"))
         .join(o, F.col("_o") == F.col("_osrc")))
    f = _temps(f, "date_operation", calendar, rules, default_key)
    f = _with_region(f, dim_region, {"ville": "ville"}, compat)
    return f.select("temps_id", "region_id", "beneficiaire_id", "offre_id",
                    F.col("montant_reduction").cast("decimal(10,2)").alias("montant_reduction"),
                    F.col("nb_operations").cast("int").alias("nb_operations"))


def fait_solde(solde: DataFrame, dim_benef: DataFrame, dim_offre: DataFrame,
               calendar: DataFrame | None = None, rules: str = "a", default_key: int = 20210101) -> DataFrame:
    b = _benef_map(dim_benef)
    o = F.broadcast(dim_offre.select(F.col("source_id").alias("_osrc"), "offre_id"))
    f = (solde.withColumnRenamed("beneficiaire_id", "_b").withColumnRenamed("offre_id", "_o")
         .join(b, F.col("_b") == F.col("_bsrc"))
         .join(o, F.col("_o") == F.col("_osrc")))
    f = _temps(f, "date_renouvellement", calendar, rules, default_key)
    return f.select("temps_id", "beneficiaire_id", "offre_id", F.col("annee").cast("int").alias("annee"),
                    "credit_initial", "credit_restant",
                    (F.col("credit_initial") - F.col("credit_restant")).alias("credit_consomme"))


def fait_activites(act: DataFrame, rapport: DataFrame, maison_stg: DataFrame, dim_assoc: DataFrame,
                   dim_maison: DataFrame, dim_region: DataFrame, calendar: DataFrame | None = None,
                   rules: str = "a", default_key: int = 20210101) -> DataFrame:
    """Activities with their reports (1:N, LEFT, measures default 0)."""
    a = (dim_assoc.select(F.col("source_id").alias("_asrc"), "association_id"))
    m = (dim_maison.select(F.col("source_id").alias("_msrc"), "maison_id"))
    ms = (maison_stg.select(F.col("id").alias("_mid"), F.col("ville").alias("_mville"),
                                   F.col("region").alias("_mregion")))
    r = rapport.select(F.col("activite_id").alias("_ract"), "nb_participants", "taux_satisfaction", "budget_consomme")
    f = (act.withColumnRenamed("association_id", "_a_in")
         .join(r, F.col("id") == F.col("_ract"), "left")
         .join(a, F.col("_a_in") == F.col("_asrc"))
         .join(m, F.col("maison_jeunes_id") == F.col("_msrc"))
         .join(ms, F.col("maison_jeunes_id") == F.col("_mid"), "left" if rules == "a" else "inner"))
    f = _temps(f, "date_debut", calendar, rules, default_key)
    f = _with_region(f, dim_region, {"_mville": "ville", "_mregion": "region"}, compat=True,
                     how="left" if rules == "a" else "inner", default=(rules == "a"))
    dur = F.datediff("date_fin", "date_debut")
    if rules == "a":
        dur = F.coalesce(dur, F.lit(1))
    return f.select(
        F.col("id").alias("source_id"), "temps_id", "region_id", "association_id", "maison_id",
        "type_activite", "statut", "budget",
        F.coalesce("nb_participants", F.lit(0)).alias("nb_participants"),
        F.coalesce("taux_satisfaction", F.lit(0).cast("decimal(5,2)")).alias("taux_satisfaction"),
        F.coalesce("budget_consomme", F.lit(0).cast("decimal(12,2)")).alias("budget_consomme"),
        dur.alias("duree_jours"),
    )


def fait_motatawi3(reg: DataFrame, dim_benef: DataFrame, dim_region: DataFrame,
                   calendar: DataFrame | None = None, rules: str = "a", compat: bool = False,
                   default_key: int = 20210101) -> DataFrame:
    b = _benef_map(dim_benef)
    f = reg.withColumnRenamed("beneficiaire_id", "_b").join(b, F.col("_b") == F.col("_bsrc"))
    f = _temps(f, "date_inscription", calendar, rules, default_key)
    f = _with_region(f, dim_region, {"region": "region"}, compat)
    return f.select(F.col("id").alias("source_id"), "temps_id", "region_id", "beneficiaire_id", "edition",
                    "domaine_volontariat", "niveau_etudes", "statut_dossier", "statut")
