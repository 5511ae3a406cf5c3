"""Semantic measures.

Each measure is a named aggregate ``Column`` over one fact table. A query
names measures and grouping columns; only the dimensions those columns need
are joined (LEFT, so unmatched fact rows land in a blank member).

DAX rules kept: SUM/AVERAGE ignore blanks; an empty group gives blank (NULL);
DIVIDE has alternate 0. Deliberate deviation: counts of an empty group are 0.
Averages of decimals are computed as exact sum / count in double, so they do
not depend on the engine's decimal-average scale.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import divide


def _avg(c: str) -> Column:
    return (F.sum(F.col(c)).cast("double") / F.count(F.col(c))).cast("double")


# fact name -> measure name -> aggregate expression (names are the model's).
MEASURES: dict[str, dict[str, Callable[[], Column]]] = {
    "operations": {
        "Total_Operations": lambda: F.count(F.lit(1)),
        "Montant_Total_Reductions": lambda: F.sum("montant_reduction"),
        "Nb_Beneficiaires_Actifs": lambda: F.count_distinct("beneficiaire_id"),
        "Montant_Moyen_Reduction": lambda: _avg("montant_reduction"),
    },
    "solde": {
        "Credit_Initial_Total": lambda: F.sum("credit_initial"),
        "Credit_Restant_Total": lambda: F.sum("credit_restant"),
        "Credit_Consomme_Total": lambda: F.sum("credit_initial") - F.sum("credit_restant"),
        "Taux_Utilisation_Credit": lambda: divide((F.sum("credit_initial") - F.sum("credit_restant")).cast("double"),
                                          F.sum("credit_initial").cast("double"), 0.0),
    },
    "activites": {
        "Total_Activites": lambda: F.count(F.lit(1)),
        "Budget_Total_Activites": lambda: F.sum("budget"),
        "Budget_Consomme_Activites": lambda: F.sum("budget_consomme"),
        "Satisfaction_Moyenne": lambda: _avg("taux_satisfaction"),
        "Total_Participants": lambda: F.sum("nb_participants"),
        "Duree_Moyenne_Jours": lambda: _avg("duree_jours"),
    },
    "motatawi3": {
        "Total_Volontaires": lambda: F.count(F.lit(1)),
    },
    "beneficiaire": {
        "Nb_Beneficiaires_Membres_Associations": lambda: F.count_if(F.col("est_membre_association")),
        "Taux_Engagement_Associatif": lambda: divide(F.count_if(F.col("est_membre_association")).cast("double"),
                                             F.count(F.lit(1)).cast("double"), 0.0),
        "Taux_Churn_Predit": lambda: divide(F.count_if(F.col("churn_predicted")).cast("double"),
                                    F.count(F.lit(1)).cast("double"), 0.0),
        "Nb_Beneficiaires_A_Risque": lambda: F.count_if(F.col("churn_risk_segment") == "Eleve"),
        "Score_Churn_Moyen": lambda: _avg("churn_probability"),
    },
}


# Measures whose parts add up, and counts of distinct dense keys (surrogates), whose bitmaps merge.
ADDITIVE = ["Total_Operations", "Montant_Total_Reductions", "Credit_Initial_Total", "Credit_Restant_Total", "Total_Activites",
            "Budget_Total_Activites", "Budget_Consomme_Activites", "Total_Participants", "Total_Volontaires"]
DISTINCT_KEYS = {"Nb_Beneficiaires_Actifs": "beneficiaire_id"}


@dataclass
class Relationship:
    """Many-to-one fact -> dimension relationship (LEFT join on key)."""

    fact_key: str
    dim: DataFrame
    dim_key: str
    columns: list[str] = field(default_factory=list)


class SemanticModel:
    """Facts with their relationships; ``query`` joins only the needed dimensions."""

    def __init__(self):
        self.facts: dict[str, DataFrame] = {}
        self.rels: dict[str, list[Relationship]] = {}

    def add_fact(self, name: str, df, rels: list[Relationship] | None = None) -> "SemanticModel":
        """``df`` is a DataFrame or a zero-argument builder (built on first use)."""
        self.facts[name] = df
        self.rels[name] = rels or []
        return self

    def fact(self, name: str) -> DataFrame:
        if callable(self.facts[name]):
            self.facts[name] = self.facts[name]()
        return self.facts[name]

    def view(self, fact: str, needed: list[str]) -> DataFrame:
        df = self.fact(fact)
        have = set(df.columns)
        for rel in self.rels[fact]:
            want = [c for c in rel.columns if c in needed and c not in have]
            if not want:
                continue
            d = rel.dim.select(F.col(rel.dim_key).alias("_k"), *want)
            df = df.join(d, F.col(rel.fact_key) == F.col("_k"), "left").drop("_k")
            have |= set(want)
        return df

    def query(self, fact: str, names: list[str], by: list[str] = (), where: Column | None = None,
              where_cols: list[str] = ()) -> DataFrame:
        df = self.view(fact, list(by) + list(where_cols))
        if where is not None:
            df = df.filter(where)
        aggs = [MEASURES[fact][n]().alias(n) for n in names]
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)

    def drill(self, fact: str, hierarchy: list[str], names: list[str]) -> DataFrame:
        """Totals at every level of a hierarchy with its level id.

        The fact is aggregated once, to the finest cells; the levels are grouping sets over these cells. Counts of distinct
        keys stay exact on the way up: a cell holds one bitmap per bucket of 32,768 dense keys, and levels OR them."""
        df = self.view(fact, hierarchy)
        distinct = [n for n in names if n in DISTINCT_KEYS]
        key = DISTINCT_KEYS[distinct[0]] if distinct else None
        if set(names) - set(ADDITIVE) - set(distinct) or len({DISTINCT_KEYS[n] for n in distinct}) > 1:
            aggs = [MEASURES[fact][n]().alias(n) for n in names]          # a measure that does not merge
            return df.rollup(*hierarchy).agg(F.grouping_id().alias("niveau"), *aggs)
        bucket = F.bitmap_bucket_number(F.col(key)) if key else F.lit(0)
        bits = [F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("_bits")] if key else []
        sums = [n for n in names if n in ADDITIVE]
        cells = df.groupBy(*hierarchy, bucket.alias("_bucket")).agg(*[MEASURES[fact][n]().alias(n) for n in sums], *bits)
        sets = [[F.col(c) for c in hierarchy[:k]] + [F.col("_bucket")] for k in range(len(hierarchy), -1, -1)]
        merged = cells.groupingSets(sets, *hierarchy, "_bucket").agg(
            F.shiftright(F.grouping_id(), 1).alias("niveau"), *[F.sum(n).alias(n) for n in sums],
            *([F.bitmap_or_agg("_bits").alias("_bits")] if key else []))
        whole = merged.groupBy(*hierarchy, "niveau").agg(
            *[F.sum(n).alias(n) for n in sums], *([F.sum(F.bitmap_count("_bits")).alias("_n")] if key else []))
        return whole.select(*hierarchy, "niveau", *[F.col("_n").alias(n) if n in distinct else F.col(n) for n in names])


def star_model(star) -> SemanticModel:
    """The fourteen active relationships of the star (J17): calendar, region, offer, beneficiary, association, house."""
    cal = F.broadcast(star.dim_temps)  # size known: days of the calendar range
    region, offre = star.dim_region, star.dim_offre
    benef, profile = star.dim_beneficiaire, ["genre", "tranche_age"]
    house = star.dim_maison.withColumnRenamed("nom", "maison")
    cal_cols = ["annee", "trimestre", "mois", "jour", "date_complete", "nom_mois", "est_weekend"]
    reg_cols = ["ville", "region", "zone_geo"]
    m = SemanticModel()
    m.add_fact("operations", star.fait_operations, [
        Relationship("temps_id", cal, "temps_id", cal_cols),
        Relationship("region_id", region, "region_id", reg_cols),
        Relationship("offre_id", offre, "offre_id", ["secteur", "categorie", "type_avantage"]),
        Relationship("beneficiaire_id", benef, "beneficiaire_id", profile),
    ])
    m.add_fact("solde", star.fait_solde, [
        Relationship("temps_id", cal, "temps_id", cal_cols),
        Relationship("beneficiaire_id", benef, "beneficiaire_id", profile),
        Relationship("offre_id", offre, "offre_id", ["secteur", "categorie"]),
    ])
    m.add_fact("activites", star.fait_activites, [
        Relationship("temps_id", cal, "temps_id", cal_cols),
        Relationship("region_id", region, "region_id", reg_cols),
        Relationship("association_id", star.dim_association, "association_id", ["type", "domaine_activite"]),
        Relationship("maison_id", house, "maison_id", ["maison", "capacite_accueil"]),
    ])
    m.add_fact("motatawi3", star.fait_motatawi3, [
        Relationship("temps_id", cal, "temps_id", cal_cols),
        Relationship("region_id", region, "region_id", reg_cols),
        Relationship("beneficiaire_id", benef, "beneficiaire_id", profile),
    ])
    return m
