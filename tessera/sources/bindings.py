"""Test binding: the driver's TPC-H-like tables seen as the domain's staging tables.

The real sources (beneficiaries, offers, balances, operations, volunteering,
youth houses, associations, persons, holiday camps, activities, reports) are
not in the test data. Each staging frame below is a plain DataFrame derived
from the given tables, so every query's work grows with them. The identical
definitions in SQL live in ``tessera.plans.oracles``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import pass_status, reduction_amount
from tessera.operators.keys import keep, spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "embeddings"]

# Dates of the binding (same distances as the reference's constants).
AS_OF = dt.date(2001, 8, 1)
CAL_START, CAL_END = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
CUTOFF = dt.date(2000, 6, 30)
MID = dt.date(1999, 6, 30)
LAST_Q = dt.date(2000, 4, 1)
LAST_H = dt.date(2000, 1, 1)
DEFAULT_TEMPS_ID = 20210101

# Value domains used to label bound rows (fixed values of the source schemas).
NIVEAU_ETUDES = ["Lycee", "Bac", "Licence", "Master", "Doctorat", "Non_Scolarise"]
STATUT_DOSSIER = ["Soumis", "En_Cours", "Valide", "Rejete"]
STATUT_VOLONTARIAT = ["Actif", "Termine"]
STATUT_ASSOCIATION = ["Active", "Inactive", "Suspendue"]
SAISONS = ["Ete", "Hiver", "Printemps"]
DOMAINES = ["Culture", "Sport", "Social", "Environnement"]
ROLES = ["President", "Vice_President", "Tresorier", "Secretaire", "Animateur"]


class _Tables(dict):
    """Test tables, each read (listing + footers) only when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self[name] = df
        return df


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _Tables(spark, sf_dir)


def _pick(values: list[str], idx) -> F.Column:
    """values[idx] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


@dataclass
class Staging:
    """Lazily built staging frames of one test-data folder."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self):
        self.t = read_tables(self.spark, self.sf_dir)
        self._cache: dict[str, DataFrame] = {}

    def _memo(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    def rows(self, table: str) -> int:
        """Rows of a table, from the footers of its files."""
        return self._memo(f"rows of {table}", lambda: self.t[table].count())

    # -- geography --------------------------------------------------------
    def geo(self) -> DataFrame:
        """nation -> (n_nationkey, n_name, r_name); 25 rows."""
        def build():
            n, r = self.t["nation"], self.t["region"]
            g = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
            return g
        return self._memo("geo", build)

    # -- beneficiaries ----------------------------------------------------
    def beneficiaire(self) -> DataFrame:
        def build():
            c, o = self.t["customer"], self.t["orders"]
            first = o.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("date_inscription"))
            birth = F.date_add(F.lit(dt.date(1970, 1, 1)), ((F.col("c_custkey") * 13) % 6200).cast("int"))
            return (
                c.join(self.geo(), c.c_nationkey == F.col("n_nationkey"))
                .join(first, c.c_custkey == first.o_custkey, "left")
                .select(
                    F.col("c_custkey").alias("id"),
                    F.col("c_name").alias("cin"),
                    F.col("c_name").alias("nom"),
                    F.col("c_mktsegment").alias("prenom"),
                    F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("genre"),
                    birth.alias("date_naissance"),
                    F.col("n_name").alias("ville"),
                    F.col("r_name").alias("region"),
                    F.lit("Marocaine").alias("nationalite"),
                    F.col("c_mktsegment").alias("type_statut"),
                    (F.col("c_custkey") % 33 == 0).alias("en_situation_handicap"),
                    "date_inscription",
                    pass_status(birth, F.lit(AS_OF)).alias("statut_pass"),
                )
            )
        return self._memo("beneficiaire", build)

    # -- offers -----------------------------------------------------------
    def _catalogue(self) -> DataFrame:
        """Distinct (brand, type) of part with its lowest price; bounded by the
        brand x type domain, so its ids come from one window."""
        def build():
            p = self.t["part"]
            cat = (p.groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("price")))
            return cat.withColumn("id", F.row_number().over(Window.orderBy("p_brand", "p_type")).cast("long"))
        return self._memo("_catalogue", build)

    def offre(self) -> DataFrame:
        def build():
            k = F.col("id") % 3
            geo = self.geo()
            return (
                self._catalogue().join(geo, (F.col("id") % 25) == geo.n_nationkey)
                .select(
                    "id",
                    F.when(F.col("id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("nom_partenaire"),
                    F.col("p_type").alias("categorie"),
                    F.concat("p_brand", F.lit("/"), "p_type").alias("nom_offre"),
                    F.when(k == 0, "Gratuite").when(k == 1, "Tarif fixe").otherwise("Reduction").alias("type_avantage"),
                    F.when(k == 0, F.lit(0)).when(k == 1, F.col("id") % 50 + 10)
                    .otherwise((F.col("id") % 5 + 1) * 10).cast("decimal(10,2)").alias("valeur_avantage"),
                    F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "DH").otherwise("%").alias("unite_avantage"),
                    F.when(F.col("id") % 7 == 0, F.lit("sur devis"))
                    .otherwise(F.col("price").cast("decimal(10,2)").cast("string")).alias("tarif_pass_jeunes_txt"),
                    F.col("price").cast("decimal(10,2)").alias("tarif_public"),
                    F.when(F.col("id") % 6 != 0, F.concat(F.lit("Offre "), "p_type")).alias("description"),
                    F.when(F.col("id") % 4 == 0, F.lit("Sur presentation du pass")).alias("conditions"),
                    F.when(k == 1, F.col("id") % 20 + 5).cast("decimal(10,2)").alias("montant_a_debiter"),
                    (F.col("price").cast("decimal(10,2)") * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(10,2)").alias("montant_a_payer"),
                    ((F.col("id") % 6) * 100).cast("decimal(10,2)").alias("solde_initial"),
                    F.when(F.col("id") % 6 != 0, (F.col("id") % 6) * 10).cast("decimal(10,2)").alias("solde_mensuel"),
                    F.when(F.col("id") % 10 == 5, F.lit("Multi-villes")).otherwise(F.col("n_name")).alias("ville"),
                    F.when(F.col("id") % 5 == 0, "National").otherwise(F.col("r_name")).alias("region"),
                    (F.col("id") % 10 != 0).alias("actif"),
                )
            )
        return self._memo("offre", build)

    def part_offer(self) -> DataFrame:
        """part key -> offer id."""
        def build():
            cat = self._catalogue().select(F.col("id").alias("offre_id"), "p_brand", "p_type")
            m = (self.t["part"].select("p_partkey", "p_brand", "p_type")
                 .join(cat, ["p_brand", "p_type"])
                 .select("p_partkey", "offre_id", F.col("p_type").alias("categorie")))
            return m
        return self._memo("part_offer", build)

    # -- operations and balances ------------------------------------------
    def _lines(self) -> DataFrame:
        """lineitem with its order's customer and date, its offer and its supplier's city."""
        def build():
            li, o, s = self.t["lineitem"], self.t["orders"], self.t["supplier"]
            city = self.geo().select(F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("ville"))
            # suppliers come straight from their table, whose size Spark knows, and cities after them: a join of both has no
            # size beforehand, and the lines would be shuffled for it
            return (
                li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
                .join(o.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(self.part_offer(), F.col("l_partkey") == F.col("p_partkey"))
                .join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
                .join(F.broadcast(city), F.col("s_nationkey") == F.col("_nation"))
                .drop("s_nationkey", "_nation")
            )
        return self._memo("_lines", build)

    def keep_lines(self) -> None:
        """From here on the lines are joined once and kept, for who reads operations and balances several times."""
        self._cache["_lines"] = keep(self._lines().select(
            "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "o_custkey", "o_orderdate", "offre_id", "categorie", "ville"), "lines")

    def operation(self) -> DataFrame:
        return self._memo("operation", lambda: self._lines().select(
            F.col("l_orderkey").alias("src_order"),
            F.col("l_linenumber").alias("src_line"),
            F.col("o_custkey").alias("beneficiaire_id"),
            "offre_id",
            "categorie",
            F.to_date("o_orderdate").alias("date_operation"),
            reduction_amount(F.col("l_extendedprice"), F.col("l_discount")).alias("montant_reduction"),
            "ville",
            F.lit(1).alias("nb_operations"),
        ))

    def solde(self) -> DataFrame:
        """Balances by (beneficiary, offer, year): DECIMAL(12,2) per line, then summed."""
        def build():
            price = F.col("l_extendedprice").cast("decimal(12,2)")
            rest = (price * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(12,2)")
            # nearly every line is a balance of its own: the lines are hashed by their number, not combined before
            return (
                spread(self._lines(), self.rows("lineitem"), "o_custkey", "offre_id")
                .groupBy(F.col("o_custkey").alias("beneficiaire_id"), "offre_id",
                         F.year("o_orderdate").alias("annee"))
                .agg(F.sum(price).cast("decimal(12,2)").alias("credit_initial"),
                     F.sum(rest).cast("decimal(12,2)").alias("credit_restant"))
                .withColumn("date_renouvellement", F.make_date("annee", F.lit(1), F.lit(1)))
            )
        return self._memo("solde", build)

    # -- volunteering -----------------------------------------------------
    def motatawi3(self) -> DataFrame:
        def build():
            e, c = self.t["events"], self.t["customer"]
            reg = c.join(self.geo(), c.c_nationkey == F.col("n_nationkey")).select("c_custkey", "r_name")
            return (
                e.join(reg, e.user_id == reg.c_custkey, "left")
                .select(
                    F.col("event_id").alias("id"),
                    F.col("user_id").alias("beneficiaire_id"),
                    F.year("ts").cast("string").alias("edition"),
                    F.col("r_name").alias("region"),
                    F.col("event_type").alias("domaine_volontariat"),
                    _pick(NIVEAU_ETUDES, F.col("event_id")).alias("niveau_etudes"),
                    F.concat(F.lit("MT"), F.col("event_id").cast("string")).alias("code_suivi"),
                    F.to_date("ts").alias("date_inscription"),
                    _pick(STATUT_DOSSIER, F.col("event_id")).alias("statut_dossier"),
                    _pick(STATUT_VOLONTARIAT, F.col("event_id")).alias("statut"),
                )
            )
        return self._memo("motatawi3", build)

    # -- associations side -------------------------------------------------
    def maison(self) -> DataFrame:
        return self._memo("maison", lambda: self.geo().select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.concat(F.lit("Maison "), F.col("n_name")).alias("nom"),
            F.col("n_name").alias("ville"),
            F.col("r_name").alias("region"),
            (F.col("n_nationkey") * 10 + 50).alias("capacite_accueil"),
            F.when(F.col("n_nationkey") % 7 == 0, "Renovation").otherwise("Active").alias("statut"),
            F.date_add(F.lit(dt.date(1980, 1, 1)), (F.col("n_nationkey") * 211).cast("int")).alias("date_ouverture"),
        ))

    def association(self) -> DataFrame:
        return self._memo("association", lambda: self.t["supplier"].select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("nom"),
            F.when(F.col("s_suppkey") % 2 == 0, "Culturelle").otherwise("Sportive").alias("type"),
            _pick(DOMAINES, F.col("s_suppkey")).alias("domaine_activite"),
            F.col("s_nationkey").cast("long").alias("maison_jeunes_id"),
            F.date_add(F.lit(dt.date(1990, 1, 1)), ((F.col("s_suppkey") * 37) % 3000).cast("int")).alias("date_creation"),
            _pick(STATUT_ASSOCIATION, F.col("s_suppkey")).alias("statut"),
            (F.col("s_suppkey") % 90 + 10).cast("int").alias("nb_membres"),
        ))

    def colonie(self) -> DataFrame:
        """Holiday camps: one per supplier; every 9th has an empty city."""
        def build():
            s = self.t["supplier"]
            return s.join(self.geo(), s.s_nationkey == F.col("n_nationkey")).select(
                F.col("s_suppkey").alias("id"),
                F.concat(F.lit("Colonie "), F.col("s_name")).alias("nom"),
                F.when(F.col("s_suppkey") % 9 == 0, F.lit("")).otherwise(F.col("n_name")).alias("ville"),
                F.col("r_name").alias("region"),
                _pick(SAISONS, F.col("s_suppkey")).alias("saison"),
                (F.col("s_suppkey") % 2 + 2000).cast("int").alias("annee"),
                (F.col("s_suppkey") % 14 + 7).cast("int").alias("duree_jours"),
            )
        return self._memo("colonie", build)

    def activite(self) -> DataFrame:
        def build():
            o, li, c, s = self.t["orders"], self.t["lineitem"], self.t["customer"], self.t["supplier"]
            n_sup = s.agg(F.count(F.lit(1))).scalar()
            last_ship = li.groupBy(F.col("l_orderkey")).agg(F.max("l_shipdate").alias("last_ship"))
            return (
                o.join(last_ship, o.o_orderkey == last_ship.l_orderkey, "left")
                .join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
                .select(
                    F.col("o_orderkey").alias("id"),
                    (F.col("o_custkey") % n_sup).alias("association_id"),
                    F.col("c_nationkey").cast("long").alias("maison_jeunes_id"),
                    F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 97).alias("colonie_vacances_id"),
                    F.col("o_orderpriority").alias("type_activite"),
                    F.col("o_orderstatus").alias("statut"),
                    F.col("o_totalprice").cast("decimal(12,2)").alias("budget"),
                    F.to_date("o_orderdate").alias("date_debut"),
                    F.when(F.col("last_ship") >= F.col("o_orderdate"), F.to_date("last_ship")).alias("date_fin"),
                )
            )
        return self._memo("activite", build)

    def rapport(self) -> DataFrame:
        return self._memo("rapport", lambda: self.t["lineitem"].select(
            F.col("l_orderkey").alias("activite_id"),
            F.col("l_quantity").cast("int").alias("nb_participants"),
            F.col("l_tax").cast("decimal(5,2)").alias("taux_satisfaction"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("budget_consomme"),
        ))

    def personne(self) -> DataFrame:
        """Association members: one per distinct events.user_id, carrying the youth's national id."""
        def build():
            e, c = self.t["events"], self.t["customer"]
            users = e.select("user_id").distinct()
            return users.join(c, users.user_id == c.c_custkey).select(
                F.col("user_id").alias("id"),
                F.col("c_name").alias("jeune_cin"),
                _pick(ROLES, F.col("user_id")).alias("role"),
                F.lit("Membre_Bureau").alias("type_personne"),
                F.when(F.col("user_id") % 4 == 0, "Inactif").otherwise("Actif").alias("statut"),
                # some name an association or a house that is not there
                (F.col("user_id") % 90).alias("association_id"),
                F.when(F.col("user_id") % 2 == 0, F.col("user_id") % 27).alias("maison_jeunes_id"),
            )
        return self._memo("personne", build)

    def cin_mirror(self) -> DataFrame:
        """Id mirror: national ids of beneficiaries whose pass is active."""
        return self._memo("cin_mirror", lambda: self.beneficiaire()
                          .filter(F.col("statut_pass") == "Actif").select("cin").distinct())

