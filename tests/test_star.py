"""Dimensions and facts on hand-made frames: fan-out, defaults, open ends."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.calendar import calendar
from tessera.operators import dims, facts
from tessera.operators.keys import with_surrogate


def test_region_union_rules(spark):
    a = spark.createDataFrame([("Rabat", "Rabat-Sale-Kenitra"), ("Rabat", "National"), ("", "X"), (None, "Y"),
                               ("Fes", None)], "ville string, region string")
    b = spark.createDataFrame([("Rabat", "National"), ("Sale", "Rabat-Sale-Kenitra")], "ville string, region string")
    ra = {(r.ville, r.region) for r in dims.dim_region([a, b], "a").collect()}
    rb = {(r.ville, r.region) for r in dims.dim_region([a, b], "b").collect()}
    assert ra == {("Rabat", "Rabat-Sale-Kenitra"), ("Rabat", "National"), ("", "X"), ("Sale", "Rabat-Sale-Kenitra")}
    assert rb == {("Rabat", "Rabat-Sale-Kenitra"), ("Rabat", "National"), ("Fes", None),
                  ("Sale", "Rabat-Sale-Kenitra")}
    ids = [r.region_id for r in dims.dim_region([a, b], "a").orderBy("ville", "region").collect()]
    assert ids == [1, 2, 3, 4]


def _star(spark):
    benef = spark.createDataFrame([(10, 1), (20, 2)], "source_id long, beneficiaire_id long")
    offre = spark.createDataFrame([(100, 1), (200, 2)], "source_id long, offre_id long")
    region = spark.createDataFrame([(1, "Rabat", "National"), (2, "Rabat", "Rabat-Sale-Kenitra"),
                                    (3, "Fes", "Fes-Meknes")], "region_id long, ville string, region string")
    ops = spark.createDataFrame([
        (10, 100, dt.date(2020, 5, 1), 5.0, "Rabat", 1),
        (20, 200, dt.date(1999, 1, 1), 7.0, "Tanger", 1),   # date outside the calendar, unknown city
        (30, 100, dt.date(2020, 5, 1), 1.0, "Fes", 1),      # unknown beneficiary: dropped
    ], "beneficiaire_id long, offre_id long, date_operation date, montant_reduction double, ville string, "
       "nb_operations int")
    return benef, offre, region, ops


def test_operations_fanout_and_defaults(spark):
    benef, offre, region, ops = _star(spark)
    cal = calendar(spark, "2020-01-01", "2020-12-31")
    strict = facts.fait_operations(ops, benef, offre, region, cal, "a", compat=False).collect()
    compat = facts.fait_operations(ops, benef, offre, region, cal, "a", compat=True).collect()
    assert len(strict) == 2 and len(compat) == 3  # Rabat sits in two regions
    by_b = {r.beneficiaire_id: r for r in strict}
    assert by_b[1].region_id == 1 and by_b[1].temps_id == 20200501
    assert by_b[2].region_id == 1 and by_b[2].temps_id == 20210101  # default region (min id) and default key
    rule_b = {r.beneficiaire_id: r.temps_id for r in facts.fait_operations(ops, benef, offre, region, cal, "b").collect()}
    assert rule_b[2] == 19990101  # rule B computes the key without a lookup


def test_activities_reports_and_open_end(spark):
    act = spark.createDataFrame([
        (1, 7, 0, "Reguliere", "Terminee", 100.0, dt.date(2020, 1, 1), dt.date(2020, 1, 11)),
        (2, 7, 0, "Reguliere", "En cours", 50.0, dt.date(2020, 2, 1), None),
    ], "id long, association_id long, maison_jeunes_id long, type_activite string, statut string, budget double, "
       "date_debut date, date_fin date")
    rap = spark.createDataFrame([(1, 10, 0.5, 20.0), (1, 5, 0.7, 30.0)],
                                "activite_id long, nb_participants int, taux_satisfaction double, budget_consomme double")
    rap = rap.select("activite_id", "nb_participants", F.col("taux_satisfaction").cast("decimal(5,2)"),
                     F.col("budget_consomme").cast("decimal(12,2)"))
    maison = spark.createDataFrame([(0, "Rabat", "Rabat-Sale-Kenitra")], "id long, ville string, region string")
    assoc = spark.createDataFrame([(7, 1)], "source_id long, association_id long")
    dmaison = spark.createDataFrame([(0, 1)], "source_id long, maison_id long")
    region = spark.createDataFrame([(4, "Rabat", "Rabat-Sale-Kenitra")], "region_id long, ville string, region string")
    cal = calendar(spark, "2020-01-01", "2020-12-31")
    a = facts.fait_activites(act, rap, maison, assoc, dmaison, region, cal, "a").orderBy("source_id").collect()
    b = facts.fait_activites(act, rap, maison, assoc, dmaison, region, cal, "b").orderBy("source_id").collect()
    assert [r.source_id for r in a] == [1, 1, 2]  # 1:N reports, no report -> one row
    assert a[2].nb_participants == 0 and float(a[2].budget_consomme) == 0.0
    assert a[0].duree_jours == 10 and a[2].duree_jours == 1 and b[2].duree_jours is None


def test_surrogate_dense_and_ordered_with_skew(spark):
    # one value holds a third of the rows: keys stay dense, unique and ordered
    rows = [(0, i) for i in range(300)] + [(k, 0) for k in range(1, 601)]
    df = spark.createDataFrame(rows, "a long, b long")
    out = with_surrogate(df, ["a", "b"], "sid", num_partitions=7).orderBy("sid").collect()
    assert [r.sid for r in out] == list(range(1, 901))
    keys = [(r.a, r.b) for r in out]
    assert keys == sorted(keys)


def test_distinct_counts_merge_up_a_hierarchy(spark):
    from tessera.operators.measures import SemanticModel
    rows = [(y, m, k, 1.5) for y in (2000, 2001) for m in range(1, 5) for k in (1, 2, 32768, 32769, 70000 + m, 200_000 * y)] + [(2001, None, 5, 1.0), (None, 1, 1, 1.0)]
    fact = spark.createDataFrame(rows, "annee int, mois int, beneficiaire_id long, montant_reduction double")
    out = SemanticModel().add_fact("operations", fact).drill("operations", ["annee", "mois"], ["Total_Operations", "Nb_Beneficiaires_Actifs"])
    want = fact.rollup("annee", "mois").agg(F.grouping_id().alias("niveau"), F.count(F.lit(1)).alias("Total_Operations"),
                                            F.count_distinct("beneficiaire_id").alias("Nb_Beneficiaires_Actifs"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.select(out.columns).collect()), key=str)
    # grouping sets expand the cells, not the fact: an aggregate stands below
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Expand" in x)
    assert any("bitmap_construct_agg" in x for x in lines[at:]) and not any("bitmap_construct_agg" in x for x in lines[:at])
