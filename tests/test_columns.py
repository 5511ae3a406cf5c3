"""Column rules on hand-made edge values."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.calendar import calendar, calendar_rows


def _one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_age_bands_both_rules(spark):
    as_of = dt.date(2001, 8, 1)
    years = [15, 16, 18, 19, 22, 23, 25, 26, 30, 31]
    rows = [(dt.date(2001 - y, 12, 31),) for y in years] + [(None,)]
    a = _one(spark, C.age_band(F.col("b"), F.lit(as_of), "a"), rows, "b date")
    b = _one(spark, C.age_band(F.col("b"), F.lit(as_of), "b"), rows, "b date")
    assert a == ["26-30", "16-18", "16-18", "19-22", "19-22", "23-25", "23-25", "26-30", "26-30", "26-30", "26-30"]
    assert b == ["+30", "16-18", "16-18", "19-22", "19-22", "23-25", "23-25", "26-30", "26-30", "+30", "+30"]


def test_year_difference_is_calendar_years(spark):
    v = _one(spark, C.year_diff(F.col("a"), F.col("b")), [(dt.date(2000, 12, 31), dt.date(2001, 1, 1))],
             "a date, b date")
    assert v == [1]


def test_zones(spark):
    rows = [("Rabat-Sale-Kenitra",), ("Beni Mellal-Khénifra",), ("Beni Mellal-Khenifra",), ("National",), (None,),
            ("Fès-Meknès",), ("Drâa-Tafilalet",), ("Laâyoune-Sakia El Hamra",), ("Tanger-Tetouan-Al Hoceima",)]
    a = _one(spark, C.zone(F.col("r"), "a"), rows, "r string")
    b = _one(spark, C.zone(F.col("r"), "b"), rows, "r string")
    assert a == ["Nord", "Centre", "Sahara", "Sahara", "Sahara", "Sahara", "Sahara", "Sahara", "Nord"]
    assert b == ["Nord-Ouest", "Centre", "Centre", "Autre", "Autre", "Centre-Nord", "Sud-Est", "Sahara", "Nord"]


def test_risk_segment_thresholds(spark):
    ps = [0.2999, 0.3, 0.5, 0.5999, 0.6]
    v = _one(spark, C.risk_segment(F.col("p")), [(p,) for p in ps], "p double")
    assert v == ["Faible", "Moyen", "Moyen", "Moyen", "Eleve"]


def test_ratios_and_divide(spark):
    rows = [(5.0, 0.0), (5.0, 2.0), (None, 1.0)]
    assert _one(spark, C.safe_ratio(F.col("x"), F.col("y")), rows, "x double, y double") == [5.0, 2.5, None]
    assert _one(spark, C.divide(F.col("x"), F.col("y"), 0), rows, "x double, y double") == [0.0, 2.5, 0.0]


def test_clean_number(spark):
    rows = [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)]
    assert _one(spark, C.clean_number(F.col("x")), rows, "x double") == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_leap_day_expiry_and_exact_age(spark):
    rows = [(dt.date(1972, 2, 29), dt.date(2002, 2, 28)), (dt.date(1980, 6, 15), dt.date(2010, 6, 14))]
    assert _one(spark, C.pass_expiry(F.col("b")), rows, "b date, at date") == [dt.date(2002, 2, 28),
                                                                              dt.date(2010, 6, 15)]
    assert _one(spark, C.exact_age(F.col("b"), F.col("at")), rows, "b date, at date") == [29, 29]
    assert _one(spark, C.pass_status(F.col("b"), F.col("at")), rows, "b date, at date") == ["Actif", "Actif"]


def test_normalize_name(spark):
    rows = [("Fès ",), ("FES",), ("Béni Mellal",), ("Beni Mellal",)]
    v = _one(spark, C.normalize_name(F.col("x")), rows, "x string")
    assert v[0] == v[1] == "fes" and v[2] == v[3] == "beni mellal"


def test_labels_and_city(spark):
    rows = [("A very long offer name indeed, really", "Partner"), ("Short", None)]
    lab = C.offer_label(F.col("o"), F.col("p"))
    v = _one(spark, C.ellipsis(lab, 35), rows, "o string, p string")
    assert v[0] == "A very long offer name indeed, real..." and v[1] is None
    assert _one(spark, C.city_country(F.col("o")), [(None,), ("Rabat",)], "o string") == [", Morocco",
                                                                                          "Rabat, Morocco"]


def test_benefit_and_resolve(spark):
    rows = [("Gratuite", 0.0, 100.0, "National", "Fes"), ("Tarif fixe", 25.0, 100.0, "Rabat", "Fes"),
            ("Reduction", 30.0, 99.99, "Multi-villes", "Fes")]
    sch = "t string, v double, p double, oc string, pc string"
    amt = _one(spark, C.benefit_amount(F.col("t"), F.col("v"), F.col("p")).cast("double"), rows, sch)
    assert amt == [0.0, 25.0, 30.0]
    assert _one(spark, C.resolve_city(F.col("oc"), F.col("pc")), rows, sch) == ["Fes", "Rabat", "Fes"]


def test_calendar_parts(spark):
    cal = calendar(spark, "2020-12-28", "2021-01-03")
    rows = {r["date_complete"]: r for r in cal.collect()}
    assert len(rows) == calendar_rows("2020-12-28", "2021-01-03") == 8  # the extra next day is kept
    d = rows[dt.date(2021, 1, 3)]
    assert (d.temps_id, d.semaine_annee, d.jour_semaine, d.est_weekend, d.nom_jour, d.nom_mois) == (
        20210103, 53, 7, True, "Dimanche", "Janvier")
    assert rows[dt.date(2021, 1, 4)].jour_semaine == 1
