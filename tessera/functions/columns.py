"""Column-level business rules (built-in expressions only, all codegen-friendly).

Every function takes and returns ``Column`` objects so it can be used inside
``select``/``withColumn``/``agg`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's, stated as plain text.
# ---------------------------------------------------------------------------
# French day names, Monday first (unaccented).
DAY_NAMES = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]
# French month names, January first (unaccented).
MONTH_NAMES = [
    "Janvier", "Fevrier", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Aout", "Septembre", "Octobre", "Novembre", "Decembre",
]
# Zone rule A: region lists (anything else, NULL included, is 'Sahara').
ZONE_A = {
    "Nord": ["Tanger-Tetouan-Al Hoceima", "Rabat-Sale-Kenitra", "Fes-Meknes", "Oriental"],
    "Centre": ["Casablanca-Settat", "Marrakech-Safi", "Beni Mellal-Khénifra", "Draa-Tafilalet"],
    "Sud": ["Souss-Massa", "Guelmim-Oued Noun"],
}
ZONE_A_ELSE = "Sahara"
# Zone rule B: region prefixes in order of evaluation (first match wins), else 'Autre'.
ZONE_B = [
    (["Tanger"], "Nord"),
    (["Oriental"], "Nord-Est"),
    (["Fes", "Fès"], "Centre-Nord"),
    (["Rabat"], "Nord-Ouest"),
    (["Beni", "Béni"], "Centre"),
    (["Casablanca"], "Centre-Ouest"),
    (["Marrakech"], "Centre-Ouest"),
    (["Souss"], "Sud-Ouest"),
    (["Draa", "Drâa"], "Sud-Est"),
    (["Guelmim"], "Sud"),
    (["Laayoune", "Laâyoune"], "Sahara"),
    (["Dakhla"], "Sahara"),
]
ZONE_B_ELSE = "Autre"
# Risk thresholds of the churn score.
RISK_LOW, RISK_MID = 0.3, 0.6
RISK_NAMES = ("Faible", "Moyen", "Eleve")
# Placeholder cities resolved to the beneficiary's city.
PLACEHOLDER_CITIES = ["National", "Multi-villes", "Tout le Maroc"]
# Accent folding used by the name normaliser (lower-case letters only).
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"


def date_key(d: Column) -> Column:
    """Date -> integer key yyyymmdd."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def year_diff(start: Column, end: Column) -> Column:
    """Difference of calendar years, not elapsed years."""
    return F.year(end) - F.year(start)


def age_band(birth: Column, as_of: Column, rules: str = "a") -> Column:
    """Age band by calendar-year difference."""
    y = year_diff(birth, as_of)
    c = (F.when(y.between(16, 18), "16-18")
         .when(y.between(19, 22), "19-22")
         .when(y.between(23, 25), "23-25"))
    if rules == "a":
        return c.otherwise("26-30")
    return c.when(y.between(26, 30), "26-30").otherwise("+30")


def zone(region: Column, rules: str = "a") -> Column:
    """Geographic zone of a region name (P5a: exact lists, P5b: prefixes)."""
    if rules == "a":
        c = None
        for name, members in ZONE_A.items():
            cond = region.isin(members)
            c = F.when(cond, name) if c is None else c.when(cond, name)
        return c.otherwise(ZONE_A_ELSE)
    c = None
    for prefixes, name in ZONE_B:
        cond = None
        for p in prefixes:
            one = region.startswith(p)
            cond = one if cond is None else (cond | one)
        c = F.when(cond, name) if c is None else c.when(cond, name)
    return c.otherwise(ZONE_B_ELSE)


def safe_ratio(x: Column, y: Column) -> Column:
    """x / max(y, 1)."""
    return x / F.greatest(y, F.lit(1))


def divide(a: Column, b: Column, alternate=0) -> Column:
    """DIVIDE(a, b, alternate): alternate when b is 0 or blank."""
    return F.coalesce(F.try_divide(a, b), F.lit(alternate))


def risk_segment(p: Column) -> Column:
    """Churn probability -> 'Faible' / 'Moyen' / 'Eleve' (P18)."""
    low, mid, high = RISK_NAMES
    return F.when(p < RISK_LOW, low).when(p < RISK_MID, mid).otherwise(high)


def clean_number(x: Column) -> Column:
    """NULL, NaN and +-infinity -> 0."""
    d = x.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)


def normalize_name(c: Column) -> Column:
    """Accent- and case-insensitive key of a place name, trailing blanks removed (P20)."""
    return F.translate(F.lower(F.rtrim(c)), ACCENTED, UNACCENTED)


def city_country(ville: Column) -> Column:
    """Calculated column ville & ", Morocco"; a blank city acts as '' (P13)."""
    return F.concat(F.coalesce(ville, F.lit("")), F.lit(", Morocco"))


def offer_label(nom_offre: Column, partenaire: Column) -> Column:
    """Display label 'offer (partner)' (P14)."""
    return F.concat(nom_offre, F.lit(" ("), partenaire, F.lit(")"))


def ellipsis(text: Column, width: int = 35) -> Column:
    """Cut to ``width`` characters and append '...' when longer."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def day_name(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]), F.weekday(d) + 1)


def month_name(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), F.month(d))


def pass_expiry(birth: Column) -> Column:
    """Birth date + 30 years; 29 Feb becomes 28 Feb (L1)."""
    return F.add_months(birth, 360)


def exact_age(birth: Column, at: Column) -> Column:
    """Completed years at a date (L2)."""
    before_birthday = (F.month(at) < F.month(birth)) | (
        (F.month(at) == F.month(birth)) & (F.dayofmonth(at) < F.dayofmonth(birth)))
    return year_diff(birth, at) - F.when(before_birthday, 1).otherwise(0)


def pass_status(birth: Column, at: Column) -> Column:
    """'Actif' while the exact age is at most 30, else 'Desactive' (L3)."""
    return F.when(exact_age(birth, at) <= 30, "Actif").otherwise("Desactive")


def benefit_amount(type_avantage: Column, valeur: Column, prix: Column) -> Column:
    """Free -> 0; fixed price -> value; percentage -> price x value / 100."""
    return (F.when(type_avantage == "Gratuite", F.lit(0).cast("decimal(10,2)"))
            .when(type_avantage == "Tarif fixe", valeur.cast("decimal(10,2)"))
            .otherwise((prix.cast("decimal(12,2)") * valeur.cast("decimal(10,2)") / 100).cast("decimal(10,2)")))


def resolve_city(offer_city: Column, person_city: Column) -> Column:
    """Placeholder offer city -> the beneficiary's city."""
    return F.when(offer_city.isin(PLACEHOLDER_CITIES), person_city).otherwise(offer_city)


def reduction_amount(price: Column, discount: Column) -> Column:
    """DECIMAL product, never a rounded double product (binding rule of the operations)."""
    return (price.cast("decimal(12,2)") * discount.cast("decimal(4,2)")).cast("decimal(10,2)")
