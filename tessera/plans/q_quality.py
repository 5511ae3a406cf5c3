"""Quality-rule queries (G1-G9, J16) and the stream validation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import year_diff
from tessera.operators import quality as Q
from tessera.operators.keys import keep
from tessera.plans.common import plain
from tessera.plans.context import Ctx
from tessera.plans.registry import query
from tessera.plans.sqlparts import cte, q as sq, with_ctes

# Fixed value domains of the source schemas' CHECK constraints.
TYPE_STATUT = ["Marocain", "Immigrant_Etranger", "Subsaharien_Naturalise", "Marocain_Expatrie"]
STATUT_PASS = ["Actif", "Desactive"]
NIVEAU_ETUDES = ["Lycee", "Bac", "Licence", "Master", "Doctorat", "Non_Scolarise"]
STATUT_DOSSIER = ["Soumis", "En_Cours", "Valide", "Rejete"]
STATUT_MOTATAWI3 = ["Actif", "Termine"]
STATUT_MAISON = ["Active", "Fermee", "Renovation"]
STATUT_ASSOCIATION = ["Active", "Inactive", "Suspendue"]
TYPE_PERSONNE = ["Membre_Bureau", "Animateur"]
ROLE_PERSONNE = ["President", "Vice_President", "Tresorier", "Secretaire", "Animateur"]
STATUT_PERSONNE = ["Actif", "Inactif"]
SAISON = ["Ete", "Hiver", "Printemps"]
TYPE_ACTIVITE = ["Reguliere", "Saisonniere_Campus"]
STATUT_ACTIVITE = ["Planifiee", "En cours", "Terminee", "Annulee"]


def _rules(stg):
    """(table name, frame, rules) of the staging tables."""
    age = year_diff(F.col("date_naissance"), F.col("date_inscription"))
    return [
        ("beneficiaire", stg.beneficiaire(), [
            Q.Rule("age_16_30", age.between(16, 30)),
            Q.in_list("type_statut", TYPE_STATUT), Q.in_list("statut_pass", STATUT_PASS),
            *Q.not_null("cin", "nom", "prenom", "date_naissance", "date_inscription")]),
        ("motatawi3", stg.motatawi3(), [
            Q.in_list("niveau_etudes", NIVEAU_ETUDES), Q.in_list("statut_dossier", STATUT_DOSSIER),
            Q.in_list("statut", STATUT_MOTATAWI3), *Q.not_null("beneficiaire_id", "region")]),
        ("maison", stg.maison(), [Q.in_list("statut", STATUT_MAISON)]),
        ("association", stg.association(), [Q.in_list("statut", STATUT_ASSOCIATION)]),
        ("personne", stg.personne(), [Q.in_list("type_personne", TYPE_PERSONNE), Q.in_list("role", ROLE_PERSONNE),
                                      Q.in_list("statut", STATUT_PERSONNE)]),
        ("colonie", stg.colonie(), [Q.in_list("saison", SAISON)]),
        ("activite", stg.activite(), [Q.in_list("type_activite", TYPE_ACTIVITE),
                                      Q.in_list("statut", STATUT_ACTIVITE), *Q.not_null("date_fin")]),
    ]


def _in(col, values):
    return f"count_if(NOT coalesce({col} IN ({', '.join(sq(v) for v in values)}), true))"


def _nn(col):
    return f"count_if({col} IS NULL)"


_RULES_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{r}' AS rule, CAST({e} AS BIGINT) AS n_violations FROM {src}"
    for t, src, r, e in [
        ("beneficiaire", "b_benef", "age_16_30",
         "count_if(NOT coalesce((year(date_inscription) - year(date_naissance)) BETWEEN 16 AND 30, true))"),
        ("beneficiaire", "b_benef", "in_list:type_statut", _in("type_statut", TYPE_STATUT)),
        ("beneficiaire", "b_benef", "in_list:statut_pass", _in("statut_pass", STATUT_PASS)),
        *[("beneficiaire", "b_benef", f"not_null:{c}", _nn(c))
          for c in ("cin", "nom", "prenom", "date_naissance", "date_inscription")],
        ("motatawi3", "b_motatawi3", "in_list:niveau_etudes", _in("niveau_etudes", NIVEAU_ETUDES)),
        ("motatawi3", "b_motatawi3", "in_list:statut_dossier", _in("statut_dossier", STATUT_DOSSIER)),
        ("motatawi3", "b_motatawi3", "in_list:statut", _in("statut", STATUT_MOTATAWI3)),
        ("motatawi3", "b_motatawi3", "not_null:beneficiaire_id", _nn("beneficiaire_id")),
        ("motatawi3", "b_motatawi3", "not_null:region", _nn("region")),
        ("maison", "b_maison", "in_list:statut", _in("statut", STATUT_MAISON)),
        ("association", "b_association", "in_list:statut", _in("statut", STATUT_ASSOCIATION)),
        ("personne", "b_personne", "in_list:type_personne", _in("type_personne", TYPE_PERSONNE)),
        ("personne", "b_personne", "in_list:role", _in("role", ROLE_PERSONNE)),
        ("personne", "b_personne", "in_list:statut", _in("statut", STATUT_PERSONNE)),
        ("colonie", "b_colonie", "in_list:saison", _in("saison", SAISON)),
        ("activite", "b_activite", "in_list:type_activite", _in("type_activite", TYPE_ACTIVITE)),
        ("activite", "b_activite", "in_list:statut", _in("statut", STATUT_ACTIVITE)),
        ("activite", "b_activite", "not_null:date_fin", _nn("date_fin")),
    ])


@query("q_rule_violations", with_ctes(_RULES_SQL))
def q_rule_violations(spark, sf):
    """Declared CHECK / NOT NULL constraints, counted in one scan per table."""
    stg = Ctx(spark, sf).stg
    return plain(reduce(DataFrame.unionByName, [Q.check(df, rules, t) for t, df, rules in _rules(stg)]))


_UNIQUE = [("beneficiaire", "b_benef", ["cin"]), ("motatawi3", "b_motatawi3", ["code_suivi"]),
           ("solde", "b_solde", ["beneficiaire_id", "offre_id", "annee"]),
           ("operation", "b_operation", ["src_order", "src_line"]),
           ("dim_region", "dim_region_a", ["ville", "region"]), ("dim_region_city", "dim_region_a", ["ville"]),
           ("dim_temps", "dim_temps", ["date_complete"]), ("dim_beneficiaire", "dim_benef_a", ["source_id"])]


@query("q_unique_violations", with_ctes(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{','.join(k)}' AS key, CAST(count(*) AS BIGINT) AS n_duplicate_keys, "
    f"CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows_in_duplicates FROM "
    f"(SELECT {', '.join(k)}, count(*) AS n FROM {src} GROUP BY {', '.join(k)} HAVING count(*) > 1) d"
    for t, src, k in _UNIQUE)))
def q_unique_violations(spark, sf):
    """Uniqueness of declared keys."""
    c = Ctx(spark, sf)
    frames = {"b_benef": c.stg.beneficiaire(), "b_motatawi3": c.stg.motatawi3(), "b_solde": c.stg.solde(),
              "b_operation": c.stg.operation(), "dim_region_a": c.a.dim_region, "dim_temps": c.a.dim_temps,
              "dim_benef_a": c.a.dim_beneficiaire}
    rows = {"b_benef": "customer", "b_motatawi3": "events", "b_operation": "lineitem", "dim_benef_a": "customer"}
    return plain(reduce(DataFrame.unionByName, [Q.check_unique(frames[src], k, t, c.stg.rows(rows[src]) if src in rows else None)
                                                for t, src, k in _UNIQUE]))


# The declared relationships of the sources and of the star, and the logical one across systems.
_FK = [("solde->beneficiaire", "b_solde", ["beneficiaire_id"], "b_benef", ["id"]),
       ("solde->offre", "b_solde", ["offre_id"], "b_offre", ["id"]),
       ("operation->beneficiaire", "b_operation", ["beneficiaire_id"], "b_benef", ["id"]),
       ("operation->offre", "b_operation", ["offre_id"], "b_offre", ["id"]),
       ("operation->solde", "b_operation", ["beneficiaire_id", "offre_id"], "b_solde", ["beneficiaire_id", "offre_id"]),
       ("motatawi3->beneficiaire", "b_motatawi3", ["beneficiaire_id"], "b_benef", ["id"]),
       ("association->maison", "b_association", ["maison_jeunes_id"], "b_maison", ["id"]),
       ("personne->association", "b_personne", ["association_id"], "b_association", ["id"]),
       ("personne->maison", "b_personne", ["maison_jeunes_id"], "b_maison", ["id"]),
       ("activite->association", "b_activite", ["association_id"], "b_association", ["id"]),
       ("activite->maison", "b_activite", ["maison_jeunes_id"], "b_maison", ["id"]),
       ("activite->colonie", "b_activite", ["colonie_vacances_id"], "b_colonie", ["id"]),
       ("rapport->activite", "b_rapport", ["activite_id"], "b_activite", ["id"]),
       ("personne->cin_mirror", "b_personne", ["jeune_cin"], "cin_mirror", ["cin"]),
       *[(f"fait_{f}->dim_{dim}", rel, [key], parent, [key])
         for f, rel, dims in (("operations", "fops_a", ("temps", "region", "beneficiaire", "offre")),
                              ("solde", "fsolde_a", ("temps", "beneficiaire", "offre")),
                              ("activites", "fact_a", ("temps", "region", "association", "maison")),
                              ("motatawi3", "fmot_a", ("temps", "region", "beneficiaire")))
         for dim, parent, key in (("temps", "dim_temps", "temps_id"), ("region", "dim_region_a", "region_id"),
                                  ("beneficiaire", "dim_benef_a", "beneficiaire_id"), ("offre", "dim_offre", "offre_id"),
                                  ("association", "dim_association", "association_id"), ("maison", "dim_maison", "maison_id"))
         if dim in dims]]


def _fk_sql(name, child, ck, parent, pk):
    on = " AND ".join(f"c.{a} = p.{b}" for a, b in zip(ck, pk))
    nn = " AND ".join(f"c.{a} IS NOT NULL" for a in ck)
    return (f"SELECT '{name}' AS relationship, CAST(count(*) AS BIGINT) AS n_violations FROM {child} c "
            f"WHERE {nn} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {on})")


@query("q_fk_violations", with_ctes(" UNION ALL ".join(_fk_sql(*x) for x in _FK)))
def q_fk_violations(spark, sf):
    """Foreign keys of the sources and the star, counted together in one shuffle.

    The lines are joined once; the keys of every frame that joins or groups and has several relationships are kept, since
    each relationship reads its own columns."""
    c = Ctx(spark, sf)
    s = c.stg
    s.keep_lines()
    frames = {"b_operation": s.operation(), "b_benef": s.beneficiaire(), "b_offre": s.offre(), "b_solde": s.solde(),
              "b_motatawi3": s.motatawi3(), "b_association": s.association(), "b_maison": s.maison(),
              "b_activite": s.activite(), "b_rapport": s.rapport(), "b_personne": s.personne(), "b_colonie": s.colonie(),
              "cin_mirror": s.cin_mirror(), "fops_a": c.a.fait_operations(), "fsolde_a": c.a.fait_solde(),
              "fmot_a": c.a.fait_motatawi3(), "fact_a": c.a.fait_activites(), "dim_temps": c.a.dim_temps,
              "dim_region_a": c.a.dim_region, "dim_benef_a": c.a.benef_keys, "dim_offre": c.a.dim_offre,
              "dim_association": c.a.dim_association, "dim_maison": c.a.dim_maison}
    cols = {f: dict.fromkeys(x for _, ch, ck, pa, pk in _FK for frame, key in ((ch, ck), (pa, pk)) if frame == f for x in key)
            for f in ("fsolde_a", "fops_a", "b_solde", "fact_a", "fmot_a", "b_activite", "b_personne")}
    with ThreadPoolExecutor(3) as pool:         # while one frame's last tasks run, another's use the cores
        frames.update(zip(cols, pool.map(lambda f: keep(frames[f].select(*cols[f]), f), cols)))
    return plain(Q.check_fks(frames, [Q.ForeignKey(n, ch, ck, pa, pk) for n, ch, ck, pa, pk in _FK]))


@query("q_cin_mirror", with_ctes("SELECT cin FROM cin_mirror"))
def q_cin_mirror(spark, sf):
    """Mirror refresh: distinct ids of active passes."""
    b = Ctx(spark, sf).stg.beneficiaire()
    return Q.refresh_mirror(b.filter(F.col("statut_pass") == "Actif"))


@query("q_cin_validation", with_ctes(f"""
SELECT p.id, p.jeune_cin, (p.jeune_cin IS NULL OR m.cin IS NOT NULL) AS accepted,
       CASE WHEN p.jeune_cin IS NULL OR m.cin IS NOT NULL THEN NULL ELSE {sq(Q.REJECT_MESSAGE)} END AS message
FROM b_personne p LEFT JOIN cin_mirror m ON p.jeune_cin = m.cin"""))
def q_cin_validation(spark, sf):
    """Association members' ids checked against the mirror."""
    s = Ctx(spark, sf).stg
    return Q.validate_ids(s.personne(), s.cin_mirror()).select("id", "jeune_cin", "accepted", "message")


def _changed_personne(spark, sf):
    """New snapshot of the members: every third member's id is reassigned to
    another customer's, every fifth is cleared (derived from the tables)."""
    s = Ctx(spark, sf).stg
    c = s.t["customer"].select(F.col("c_custkey").alias("_ck"), F.col("c_name").alias("_cn"))
    n = s.t["customer"].agg(F.count(F.lit(1))).scalar()
    p = s.personne()
    new = (p.withColumn("_tgt", (F.col("id") * 7 + 1) % n).join(c, F.col("_tgt") == F.col("_ck"), "left")
           .withColumn("jeune_cin", F.when(F.col("id") % 5 == 0, F.lit(None).cast("string"))
                       .when(F.col("id") % 3 == 0, F.col("_cn")).otherwise(F.col("jeune_cin")))
           .drop("_tgt", "_ck", "_cn"))
    return s, p, new


cte("personne_new", """
SELECT p.id, CASE WHEN p.id % 5 = 0 THEN NULL WHEN p.id % 3 = 0 THEN c.c_name ELSE p.jeune_cin END AS jeune_cin
FROM b_personne p LEFT JOIN customer c ON c.c_custkey = (p.id * 7 + 1) % (SELECT count(*) FROM customer)""")


@query("q_cin_change_validation", with_ctes(f"""
SELECT n.id, n.jeune_cin, (m.cin IS NOT NULL) AS accepted,
       CASE WHEN m.cin IS NOT NULL THEN NULL ELSE {sq(Q.REJECT_MESSAGE)} END AS message
FROM personne_new n JOIN b_personne o ON n.id = o.id
LEFT JOIN cin_mirror m ON n.jeune_cin = m.cin
WHERE n.jeune_cin IS NOT NULL AND (o.jeune_cin IS NULL OR n.jeune_cin <> o.jeune_cin)"""))
def q_cin_change_validation(spark, sf):
    """Update check: only changed, non-NULL ids are validated."""
    s, old, new = _changed_personne(spark, sf)
    return Q.validate_changes(old, new, "id", s.cin_mirror()).select("id", "jeune_cin", "accepted", "message")


@query("q_stream_cin_validation", with_ctes(f"""
SELECT e.event_id, c.c_name AS jeune_cin, (m.cin IS NOT NULL) AS accepted,
       CASE WHEN m.cin IS NOT NULL THEN NULL ELSE {sq(Q.REJECT_MESSAGE)} END AS message
FROM events e JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN cin_mirror m ON c.c_name = m.cin"""))
def q_stream_cin_validation(spark, sf):
    """Arriving volunteering registrations validated as a stream (T1): each
    event's user id is looked up (stream-static left join) and checked against
    the mirror; accepted and rejected rows land in two sinks, events of a null or
    unknown user in the rejected one."""
    from tessera.streaming.validate import validate_stream
    s = Ctx(spark, sf).stg
    schema = s.t["events"].schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf))
    cust = s.t["customer"].select(F.col("c_custkey"), F.col("c_name").alias("jeune_cin"))

    def prepare(ev):
        return ev.join(cust, ev.user_id == cust.c_custkey, "left").select(
            "event_id", "jeune_cin", F.col("c_custkey").isNotNull().alias("known"))

    ok, ko = validate_stream(spark, stream, s.cin_mirror(), prepare=prepare, known_col="known")
    acc = spark.read.parquet(ok).select("event_id", "jeune_cin", F.lit(True).alias("accepted"),
                                        F.lit(None).cast("string").alias("message"))
    rej = spark.read.parquet(ko).select("event_id", "jeune_cin", F.lit(False).alias("accepted"), "message")
    return acc.unionByName(rej)


cte("cin_events", """
SELECT e.event_id, e.user_id AS id, e.ts, c.c_custkey IS NOT NULL AS known,
       CASE WHEN e.event_id % 5 = 0 THEN NULL WHEN e.event_id % 3 = 0 THEN o.c_name ELSE c.c_name END AS jeune_cin
FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN customer o ON e.user_id + 1 = o.c_custkey""")


@query("q_stream_cin_updates", with_ctes(f"""
SELECT event_id, id, v.jeune_cin, changed, ok AS accepted, CASE WHEN NOT ok THEN {sq(Q.REJECT_MESSAGE)} END AS message
FROM (SELECT u.*, coalesce(known, false) AND (NOT changed OR m.cin IS NOT NULL) AS ok
      FROM (SELECT *, jeune_cin IS NOT NULL AND jeune_cin IS DISTINCT FROM lag(jeune_cin) OVER (PARTITION BY id ORDER BY ts, event_id) AS changed
            FROM cin_events) u LEFT JOIN cin_mirror m ON u.jeune_cin = m.cin) v"""))
def q_stream_cin_updates(spark, sf):
    """Arriving updates of members' ids (G8, T1): keyed state holds each person's last id, repeated events are dropped, only
    changed ids are checked against the mirror; events of a null or unknown user land in the rejected sink."""
    from tessera.streaming.validate import validate_updates
    s = Ctx(spark, sf).stg
    stream = (spark.readStream.schema(s.t["events"].schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf))
    cust = s.t["customer"].select(F.col("c_custkey").alias("_c"), F.col("c_name").alias("_own"))
    other = s.t["customer"].select((F.col("c_custkey") - 1).alias("_o"), F.col("c_name").alias("_other"))
    cin = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).when(F.col("event_id") % 3 == 0, F.col("_other")).otherwise(F.col("_own"))
    events = (stream.join(cust, stream.user_id == cust["_c"], "left").join(other, stream.user_id == other["_o"], "left")
              .select("event_id", F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("_c").isNotNull().alias("known"),
                      cin.alias("jeune_cin")))
    ok, ko = validate_updates(spark, events, s.cin_mirror(), known_col="known")
    cols = ["event_id", "id", "jeune_cin", "changed"]
    acc = spark.read.parquet(ok).select(*cols, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("message"))
    return acc.unionByName(spark.read.parquet(ko).select(*cols, F.lit(False).alias("accepted"), "message"))
