"""SQL text of the test binding, dimensions and facts, for the DuckDB oracle.

Each CTE is written independently of the DataFrame code in
``tessera.sources.bindings`` / ``tessera.operators`` (same definitions, plain
ANSI-ish SQL). ``with_ctes(body, *names)`` resolves dependencies and emits one
``WITH`` statement.
"""

from __future__ import annotations

import re

from tessera.functions.columns import DAY_NAMES, MONTH_NAMES, ZONE_A, ZONE_A_ELSE, ZONE_B, ZONE_B_ELSE
from tessera.sources.bindings import (AS_OF, CAL_END, CAL_START, DEFAULT_TEMPS_ID, DOMAINES, NIVEAU_ETUDES,
                                      ROLES, SAISONS, STATUT_ASSOCIATION, STATUT_DOSSIER, STATUT_VOLONTARIAT)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def pick(values: list[str], expr: str) -> str:
    return "CASE (" + expr + f") % {len(values)} " + " ".join(
        f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values)) + " END"


def exact_age(b: str, at: str) -> str:
    return (f"((year({at}) - year({b})) - CASE WHEN month({at}) < month({b}) OR "
            f"(month({at}) = month({b}) AND day({at}) < day({b})) THEN 1 ELSE 0 END)")


def age_band(b: str, at: str, rules: str) -> str:
    y = f"(year({at}) - year({b}))"
    s = (f"CASE WHEN {y} BETWEEN 16 AND 18 THEN '16-18' WHEN {y} BETWEEN 19 AND 22 THEN '19-22' "
         f"WHEN {y} BETWEEN 23 AND 25 THEN '23-25' ")
    return s + ("ELSE '26-30' END" if rules == "a" else f"WHEN {y} BETWEEN 26 AND 30 THEN '26-30' ELSE '+30' END")


def zone(col: str, rules: str) -> str:
    if rules == "a":
        parts = [f"WHEN {col} IN ({', '.join(q(m) for m in members)}) THEN {q(name)}" for name, members in ZONE_A.items()]
        return "CASE " + " ".join(parts) + f" ELSE {q(ZONE_A_ELSE)} END"
    parts = []
    for prefixes, name in ZONE_B:
        cond = " OR ".join(f"{col} LIKE {q(p + '%')}" for p in prefixes)
        parts.append(f"WHEN {cond} THEN {q(name)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(ZONE_B_ELSE)} END"


def date_key(e: str) -> str:
    return f"CAST(year({e}) * 10000 + month({e}) * 100 + day({e}) AS INTEGER)"


def day_name(e: str) -> str:
    return "CASE isodow(" + e + ") " + " ".join(f"WHEN {i + 1} THEN {q(n)}" for i, n in enumerate(DAY_NAMES)) + " END"


def month_name(e: str) -> str:
    return "CASE month(" + e + ") " + " ".join(f"WHEN {i + 1} THEN {q(n)}" for i, n in enumerate(MONTH_NAMES)) + " END"


def calendar_select(series: str) -> str:
    """Calendar columns over a one-column relation ``series(dc)``."""
    return f"""SELECT {date_key('dc')} AS temps_id, dc AS date_complete, day(dc) AS jour, month(dc) AS mois,
      year(dc) AS annee, quarter(dc) AS trimestre, {day_name('dc')} AS nom_jour, {month_name('dc')} AS nom_mois,
      isodow(dc) AS jour_semaine, weekofyear(dc) AS semaine_annee, isodow(dc) >= 6 AS est_weekend
    FROM {series}"""


AS_OF_SQL = d(AS_OF)

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


# ---- binding -------------------------------------------------------------
cte("geo", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
cte("b_benef", f"""
SELECT c_custkey AS id, c_name AS cin, c_name AS nom, c_mktsegment AS prenom,
       CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS genre,
       CAST(DATE '1970-01-01' + CAST((c_custkey * 13) % 6200 AS INTEGER) AS DATE) AS date_naissance,
       n_name AS ville, r_name AS region, 'Marocaine' AS nationalite, c_mktsegment AS type_statut,
       (c_custkey % 33 = 0) AS en_situation_handicap, f.date_inscription,
       CASE WHEN {exact_age("CAST(DATE '1970-01-01' + CAST((c_custkey * 13) % 6200 AS INTEGER) AS DATE)", AS_OF_SQL)} <= 30
            THEN 'Actif' ELSE 'Desactive' END AS statut_pass
FROM customer JOIN geo ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS date_inscription FROM orders GROUP BY o_custkey) f
  ON c_custkey = f.o_custkey""")
cte("b_catalogue", """
SELECT p_brand, p_type, price, CAST(row_number() OVER (ORDER BY p_brand, p_type) AS BIGINT) AS id
FROM (SELECT p_brand, p_type, min(p_retailprice) AS price FROM part GROUP BY p_brand, p_type) c""")
cte("b_offre", """
SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE p_brand END AS nom_partenaire, p_type AS categorie,
       p_brand || '/' || p_type AS nom_offre,
       CASE id % 3 WHEN 0 THEN 'Gratuite' WHEN 1 THEN 'Tarif fixe' ELSE 'Reduction' END AS type_avantage,
       CAST(CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN id % 50 + 10 ELSE (id % 5 + 1) * 10 END AS DECIMAL(10,2)) AS valeur_avantage,
       CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'DH' ELSE '%' END AS unite_avantage,
       CASE WHEN id % 7 = 0 THEN 'sur devis' ELSE CAST(CAST(price AS DECIMAL(10,2)) AS VARCHAR) END AS tarif_pass_jeunes_txt,
       CAST(price AS DECIMAL(10,2)) AS tarif_public, CASE WHEN id % 6 <> 0 THEN 'Offre ' || p_type END AS description,
       CASE WHEN id % 4 = 0 THEN 'Sur presentation du pass' END AS conditions,
       CAST(CASE WHEN id % 3 = 1 THEN id % 20 + 5 END AS DECIMAL(10,2)) AS montant_a_debiter,
       CAST(CAST(price AS DECIMAL(10,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(10,2)) AS montant_a_payer,
       CAST((id % 6) * 100 AS DECIMAL(10,2)) AS solde_initial,
       CAST(CASE WHEN id % 6 <> 0 THEN (id % 6) * 10 END AS DECIMAL(10,2)) AS solde_mensuel,
       CASE WHEN id % 10 = 5 THEN 'Multi-villes' ELSE n_name END AS ville,
       CASE WHEN id % 5 = 0 THEN 'National' ELSE r_name END AS region, (id % 10 <> 0) AS actif
FROM b_catalogue JOIN geo ON id % 25 = n_nationkey""")
cte("b_lines", """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, o_custkey, o_orderdate, po.offre_id, po.categorie,
       sg.n_name AS ville
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN (SELECT p_partkey, id AS offre_id, part.p_type AS categorie FROM part JOIN b_catalogue c
      ON part.p_brand = c.p_brand AND part.p_type = c.p_type) po ON l_partkey = po.p_partkey
JOIN (SELECT s_suppkey, n_name FROM supplier JOIN geo ON s_nationkey = n_nationkey) sg ON l_suppkey = sg.s_suppkey""")
cte("b_operation", """
SELECT l_orderkey AS src_order, l_linenumber AS src_line, o_custkey AS beneficiaire_id, offre_id, categorie,
       CAST(o_orderdate AS DATE) AS date_operation,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(10,2)) AS montant_reduction,
       ville, 1 AS nb_operations
FROM b_lines""")
cte("b_solde", """
SELECT o_custkey AS beneficiaire_id, offre_id, year(o_orderdate) AS annee,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS credit_initial,
       CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2)))
            AS DECIMAL(12,2)) AS credit_restant,
       make_date(year(o_orderdate), 1, 1) AS date_renouvellement
FROM b_lines GROUP BY o_custkey, offre_id, year(o_orderdate)""")
cte("b_motatawi3", f"""
SELECT event_id AS id, user_id AS beneficiaire_id, CAST(year(ts) AS VARCHAR) AS edition, cg.r_name AS region,
       event_type AS domaine_volontariat, {pick(NIVEAU_ETUDES, 'event_id')} AS niveau_etudes,
       'MT' || CAST(event_id AS VARCHAR) AS code_suivi, CAST(ts AS DATE) AS date_inscription,
       {pick(STATUT_DOSSIER, 'event_id')} AS statut_dossier, {pick(STATUT_VOLONTARIAT, 'event_id')} AS statut
FROM events LEFT JOIN (SELECT c_custkey, r_name FROM customer JOIN geo ON c_nationkey = n_nationkey) cg
  ON user_id = cg.c_custkey""")
cte("b_maison", """
SELECT CAST(n_nationkey AS BIGINT) AS id, 'Maison ' || n_name AS nom, n_name AS ville, r_name AS region,
       n_nationkey * 10 + 50 AS capacite_accueil,
       CASE WHEN n_nationkey % 7 = 0 THEN 'Renovation' ELSE 'Active' END AS statut,
       CAST(DATE '1980-01-01' + CAST(n_nationkey * 211 AS INTEGER) AS DATE) AS date_ouverture
FROM geo""")
cte("b_association", f"""
SELECT s_suppkey AS id, s_name AS nom, CASE WHEN s_suppkey % 2 = 0 THEN 'Culturelle' ELSE 'Sportive' END AS type,
       {pick(DOMAINES, 's_suppkey')} AS domaine_activite, CAST(s_nationkey AS BIGINT) AS maison_jeunes_id,
       CAST(DATE '1990-01-01' + CAST((s_suppkey * 37) % 3000 AS INTEGER) AS DATE) AS date_creation,
       {pick(STATUT_ASSOCIATION, 's_suppkey')} AS statut, CAST(s_suppkey % 90 + 10 AS INTEGER) AS nb_membres
FROM supplier""")
cte("b_colonie", f"""
SELECT s_suppkey AS id, 'Colonie ' || s_name AS nom, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE n_name END AS ville,
       r_name AS region, {pick(SAISONS, 's_suppkey')} AS saison, CAST(s_suppkey % 2 + 2000 AS INTEGER) AS annee,
       CAST(s_suppkey % 14 + 7 AS INTEGER) AS duree_jours
FROM supplier JOIN geo ON s_nationkey = n_nationkey""")
cte("b_activite", """
SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS association_id,
       CAST(c_nationkey AS BIGINT) AS maison_jeunes_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 97 END AS colonie_vacances_id,
       o_orderpriority AS type_activite, o_orderstatus AS statut,
       CAST(o_totalprice AS DECIMAL(12,2)) AS budget, CAST(o_orderdate AS DATE) AS date_debut,
       CASE WHEN ls.last_ship >= o_orderdate THEN CAST(ls.last_ship AS DATE) END AS date_fin
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey) ls
  ON o_orderkey = ls.l_orderkey
JOIN customer ON o_custkey = c_custkey""")
cte("b_rapport", """
SELECT l_orderkey AS activite_id, CAST(l_quantity AS INTEGER) AS nb_participants,
       CAST(l_tax AS DECIMAL(5,2)) AS taux_satisfaction, CAST(l_extendedprice AS DECIMAL(12,2)) AS budget_consomme
FROM lineitem""")
cte("b_personne", f"""
SELECT u.user_id AS id, c_name AS jeune_cin, {pick(ROLES, 'u.user_id')} AS role, 'Membre_Bureau' AS type_personne,
       CASE WHEN u.user_id % 4 = 0 THEN 'Inactif' ELSE 'Actif' END AS statut, u.user_id % 90 AS association_id,
       CASE WHEN u.user_id % 2 = 0 THEN u.user_id % 27 END AS maison_jeunes_id
FROM (SELECT DISTINCT user_id FROM events) u JOIN customer ON u.user_id = c_custkey""")
cte("cin_mirror", "SELECT DISTINCT cin FROM b_benef WHERE statut_pass = 'Actif'")

# ---- dimensions ------------------------------------------------------------
cte("dim_temps", calendar_select(
    f"(SELECT CAST(g AS DATE) AS dc FROM generate_series({d(CAL_START)}, {d(CAL_END)} + INTERVAL 1 DAY, "
    f"INTERVAL 1 DAY) t(g)) s"))
for _r in ("a", "b"):
    if _r == "a":
        _src = " UNION ".join(f"SELECT ville, region FROM {t} WHERE ville IS NOT NULL AND region IS NOT NULL"
                              for t in ("b_benef", "b_maison", "b_offre"))
    else:
        _src = " UNION ".join(f"SELECT ville, region FROM {t} WHERE ville IS NOT NULL AND ville <> ''"
                              for t in ("b_benef", "b_offre", "b_maison", "b_colonie"))
    cte(f"dim_region_{_r}", f"""
SELECT CAST(row_number() OVER (ORDER BY ville NULLS FIRST, region NULLS FIRST) AS BIGINT) AS region_id,
       ville, region, {zone('region', _r)} AS zone_geo
FROM ({_src}) v""")
    cte(f"dim_benef_{_r}", f"""
SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS beneficiaire_id, id AS source_id, b.cin, nom, prenom, genre,
       date_naissance, nationalite, type_statut, en_situation_handicap, statut_pass,
       {age_band('date_naissance', AS_OF_SQL, _r)} AS tranche_age, date_inscription,
       (m.cin IS NOT NULL) AS est_membre_association
FROM b_benef b LEFT JOIN (SELECT DISTINCT jeune_cin AS cin FROM b_personne WHERE jeune_cin IS NOT NULL) m
  ON b.cin = m.cin""")
cte("dim_offre", """
SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS offre_id, id AS source_id,
       coalesce(nom_partenaire, 'Non precise') AS nom_partenaire, categorie AS secteur, categorie, nom_offre,
       type_avantage, valeur_avantage, unite_avantage, TRY_CAST(tarif_pass_jeunes_txt AS DECIMAL(10,2)) AS tarif_pass_jeunes,
       tarif_public, description, conditions, montant_a_debiter, montant_a_payer, solde_initial, solde_mensuel,
       ville AS ville_offre, region AS region_offre, actif
FROM b_offre""")
cte("dim_association", """
SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS association_id, id AS source_id, nom, type,
       domaine_activite, statut, nb_membres, date_creation
FROM b_association""")
cte("dim_maison", """
SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS maison_id, id AS source_id, nom, capacite_accueil,
       statut, date_ouverture
FROM b_maison""")


# ---- facts -------------------------------------------------------------------
def _temps(alias_date: str, rules: str) -> tuple[str, str]:
    """(select expression, join clause) of the calendar key."""
    if rules == "b":
        return date_key(alias_date), ""
    return (f"coalesce(t.temps_id, {DEFAULT_TEMPS_ID})",
            f"LEFT JOIN dim_temps t ON t.date_complete = {alias_date}")


def _region_rel(rules: str, keys: list[str], compat: bool) -> str:
    cols = ", ".join(keys)
    if compat:
        return f"(SELECT {cols}, region_id FROM dim_region_{rules})"
    return f"(SELECT {cols}, min(region_id) AS region_id FROM dim_region_{rules} GROUP BY {cols})"


for _r in ("a", "b"):
    for _compat in (False, True):
        _sfx = f"{_r}{'_compat' if _compat else ''}"
        _t_sel, _t_join = _temps("o.date_operation", _r)
        cte(f"fops_{_sfx}", f"""
SELECT {_t_sel} AS temps_id,
       CAST(coalesce(r.region_id, (SELECT min(region_id) FROM dim_region_{_r})) AS BIGINT) AS region_id,
       b.beneficiaire_id, f.offre_id, o.montant_reduction, o.nb_operations
FROM b_operation o JOIN dim_benef_{_r} b ON b.source_id = o.beneficiaire_id
JOIN dim_offre f ON f.source_id = o.offre_id
{_t_join}
LEFT JOIN {_region_rel(_r, ['ville'], _compat)} r ON r.ville = o.ville""")
        _t_sel, _t_join = _temps("m.date_inscription", _r)
        cte(f"fmot_{_sfx}", f"""
SELECT m.id AS source_id, {_t_sel} AS temps_id,
       CAST(coalesce(r.region_id, (SELECT min(region_id) FROM dim_region_{_r})) AS BIGINT) AS region_id,
       b.beneficiaire_id, m.edition, m.domaine_volontariat, m.niveau_etudes, m.statut_dossier, m.statut
FROM b_motatawi3 m JOIN dim_benef_{_r} b ON b.source_id = m.beneficiaire_id
{_t_join}
LEFT JOIN {_region_rel(_r, ['region'], _compat)} r ON r.region = m.region""")
    _t_sel, _t_join = _temps("s.date_renouvellement", _r)
    cte(f"fsolde_{_r}", f"""
SELECT {_t_sel} AS temps_id, b.beneficiaire_id, f.offre_id, CAST(s.annee AS INTEGER) AS annee,
       s.credit_initial, s.credit_restant, s.credit_initial - s.credit_restant AS credit_consomme
FROM b_solde s JOIN dim_benef_{_r} b ON b.source_id = s.beneficiaire_id
JOIN dim_offre f ON f.source_id = s.offre_id
{_t_join}""")
    _t_sel, _t_join = _temps("a.date_debut", _r)
    _j = "LEFT" if _r == "a" else "INNER"
    _rid = (f"coalesce(r.region_id, (SELECT min(region_id) FROM dim_region_a))" if _r == "a" else "r.region_id")
    _dur = "coalesce(datediff('day', a.date_debut, a.date_fin), 1)" if _r == "a" else "datediff('day', a.date_debut, a.date_fin)"
    cte(f"fact_{_r}", f"""
SELECT a.id AS source_id, {_t_sel} AS temps_id, CAST({_rid} AS BIGINT) AS region_id, da.association_id, dm.maison_id,
       a.type_activite, a.statut, a.budget,
       coalesce(rap.nb_participants, 0) AS nb_participants,
       coalesce(rap.taux_satisfaction, CAST(0 AS DECIMAL(5,2))) AS taux_satisfaction,
       coalesce(rap.budget_consomme, CAST(0 AS DECIMAL(12,2))) AS budget_consomme,
       {_dur} AS duree_jours
FROM b_activite a
LEFT JOIN b_rapport rap ON rap.activite_id = a.id
JOIN dim_association da ON da.source_id = a.association_id
JOIN dim_maison dm ON dm.source_id = a.maison_jeunes_id
{_j} JOIN b_maison sm ON sm.id = a.maison_jeunes_id
{_t_join}
{_j} JOIN dim_region_{_r} r ON r.ville = sm.ville AND r.region = sm.region""")

_NAME = re.compile(r"\b([a-z_][a-z0-9_]*)\b")


def deps(name: str) -> list[str]:
    body = CTES[name]
    return [t for t in dict.fromkeys(_NAME.findall(body)) if t in CTES and t != name]


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it references (transitively), in dependency order."""
    table = dict(CTES)
    if extra:
        table.update(extra)
    order: list[str] = []

    def refs(text):
        return [t for t in dict.fromkeys(_NAME.findall(text)) if t in table]

    def visit(n, stack=()):
        if n in order:
            return
        for dep in refs(table[n]):
            if dep != n and dep not in stack:
                visit(dep, stack + (n,))
        order.append(n)

    for n in refs(body):
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({table[n]})" for n in order) + "\n" + body
