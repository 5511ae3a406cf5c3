"""Features and recommendation on hand-made frames."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.operators import recommend as R

D = dt.date


def _ops(spark, rows):
    return spark.createDataFrame(rows, "beneficiaire_id long, montant_reduction double, nb_operations int, "
                                       "offre_id long, date_complete date, est_weekend boolean, region string, "
                                       "secteur string, categorie string")


def test_churn_features_defaults_and_label(spark):
    benef = spark.createDataFrame([
        (1, "M", "16-18", "Actif", False, True, D(2000, 1, 1)),
        (2, "F", "19-22", "Actif", True, False, D(2000, 1, 1)),
        (3, "F", "19-22", "Actif", None, None, D(2000, 3, 1)),
    ], "beneficiaire_id long, genre string, tranche_age string, statut_pass string, en_situation_handicap boolean, "
       "est_membre_association boolean, date_inscription date")
    ops = _ops(spark, [
        (1, 10.0, 1, 1, D(2000, 6, 1), False, "R", "S", "C"),   # one observed operation
        (1, 5.0, 1, 2, D(2000, 8, 1), True, "R", "S", "C"),     # after the cutoff
        (2, 4.0, 1, 1, D(2000, 9, 1), False, "R", "S", "C"),    # only after the cutoff
    ])
    f = {r.beneficiaire_id: r for r in FE.churn_features(benef, ops, "2000-06-30", "1999-06-30", "2000-04-01",
                                                          "2000-01-01").collect()}
    assert f[1].recency == 29 and f[1].frequency == 1 and f[1].montant_std == 0.0 and f[1].churned == 0
    assert f[1].ops_last_q == 1 and f[1].ratio_ops_recent == 1.0
    assert f[2].recency == 999 and f[2].frequency == 0 and f[2].churned == 0 and f[2].en_situation_handicap == 1
    assert f[3].recency == 999 and f[3].churned == 1 and f[3].anciennete_jours == 121
    assert f[3].est_membre_association == 0


def test_behavior_std_and_distinct(spark):
    ops = _ops(spark, [(1, 1.0, 1, 1, D(2000, 1, 1), True, "A", "S1", "C1"),
                       (1, 3.0, 1, 2, D(2000, 1, 31), False, "B", "S2", "C1")])
    r = FE.behavior(ops, "2000-02-01").first()
    assert math.isclose(r.montant_std, math.sqrt(2.0)) and r.nb_offres_distinctes == 2 and r.nb_regions == 2
    assert r.duree_activite_jours == 30 and r.frequence_mensuelle == 2.0 and r.ratio_weekend == 0.5


def _rec_data(spark):
    # user 1 used offers 1, 2; user 2 used 1, 3; user 3 used every offer but 4; user 9 has no history
    ops = spark.createDataFrame([(1, 1, 2, "S"), (1, 2, 1, "S"), (2, 1, 1, "T"), (2, 3, 3, "T"),
                                 (3, 1, 1, "S"), (3, 2, 1, "S"), (3, 3, 1, "S")],
                                "beneficiaire_id long, offre_id long, nb_operations int, secteur string")
    ops = ops.union(spark.createDataFrame([(4, 4, 1, "U")], ops.schema))
    offers = spark.createDataFrame([(1, "O1", "P", "S", True), (2, "O2", "P", "S", True), (3, "O3", "P", "T", False),
                                    (4, "O4", "P", "U", True)],
                                   "offre_id long, nom_offre string, nom_partenaire string, secteur string, actif boolean")
    users = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "beneficiaire_id long")
    return users, ops, offers


def test_recommend(spark):
    users, ops, offers = _rec_data(spark)
    got = {r[0]: tuple(r[1:]) for r in R.recommend(users, ops, offers).collect()}
    assert got[3] == (4, None, None)  # only one unused offer, nothing left to fill
    assert got[9] == (1, 3, 2)  # cold start: popularity (total desc, id asc)
    assert got[1] == (3, 4, None) and got[2] == (2, 4, None)  # a positive score, then a zero score
    assert got[4] == (1, 2, 3)  # zero scores only: by id


def test_scores_include_zeros(spark):
    _, ops, _ = _rec_data(spark)
    ui = R.user_item(ops)
    got = {(r[0], r[1]): r[2] for r in R.candidate_scores(ui, R.item_similarity(ui)).collect()}
    assert set(got) == {(1, 3), (1, 4), (2, 2), (2, 4), (3, 4), (4, 1), (4, 2), (4, 3)}
    assert got[(1, 3)] > 0 and got[(1, 4)] == got[(4, 1)] == 0.0


def test_gram_hands_on_partial_sums(spark, monkeypatch):
    import pandas as pd
    rows = pd.DataFrame({R.U: [1, 1, 2, 2, 3], R.I: [10, 20, 10, 30, 20], R.N: [2, 1, 1, 3, 4]})
    whole = pd.concat(R._gram_partition(iter([rows]))).set_index(["i", "j"])["dot"]
    for name, value in (("GRAM_CELLS", 2), ("GRAM_USERS", 1), ("BLOCK", 1)):
        monkeypatch.setattr(R, name, value)
    cut = pd.concat(R._gram_partition(iter([rows.iloc[:1], rows.iloc[1:4], rows.iloc[4:]])))
    assert cut.groupby(["i", "j"])["dot"].sum().to_dict() == whole.to_dict()
    assert whole[(10, 10)] == 5 and whole[(10, 20)] == 2 and whole[(20, 20)] == 17 and (20, 30) not in whole.index


def test_gram_memory_does_not_grow_with_users():
    import tracemalloc

    import numpy as np
    import pandas as pd

    def peak(users):
        rng = np.random.default_rng(1)
        u = np.repeat(np.arange(users), 20)
        df = pd.DataFrame({R.U: u, R.I: rng.integers(1, 151, len(u)), R.N: 1}).drop_duplicates([R.U, R.I])
        batches = [df.iloc[a:a + 10_000] for a in range(0, len(df), 10_000)]
        tracemalloc.start()
        got = pd.concat(R._gram_partition(iter(batches)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got["dot"].sum() == (df.groupby(R.U)[R.N].sum() ** 2).sum()
        return most
    assert peak(40_000) < 1.6 * peak(10_000)


def _counted(spark, df):
    """``df`` and the number of its rows that were read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    return df.mapInPandas(count, df.schema), seen


def test_operations_are_read_once_for_reference_date_and_top_sector(spark):
    import datetime as dt

    from tessera.operators import features as FE
    day = dt.date(2000, 1, 1)
    rows = [(u, 1.5, 1, u % 3, day + dt.timedelta(u), u % 2 == 0, "R", "S" if u % 4 else "T") for u in range(1, 11) for _ in range(u)]
    ops = spark.createDataFrame(rows, "beneficiaire_id long, montant_reduction double, nb_operations int, offre_id long, date_complete date, "
                                      "est_weekend boolean, region string, secteur string")
    benef = spark.createDataFrame([(u, day, False) for u in range(1, 13)], "beneficiaire_id long, date_inscription date, est_membre_association boolean")
    once, seen = _counted(spark, ops)
    got = {r[0]: r for r in FE.segment_features(benef, once).collect()}
    assert seen.value == len(rows) == 55
    assert got[10].recency == 0 and got[1].recency == 9 and got[12].recency == 999 and got[12].anciennete == 10 and got[4].frequency == 4
    once, seen = _counted(spark, ops)
    sec = {r[0]: r[1] for r in R.recommend_sector(benef, once).collect()}
    assert seen.value == 55 and sec[4] == "T" and sec[5] == "S" and sec[12] == "S" and len(sec) == 12


def test_recommend_over_thousands_of_items(spark):
    # user u of 1,500 uses items 2u - 1 and 2u; user 0 uses items 1, 3 and 5
    rows = [(u, x, 1, "S") for u in range(1, 1501) for x in (2 * u - 1, 2 * u)] + [(0, x, 1, "S") for x in (1, 3, 5)]
    ops = spark.createDataFrame(rows, "beneficiaire_id long, offre_id long, nb_operations int, secteur string")
    got = {r[0]: tuple(r[1:]) for r in R.recommend(ops.select("beneficiaire_id").distinct(), ops, None).collect()}
    assert got[0] == (2, 4, 6)  # equal scores: by id
    assert got[1] == (3, 5, 4)  # two through user 0, then a zero score by id
    assert got[1500] == (1, 2, 3) and len(got) == 1501


def test_blocked_product_equals_a_plain_one(spark):
    import numpy as np
    rng = np.random.default_rng(6)
    rows = [(int(u) * 7, int(i) * 3, int(rng.integers(1, 5))) for u in range(60) for i in rng.choice(50, rng.integers(1, 6), replace=False)]
    rows += [(9_999, i * 3, 1) for i in range(50)]           # one user has used everything
    ui = spark.createDataFrame(rows, f"{R.U} long, {R.I} long, {R.N} long")
    sim = R.item_similarity(ui)
    s = {(r.i, r.j): r.similarity for r in sim.collect()}
    items, mine = sorted({i for _, i, _ in rows}), {}
    for u, i, n in rows:
        mine.setdefault(u, {})[i] = n
    want = {(u, c): sum(n * s.get((i, c), 0.0) for i, n in own.items()) for u, own in mine.items() for c in items if c not in own}
    for user_block, item_block in ((512, 1024), (7, 9), (100, 5)):
        got = {(r[0], r[1]): r[2] for r in R.blocked_scores(ui, sim, None, user_block, item_block).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-8 for k in want)
        best = {}
        for r in R.blocked_scores(ui, sim, 3, user_block, item_block).collect():
            best.setdefault(r[0], []).append((-r[2], r[1]))
        for u in mine:
            top = sorted((-round(v, 9), c) for (x, c), v in want.items() if x == u)[:3]
            assert sorted(best.get(u, []))[:3] == [(a, c) for a, c in top] or np.allclose([a for a, _ in sorted(best[u])[:3]], [a for a, _ in top], atol=2e-9)


def test_labels_and_sector(spark):
    users, ops, offers = _rec_data(spark)
    recs = spark.createDataFrame([(1, 3, 4, None)], "beneficiaire_id long, rec_1 long, rec_2 long, rec_3 long")
    lab = R.label(recs, offers).first()
    assert lab.recommandation_offre_1 == R.DEFAULT_LABELS[0]  # inactive offer: slot default
    assert lab.recommandation_offre_2 == "O4 (P)" and lab.recommandation_offre_3 == R.MISSING_LABELS[2]
    sec = {r[0]: r[1] for r in R.recommend_sector(users, ops).collect()}
    assert sec[2] == "T" and sec[9] == "S"  # favourite, else the most frequent sector overall


def test_similarity_is_cosine(spark):
    _, ops, _ = _rec_data(spark)
    sim = {(r.i, r.j): r.similarity for r in R.item_similarity(R.user_item(ops)).collect()}
    # item 1 = (2, 1, 1, 0), item 3 = (0, 3, 1, 0) over users 1..4
    assert math.isclose(sim[(1, 3)], (3 + 1) / (math.sqrt(6) * math.sqrt(10)))
    assert math.isclose(sim[(1, 1)], 1.0) and (1, 4) not in sim
