"""Model pieces: exact split, SMOTE parity, scaling, reports, choose k, naming, nearest centroid
(M3-M5, M11, M12, M14, M16, W7, A14)."""

import math

from pyspark.sql import functions as F

from tessera.operators import churn as C
from tessera.operators import scoring as SC
from tessera.operators import segments as S


def _frame(spark, n0=80, n1=20):
    rows = [(i, 0, float(i % 7), float(i % 5)) for i in range(n0)] + \
           [(1000 + i, 1, 10.0 + (i % 3), 5.0 + (i % 4) * 0.5) for i in range(n1)]
    return spark.createDataFrame(rows, "beneficiaire_id long, churned int, a double, b double")


def test_stratified_split_exact_and_reproducible(spark):
    df = _frame(spark)
    s1 = C.stratified_split(df).groupBy("churned", "split").count().collect()
    got = {(r.churned, r.split): r["count"] for r in s1}
    assert got == {(0, "test"): 16, (0, "train"): 64, (1, "test"): 4, (1, "train"): 16}
    ids1 = sorted(r.beneficiaire_id for r in C.stratified_split(df).filter("split = 'test'").collect())
    ids2 = sorted(r.beneficiaire_id for r in C.stratified_split(df).filter("split = 'test'").collect())
    assert ids1 == ids2


def test_smote_parity_and_segment(spark):
    df = _frame(spark)
    out = C.smote(df, ["a", "b"], k=3)
    counts = {r.churned: r["count"] for r in out.groupBy("churned").count().collect()}
    assert counts == {0: 80, 1: 80}
    synth = out.filter(F.col("beneficiaire_id") < 0).collect()
    # synthetic points lie inside the minority's bounding box
    assert all(10.0 <= r.a <= 12.0 and 5.0 <= r.b <= 6.5 for r in synth)


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double")
    z = C.standardize(df, df, ["x", "y"]).collect()
    assert [r.x for r in z] == [-1.0, 1.0] and [r.y for r in z] == [0.0, 0.0]


def test_reports_on_known_scores(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.4, 1), (0.2, 0), (0.2, 0)]
    df = spark.createDataFrame(rows, "p double, churned int")
    m = SC.metrics_table(df, "p", "churned", "m").first()
    assert (m.accuracy, m.precision, m.recall) == (round(4 / 6, 6), round(2 / 3, 6), round(2 / 3, 6))
    assert math.isclose(m.auc, 8 / 9, abs_tol=1e-6)  # 8 of 9 (pos, neg) pairs ordered
    cm = {(r.label, r.predicted): r.n for r in SC.confusion(df, "p", "churned").collect()}
    assert cm == {(1, 1): 2, (0, 1): 1, (1, 0): 1, (0, 0): 2}
    roc = [(r.threshold, r.tpr, r.fpr) for r in SC.roc_points(df, "p", "churned").orderBy(F.desc("threshold")).collect()]
    assert roc[-1][1:] == (1.0, 1.0)
    rep = {r.classe: r for r in SC.class_report(df, "p", "churned").collect()}
    assert rep["Churne"].support == 3 and rep["weighted avg"].support == 6


def test_choose_k_preference(spark):
    def pick(s4):
        sweep = spark.createDataFrame([(2, 10.0, 0.50), (3, 8.0, 0.60), (4, 7.0, s4)], "k int, inertia double, "
                                                                                     "silhouette double")
        return S.choose_k(sweep).first().chosen_k
    assert pick(0.89 * 0.60) == 3 and pick(0.91 * 0.60) == 4


def test_segment_names_beyond_list(spark):
    rows = [(c, float(c + 1), 1.0) for c in range(9) for _ in range(2)]
    df = spark.createDataFrame(rows, "cluster int, frequency double, monetary double")
    names = {r.cluster: r.segment for r in S.name_segments(df).select("cluster", "segment").distinct().collect()}
    assert names[8] == S.SEGMENT_NAMES[0] and names[1] == "Segment_8" and names[0] == "Segment_9"
    rad = S.radar(df.withColumn("segment", F.col("cluster").cast("string")), cols=["frequency"]).collect()
    assert max(r.frequency_norm for r in rad) < 1.0 and min(r.frequency_norm for r in rad) == 0.0


def test_assign_nearest_tie_goes_to_lower_id(spark):
    cents = spark.createDataFrame([(2, [0.0, 0.0]), (1, [2.0, 0.0])], "label int, centroid array<double>")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.9, 0.1])], "vec_id int, embedding array<float>")
    got = {r.vec_id: (r.cluster, round(r.distance, 6)) for r in
           S.assign_nearest(vecs, "embedding", S.centroid_array(cents, "label", "centroid")).collect()}
    assert got[1] == (1, 1.0) and got[2][0] == 1


def test_neighbours_are_exact_and_synthetic_keys_unique(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    pts = [(i, 1, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(60)] + [(100 + i, 1, [9.0, 0.0, 0.0]) for i in range(10)]
    rows = spark.createDataFrame([(i, y, *p) for i, y, p in pts], "beneficiaire_id long, churned int, a double, b double, c double")
    got = {}
    for r in C.nearest_neighbours(rows, ["a", "b", "c"]).collect():
        got.setdefault(r["_a"], {})[r["_r"]] = r["_b"]
    for i, _, p in pts:
        best = sorted((sum((x - y) ** 2 for x, y in zip(p, q)), j) for j, _, q in pts if j != i)[:5]
        assert [got[i][r] for r in range(1, 6)] == [j for _, j in best]
    majority = spark.range(1000, 4500).selectExpr("id AS beneficiaire_id", "0 AS churned", "1D AS a", "2D AS b", "3D AS c")
    out = C.smote(rows.unionByName(majority), ["a", "b", "c"])
    n = {r[0]: (r[1], r[2]) for r in out.groupBy("churned").agg(F.count("*"), F.countDistinct("beneficiaire_id")).collect()}
    assert n == {0: (3500, 3500), 1: (3500, 3500)}


def test_split_and_folds_are_stratified(spark):
    df = spark.range(1500).selectExpr("id AS beneficiaire_id", "CAST(id % 5 = 0 AND id < 1498 AS INT) AS churned")
    split = C.stratified_split(df).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 300, "train": 1200}
    folds = C.stratified_folds(df, 5).groupBy("churned", "_fold").count().collect()
    for cls in (0, 1):
        sizes = [r["count"] for r in folds if r["churned"] == cls]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_roc_keeps_scores_apart_that_differ_by_less_than_a_millionth(spark):
    rows = [(0.5 + i * 1e-9, i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "p double, churned int")
    got = sorted((r.threshold, r.tpr, r.fpr) for r in SC.roc_points(df, "p", "churned").collect())
    assert [g[0] for g in got] == [p for p, _ in rows]
    assert got[0][1:] == (1.0, 1.0) and got[5][1:] == (round(1 / 3, 9), 0.0)
    assert math.isclose(SC.auc(df, "p", "churned").first()[0], 6 / 9)


def test_model_queries_use_full_settings_and_validate_the_winner(spark, monkeypatch):
    from tessera.plans import q_ml
    assert q_ml.SET == C.Settings() and (C.Settings().rf_trees, C.Settings().gb_iter) == (500, 500)
    assert (q_ml.SCORING.stack_rf_trees, q_ml.SCORING.stack_gb_iter, q_ml.SCORING.stack_xgb_depth) == (500, 500, 7)
    small = C.Settings.small()
    df = C.class_weights(_frame(spark, 40, 40)).repartition(2).persist()
    table, best, fitted = C.compare(df, df, ["a", "b"], small, 80)
    rows = {r.model: r for r in table.collect()}
    assert len(rows) == 5 and C.STACK in rows and [m for m, r in rows.items() if r.best] == [best]
    assert len(fitted[C.STACK][0]) == 4  # assembler and three bases
    linear = dict(C.importances(fitted["Logistic Regression"], ["a", "b"]))
    assert set(linear) == {"a", "b"} and min(linear.values()) >= 0
    used = []
    fit = C.fit_named
    monkeypatch.setattr(C, "fit_named", lambda name, *a: used.append(name) or fit(name, *a))
    assert [f for f, _ in C.cross_val_f1("Logistic Regression", df, ["a", "b"], small)] == [0, 1, 2, 3, 4]
    assert used == ["Logistic Regression"] * 5


def test_neighbours_search_all_rows_over_many_blocks(spark):
    import inspect

    import numpy as np
    assert "max_fit_rows" not in inspect.signature(C.smote).parameters
    rng = np.random.default_rng(5)
    pts = rng.integers(0, 30, (300, 3)).astype(float)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "beneficiaire_id long, a double, b double, c double")
    got = C.nearest_neighbours(rows.repartition(3), ["a", "b", "c"], block=17).collect()
    assert len(got) == 1500
    near = {(r["_a"], r["_r"]): (r["_b"], r["_nv"]) for r in got}
    for i, p in enumerate(pts):
        best = sorted((float(((p - q) ** 2).sum()), j) for j, q in enumerate(pts) if j != i)[:5]
        assert [near[i, r][0] for r in range(1, 6)] == [j for _, j in best]
        assert near[i, 1][1] == pts[best[0][1]].tolist()


def test_segments_take_the_chosen_k_and_all_starts(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from tessera.operators import kmeans
    from tessera.plans import q_ml
    rows = [(i, Vectors.dense([10.0 * (i % 4), 1.0 * (i % 3)]), float(i % 4), 1.0) for i in range(48)]
    vec = spark.createDataFrame(rows, ["beneficiaire_id", "features", "frequency", "monetary"])
    fits = []
    lloyd = kmeans.lloyd
    monkeypatch.setattr(kmeans, "lloyd", lambda b, models, tol: fits.extend((m.k, m.start, m.max_iter) for m in models) or lloyd(b, models, tol))
    got = S.kmeans_sweep(vec, [2, 3])
    assert sorted(fits) == [(k, r, 300) for k in (2, 3) for r in range(10)]
    assert got.count() == 2
    fits.clear()
    sweep = spark.createDataFrame([(3, 9.0, 0.1), (5, 5.0, 0.8)], "k int, inertia double, silhouette double")
    asked = []
    monkeypatch.setattr(S, "kmeans_sweep", lambda v, ks, **kw: asked.append((list(ks), kw)) or sweep)
    monkeypatch.setattr(q_ml, "_vectors", lambda ctx: (vec, vec.drop("features")))
    out = q_ml.q_segments(spark, "/none")
    assert asked == [(list(range(2, 9)), {})]
    assert fits and {(k, i) for k, _, i in fits} == {(5, 500)} and len(fits) == 20
    assert out.count() == 48


def _plain_lloyd(x, centres, max_iter, tol):
    """K-Means from given centres, one model at a time."""
    import numpy as np
    for _ in range(max_iter):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        after = np.stack([x[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        shift, centres = ((after - centres) ** 2).sum(), after
        if shift <= tol * x.var(axis=0).mean():
            break
    return float(((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()), centres


def test_models_fitted_together_equal_single_fits(spark, monkeypatch):
    import copy

    import numpy as np

    from tessera.operators import kmeans
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 1.0, (150, 3)) for c in ((0, 0, 0), (6, 0, 2), (0, 7, 0), (5, 5, 5))] + [np.zeros((20, 3))])
    vec = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "beneficiaire_id long, features array<double>")
    begun, passes = [], []
    lloyd, one_pass = kmeans.lloyd, kmeans._pass
    monkeypatch.setattr(kmeans, "lloyd", lambda b, models, tol: begun.extend(copy.deepcopy(models)) or lloyd(b, models, tol))
    monkeypatch.setattr(kmeans, "_pass", lambda b, models, w: passes.append(len(models)) or one_pass(b, models, w))
    blocks = kmeans.keep(vec.repartition(3), "beneficiaire_id")
    models = kmeans.fit_many(blocks, [2, 4, 5], 4, max_iter=30)
    assert len(models) == 12 and len(passes) == max(m.iterations for m in models) + 1 and passes[0] == 12 > passes[-1]
    for m, first in zip(models, begun):
        assert len(first.centres) == m.k and all((x == c).all(axis=1).any() for c in first.centres)     # starts are rows
        assert len(np.unique(first.centres, axis=0)) == m.k
        inertia, centres = _plain_lloyd(x, first.centres, 30, 1e-4)
        assert math.isclose(m.inertia, inertia, rel_tol=1e-9) and np.allclose(m.centres, centres)
    best = kmeans.best_per_k(models)
    assert best[4].inertia == min(m.inertia for m in models if m.k == 4)
    # all rows, one by one, against their clusters
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for m, got in zip(best.values(), kmeans.silhouettes(blocks, list(best.values()))):
        lab = ((x[:, None] - m.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = []
        for i in range(len(x)):
            means = {c: d[i][(lab == c) & (np.arange(len(x)) != i)].mean() for c in set(lab.tolist()) if (lab == c).sum() > (c == lab[i])}
            if lab[i] not in means:
                want.append(0.0)
                continue
            a, b = means.pop(lab[i]), min(means.values())
            want.append((b - a) / max(a, b) if max(a, b) else 0.0)
        assert math.isclose(got, sum(want) / len(want), abs_tol=1e-9)
    few = kmeans.silhouettes(blocks, [best[4]], rows=200)[0]
    assert abs(few - kmeans.silhouettes(blocks, [best[4]])[0]) < 0.1
    monkeypatch.setattr(kmeans, "FEW_TASKS", 1)             # the other way to add up, over several tasks
    monkeypatch.setattr(kmeans, "TASK_ROWS", 200)
    again = kmeans.fit_many(kmeans.keep(vec.repartition(5), "beneficiaire_id"), [2, 4, 5], 4, max_iter=30)
    assert [(m.iterations, round(m.inertia, 6)) for m in again] == [(m.iterations, round(m.inertia, 6)) for m in models]
    assert kmeans.fit_many(kmeans.keep(vec.limit(0), "beneficiaire_id"), [2], 2) == []


def test_passes_over_many_rows_have_tasks_by_cores(spark, monkeypatch):
    from tessera.operators import kmeans
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(kmeans, "TASK_ROWS", 10)
    vec = spark.range(2000).selectExpr("id AS beneficiaire_id", "array(CAST(id % 7 AS DOUBLE), CAST(id % 11 AS DOUBLE)) AS features")
    for parts in (40, 1):
        blocks = kmeans.keep(vec.repartition(parts), "beneficiaire_id")
        assert blocks.rdd.getNumPartitions() == kmeans.CORE_TASKS * cores if parts > 1 else blocks.rdd.getNumPartitions() > 1
        assert sorted(i for ids, _ in kmeans._blocks(blocks.toArrow().to_batches()) for i in ids) == list(range(2000))
    assert "cache" not in blocks._jdf.rdd().toDebugString().lower().split("checkpoint")[-1]     # nothing behind the blocks' files
    monkeypatch.setattr(kmeans, "MOST_ROWS", 100)            # tasks do not grow without bound
    assert kmeans.keep(vec.repartition(40), "beneficiaire_id").rdd.getNumPartitions() == 20


def _plain_boosting(x, y, st, rounds):
    """Second-order boosting by trying every split of every node, without bins, samples or jobs: margins after each round."""
    import numpy as np
    p0 = y.mean()
    f, out = np.full(len(y), math.log(p0 / (1 - p0))), []

    def pull(g):
        return math.copysign(max(abs(g) - st.l1, 0.0), g)

    def points(rows, g, h):
        return pull(g[rows].sum()) ** 2 / (h[rows].sum() + st.l2) if st.newton else g[rows].sum() ** 2 / len(rows)

    def leaf(rows, g, h):
        return -pull(g[rows].sum()) / (h[rows].sum() + st.l2) if st.newton else -g[rows].sum() / h[rows].sum()

    def grow(rows, g, h, depth, into):
        best = (1e-9, None)
        if depth < st.depth and len(rows) >= st.min_split:
            for j in range(x.shape[1]):
                for cut in sorted(set(x[rows, j]))[:-1]:
                    a, b = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    gain = points(a, g, h) + points(b, g, h) - points(rows, g, h)
                    gain = gain / 2 - st.gamma if st.newton else gain
                    fits = min(len(a), len(b)) >= st.min_leaf and (not st.newton or min(h[a].sum(), h[b].sum()) >= st.min_child)
                    if fits and gain > best[0] + 1e-9:
                        best = (gain, (a, b))
        if best[1] is None:
            into[rows] = leaf(rows, g, h)
        else:
            for part in best[1]:
                grow(part, g, h, depth + 1, into)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        grow(np.arange(len(y)), p - y, p * (1 - p), 0, step)
        f = f + st.rate * step
        out.append(f)
    return out


def test_boosting_equals_a_plain_version_alone_and_in_step(spark, monkeypatch):
    import numpy as np

    from tessera.operators import boosting
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (260, 3)).astype(float) + rng.integers(0, 3, (260, 1)) * 0.01
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 5) ^ (rng.random(260) < 0.1)).astype(float)
    fold = np.arange(260) % 3
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i]), int(fold[i])) for i in range(260)],
                               "beneficiaire_id long, churned int, a double, b double, c double, _fold int").repartition(4)
    newton = boosting.Boost(rounds=6, depth=3, rate=0.3, l2=1.0, l1=0.2, gamma=0.05, min_child=2.0)
    plain = boosting.Boost(rounds=10, depth=3, rate=0.2, newton=False, min_leaf=4, min_split=10)
    sampled = boosting.Boost(rounds=4, depth=4, rate=0.2, subsample=0.7, columns_tree=0.7, columns_node="sqrt", seed=3)
    woods = C.forest(C.Settings(), 40, 5, 2)
    specs = [(newton, None), (plain, None), (newton, 1), (sampled, None), (woods, None)]

    def fitted():
        return boosting.fit_many(df, ["a", "b", "c"], specs, C.KEY, C.LABEL, "_fold")
    alone = fitted()
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 10)         # rows stay spread
    monkeypatch.setattr(boosting, "CUT_ROUNDS", 3)
    together = fitted()
    for m, other in zip(alone, together):
        assert len(m.trees) == len(other.trees) == m.st.rounds
        for a, b in zip(m.trees, other.trees):
            assert (a.feature, a.cut, a.left) == (b.feature, b.cut, b.left) and np.allclose(a.value, b.value)
    codes = boosting.bin_codes(x, alone[0].edges)
    for m, (st, out) in zip(alone[:3], specs):
        rows = np.arange(260) if out is None else np.flatnonzero(fold != out)
        want = _plain_boosting(x[rows], y[rows], st, st.rounds)[-1]
        assert np.allclose(m.margin(codes)[rows], want, atol=1e-6)
    # a forest: many different trees, each a fair learner, the mean a better one; chances are shares
    chance = alone[4].chance(codes)
    assert len(alone[4].trees) == 40 and len({tuple(t.feature) for t in alone[4].trees}) > 30 and 0 <= chance.min() and chance.max() <= 1
    single = [((t.apply(codes) > 0.5) == (y > 0.5)).mean() for t in alone[4].trees]
    assert ((chance > 0.5) == (y > 0.5)).mean() > max(0.85, float(np.mean(single)))
    scored = alone[0].transform(df).select(C.KEY, C.probability().alias("p")).collect()
    assert np.allclose([r["p"] for r in sorted(scored)], 1 / (1 + np.exp(-alone[0].margin(codes))))
    assert math.isclose(sum(alone[0].importances()), 1.0) and alone[0].importances()[2] < 0.2
    assert boosting.fit_many(df.limit(0), ["a"], specs[:1], C.KEY, C.LABEL)[0].trees == []


def test_sums_hold_the_columns_and_rows_of_open_nodes_only(monkeypatch):
    import pickle

    import numpy as np

    from tessera.operators import boosting
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 8, (3000, 25)).astype(np.uint8)
    y = (codes[:, 3] + rng.integers(0, 6, 3000) > 6).astype(float)
    rows = boosting.Rows(np.arange(3000), codes, y, np.zeros(3000, "<i4"), [np.zeros(3000)])
    for st, wide in ((C.forest(C.Settings(), 3, 9, 2), 5), (boosting.Boost(rounds=3, depth=6, columns_tree=0.4, subsample=0.8), 10)):
        made = []
        for n in (boosting.NODES, 7):                        # the number of nodes summed at once decides nothing
            monkeypatch.setattr(boosting, "NODES", n)
            model = boosting.Model(st, None, 0.0)
            rows.margins[0][:] = 0
            boosting._grow_alone(rows, model, 8)
            made.append([(list(t.feature), list(t.cut), list(t.value)) for t in model.trees])
        assert made[0] == made[1] and len(model.trees[0].feature) > 40
        assert len(pickle.dumps(model.trees[0])) < 30 * len(model.trees[0].feature) + 600
        tree, down = boosting.Tree(), boosting.Descent(rows, 0, st, None, (1.0, 1.0), 0)
        down.follow(tree)
        (nodes, sums), = down.sums(tree, 8)
        assert nodes == [0] and sums.shape == (1, wide, 8, 3) and (sums[0, :, :, 2].sum(axis=1) == len(down.node)).all()
        tree.grow({0: (3, 4, 1.0, 0.0, 0.0, 0.0)})
        tree.grow({1: (3, 1, 1.0, 0.0, 0.0, 0.0)})          # node 2 is a leaf
        down.follow(tree)
        assert tree.open == [3, 4] and set(down.node) == {3, 4} and (down.codes[:, 3] <= 4).all()


def test_bundled_features_grow_the_same_trees(monkeypatch):
    import numpy as np

    from tessera.operators import boosting
    rng = np.random.default_rng(6)
    codes = np.stack([rng.integers(0, n, 4000) for n in (32, 32, 30, 3, 2, 3, 1, 17, 9)], axis=1).astype(np.uint8)
    y = (codes[:, 0] * 1.0 + codes[:, 7] + 9 * codes[:, 3] + rng.integers(0, 20, 4000) > 40).astype(float)
    bundles = boosting.Bundles(codes.max(axis=0).astype(int) + 1)
    assert len(bundles.members) <= 4 and max(bundles.cells) <= boosting.CELLS        # so many passes instead of nine
    monkeypatch.setattr(boosting, "CHUNK", 700)
    g = rng.random(4000)
    sums = bundles.sums(bundles.pack(codes), [(np.arange(4000), np.arange(4000) % 2)], 2, 32, (g, None, 1))
    for f in range(9):
        assert np.allclose(sums[1, f, :, 0], np.bincount(codes[1::2, f], g[1::2], 32)) and (sums[0, f, :, 2] == np.bincount(codes[::2, f], None, 32)).all()
    fold = (np.arange(4000) % 5).astype("<i4")
    s = C.Settings()
    for st, out in ((s.gb(), None), (s.xgb(), 2), (s.stack_gb(), 1), (s.stack_xgb(), None), (boosting.Boost(depth=4, min_child=0.0, min_leaf=9), None)):
        made = []
        for depth in (boosting.BUNDLE_DEPTH, 0):            # 0: every column for itself
            monkeypatch.setattr(boosting, "BUNDLE_DEPTH", depth)
            rows = boosting.Rows(np.arange(4000), codes, y, fold, [np.zeros(4000)])
            model = boosting.Model(boosting.replace(st, rounds=4), out, 0.0)
            boosting._grow_alone(rows, model, 32)
            made.append((model.trees, rows.margins[0][fold != out]))
        monkeypatch.setattr(boosting, "BUNDLE_DEPTH", 10)
        for a, b in zip(made[0][0], made[1][0]):
            assert (a.feature, a.cut, a.left) == (b.feature, b.cut, b.left) and np.allclose(a.value, b.value)
        assert np.allclose(made[0][1], made[1][1])


def test_compare_fits_the_tree_models_of_one_set_of_blocks_and_keeps_their_trees_packed(spark, monkeypatch):
    from tessera.operators import boosting
    calls, real = [], boosting.fit_many
    monkeypatch.setattr(boosting, "fit_many", lambda df, cols, specs, *a, **b: calls.append(len(specs)) or real(df, cols, specs, *a, **b))
    df = C.class_weights(_frame(spark, 120, 60))
    st = C.Settings(lr_iter=5, rf_trees=4, rf_depth=3, gb_iter=3, gb_depth=2, xgb_iter=3, xgb_depth=2, stack_rf_trees=3, stack_rf_depth=2,
                    stack_gb_iter=2, stack_gb_depth=2, stack_xgb_iter=2, stack_xgb_depth=2, folds=2)
    table, best, fitted = C.compare(df, df, ["a", "b"], st, 180)
    assert sorted(calls) == [3, 9] and table.count() == 5 and list(fitted) == ["Logistic Regression", "Random Forest", "Gradient Boosting", "XGBoost", C.STACK]
    for name, n in (("Random Forest", 4), ("XGBoost", 3)):
        trees = fitted[name].trees
        assert len(trees) == n == len(list(trees)) and all(isinstance(raw, bytes) for _, raw in trees.pieces)


def test_pivots_skip_blocks_and_equal_rows_cost_one_point(spark):
    import numpy as np

    from tessera.operators import neighbours
    rng = np.random.default_rng(7)
    centres = rng.uniform(-100, 100, (16, 4))
    pts = np.concatenate([rng.normal(centres[i % 16], 1.0, (1, 4)) for i in range(1600)] + [np.zeros((900, 4))] + [np.round(rng.normal(0, 1, (60, 4)))])
    keys = rng.permutation(len(pts)) * 3 + 1
    rows = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(keys, pts)], "beneficiaire_id long, a double, b double, c double, d double")
    s = neighbours.prepare(rows.repartition(4), ["a", "b", "c", "d"], 5, "beneficiaire_id", block=32)
    n = s.blocks.count()
    assert s.points.count() < 1700 and n > 40 and s.pairs.count() < n * n / 4
    assert s.pairs.select("a", "b").distinct().count() == s.pairs.count()
    got = {(r["_a"], r["_r"]): (r["_b"], r["_nv"]) for r in C.nearest_neighbours(rows, ["a", "b", "c", "d"], block=32).collect()}
    assert len(got) == 5 * len(pts)
    at = {int(i): p for i, p in zip(keys, pts)}
    order = np.argsort(keys)
    for i in rng.choice(len(pts), 300, replace=False):
        d = ((pts[order] - pts[i]) ** 2).sum(axis=1)
        d[order == i] = np.inf
        best = np.argsort(d, kind="stable")[:5]
        want = [(float(d[j]), int(keys[order][j])) for j in best]
        mine = [(float(((at[got[keys[i], r][0]] - pts[i]) ** 2).sum()), got[keys[i], r][0]) for r in range(1, 6)]
        assert np.allclose([x for x, _ in mine], [x for x, _ in want]) and [j for x, j in mine if x == 0] == [j for x, j in want if x == 0]
        assert all(got[keys[i], r][1] == at[got[keys[i], r][0]].tolist() for r in range(1, 6))
    assert C.nearest_neighbours(rows.limit(0), ["a"]).count() == 0
    assert C.nearest_neighbours(rows.limit(1), ["a"]).count() == 0 and C.nearest_neighbours(rows.limit(2), ["a"]).count() == 2


def test_split_orders_keys_alone_and_equals_a_plain_version(spark, monkeypatch):
    import hashlib
    import math
    seen, plain_surrogate = [], C.with_surrogate

    def narrow(df, *args):
        seen.append(df.columns)
        return plain_surrogate(df, *args)

    monkeypatch.setattr(C, "with_surrogate", narrow)
    rows = [(i, 0 if i % 7 else 1, float(i)) for i in range(1, 212)] + [(900, 2, 1.0)]
    got = C.stratified_split(spark.createDataFrame(rows, "beneficiaire_id long, churned int, x double"))
    assert seen == [["churned", "_h", "beneficiaire_id"]]       # the features were sorted and written before
    assert got.columns == ["churned", "beneficiaire_id", "x", "split"]
    classes = {c: sorted((r[0] for r in rows if r[1] == c), key=lambda k: (hashlib.md5(f"{k}:42".encode()).hexdigest(), k)) for c in (0, 1, 2)}
    take = {c: math.floor(len(k) * 0.2) for c, k in classes.items()}
    more = math.ceil(len(rows) * 0.2) - sum(take.values())
    for c in sorted(classes, key=lambda c: (-(len(classes[c]) * 0.2 - take[c]), c))[:more]:
        take[c] += 1
    assert take[2] == 0                                         # a class without a test row
    want = {k for c, ks in classes.items() for k in ks[:take[c]]}
    assert {r.beneficiaire_id for r in got.where("split = 'test'").collect()} == want and got.count() == len(rows)
