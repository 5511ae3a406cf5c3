"""Churn modelling (M3-M12, P18) with pyspark.ml.

Everything that touches rows is a DataFrame job: the split, oversampling,
scaling and scoring; only model coefficients and small tables (metrics,
importances, fold scores) reach the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import risk_segment
from tessera.operators import boosting, neighbours
from tessera.operators.boosting import Boost
from tessera.operators.keys import with_surrogate
from tessera.operators.scoring import metrics_table
from tessera.session import checkpoint_dir

KEY, LABEL = "beneficiaire_id", "churned"
STACK = "Stacking Ensemble"
FIT_ROWS = 100_000  # training rows of a partition
TREE_BINS = 32  # candidate splits of a feature, as in Spark's own trees


def key_hash(key: str, seed: int) -> F.Column:
    """An order of rows that no engine-specific hash decides."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(df: DataFrame, label: str = LABEL, test_frac: float = 0.2, seed: int = 42,
                     key: str = KEY) -> DataFrame:
    """M3: exact stratified split: within each class, rows ordered by a key
    hash; the first ones are test. ceil(test_frac * n) test rows are dealt to the
    classes by largest remainder. Positions come from W2 (no single-task window) over class, hash and key alone,
    class sizes from one small aggregate (one row per class); the rows themselves are compared with their class's
    last test row, so they are neither sorted nor shuffled. Keys are unique."""
    h = df.withColumn("_h", key_hash(key, seed))
    pos = with_surrogate(h.select(label, "_h", key), [label, "_h", key], "_pos")
    sizes = pos.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") * test_frac
    every = Window.partitionBy()
    start = (sizes.withColumn("_start", F.coalesce(F.sum("_n").over(
        Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_extra", F.ceil(F.sum("_n").over(every) * test_frac) - F.sum(F.floor(share)).over(every))
        .withColumn("_nth", F.row_number().over(Window.orderBy((share - F.floor(share)).desc(), label)))
        .withColumn("_test", F.floor(share) + F.when(F.col("_nth") <= F.col("_extra"), 1).otherwise(0))
        .drop("_extra", "_nth"))
    last = (pos.join(F.broadcast(start), label).where(F.col("_pos") - F.col("_start") == F.col("_test"))
            .select(label, F.struct("_h", key).alias("_last")))
    out = h.join(F.broadcast(start.select(label).join(last, label, "left")), label)
    test = F.coalesce(F.struct("_h", key) <= F.col("_last"), F.lit(False))       # a class may have no test row
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_last")


def stratified_folds(df: DataFrame, folds: int, label: str = LABEL, seed: int = 42, key: str = KEY) -> DataFrame:
    """``df`` with ``_fold``: within each class the rows, ordered by a key hash, are dealt to the folds in turn,
    so fold sizes per class differ by one row at most (W2 positions)."""
    pos = with_surrogate(df.withColumn("_h", key_hash(key, seed)), [label, "_h", key], "_pos")
    return pos.withColumn("_fold", F.pmod(F.col("_pos"), F.lit(folds)).cast("int")).drop("_h", "_pos")


def nearest_neighbours(rows: DataFrame, features: list[str], k: int = 5, key: str = KEY, block: int = neighbours.BLOCK) -> DataFrame:
    """(_a, _r, _b, _nv): the exact k nearest other rows of every row, with their features; kept, for it is read several times."""
    return neighbours.nearest(rows, features, k, key, block).checkpoint(eager=True)


def smote(df: DataFrame, features: list[str], label: str = LABEL, k: int = 5, seed: int = 42,
          key: str = KEY) -> DataFrame:
    """M4: SMOTE to class parity. Every minority row makes its share of the synthetic rows along a segment to one of
    its exact k nearest minority neighbours, with hashed (reproducible) choices; a lone row is repeated."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}  # two classes
    minority = min(counts, key=lambda c: (counts[c], c))
    need = max(counts.values()) - counts[minority]
    mino = df.filter(F.col(label) == minority).withColumn("_v", F.array(*[F.col(c).cast("double") for c in features]))
    nn = nearest_neighbours(mino, features, k, key)
    if counts[minority] == 1:
        nn = mino.select(F.col(key).alias("_a"), F.lit(1).alias("_r"), F.col(key).alias("_b"), F.col("_v").alias("_nv"))
    n_of = nn.groupBy("_a").agg(F.count(F.lit(1)).alias("_kk"))
    # points with at least one neighbour share the synthetic rows: floor(need / m)
    # each, plus one for the first need % m of them in hash order
    src = mino.join(n_of, F.col(key) == F.col("_a")).drop("_a")
    m = max(src.count(), 1)
    base = with_surrogate(src, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], "_rank")
    per = F.lit(need // m) + F.when(F.col("_rank") <= F.lit(need % m), 1).otherwise(0)
    gen = base.withColumn("_m", per).filter(F.col("_m") > 0).withColumn("_s", F.explode(F.sequence(F.lit(1), "_m")))
    gen = gen.withColumn("_pick", F.least((F.pmod(F.xxhash64(key, "_s", F.lit(seed)), F.col("_kk")) + 1).cast("int"),
                                          F.col("_kk").cast("int")))
    gen = gen.join(nn.select("_a", "_r", "_nv"), (F.col(key) == F.col("_a")) & (F.col("_pick") == F.col("_r")))
    u = (F.pmod(F.xxhash64(key, "_s", F.lit(seed + 1)), F.lit(1 << 30)).cast("double") / float(1 << 30))
    new = F.zip_with("_v", "_nv", lambda a, b: a + F.col("_u") * (b - a))
    synth = gen.withColumn("_u", u).select(
        # ranks are dense and at most need // m + 1 rows come from each, so keys are negative and unique
        (-(F.col("_rank") * (need // m + 2) + F.col("_s"))).alias(key), F.lit(minority).alias(label), new.alias("_x"))
    synth = synth.select(key, label, *[F.col("_x")[i].alias(c) for i, c in enumerate(features)])
    orig = df.select(key, label, *[F.col(c).cast("double").alias(c) for c in features])
    return orig.unionByName(synth)


def population_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Fit of the scaler: mean and population std per column in one
    aggregate job; only these 2 x len(cols) numbers reach the driver."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 0.0) for i, c in enumerate(cols)}


def standardize(fit_on: DataFrame, apply_to: DataFrame, cols: list[str], stats=None) -> DataFrame:
    """M5: (x - mean) / population std fitted on ``fit_on`` (a zero std
    leaves the centred value unscaled, as sklearn does)."""
    st = stats or population_stats(fit_on, cols)
    out = []
    for c in apply_to.columns:
        if c in cols:
            m, s = st[c]
            out.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s if s else 1.0)).alias(c))
        else:
            out.append(F.col(c))
    return apply_to.select(*out)


@dataclass
class Settings:
    """Model settings; tests use small forests."""

    lr_c: float = 0.5
    lr_iter: int = 2000
    lr_tol: float = 1e-4  # the reference library's default tolerance
    rf_trees: int = 500
    rf_depth: int = 15
    gb_iter: int = 500
    gb_depth: int = 6
    gb_step: float = 0.05
    xgb_iter: int = 500
    xgb_depth: int = 7
    stack_rf_trees: int = 200
    stack_rf_depth: int = 12
    stack_gb_iter: int = 200
    stack_gb_depth: int = 5
    stack_gb_step: float = 0.08
    stack_xgb_iter: int = 200
    stack_xgb_depth: int = 6
    stack_xgb_step: float = 0.08
    stack_subsample: float = 1.0
    stack_xgb_columns: float = 1.0
    stack_min_leaf: int = 1
    folds: int = 5
    seed: int = 42

    # The reference's regularisation of its boosted models.
    def gb(self) -> Boost:
        """First-order splits, Newton leaves."""
        return Boost(self.gb_iter, self.gb_depth, self.gb_step, newton=False, min_leaf=5, min_split=10, subsample=0.8,
                     columns_node="sqrt", seed=self.seed)

    def xgb(self) -> Boost:
        return Boost(self.xgb_iter, self.xgb_depth, 0.05, l2=1.0, l1=0.1, gamma=0.1, min_child=3.0, subsample=0.8,
                     columns_tree=0.8, seed=self.seed)

    def stack_gb(self) -> Boost:
        return Boost(self.stack_gb_iter, self.stack_gb_depth, self.stack_gb_step, newton=False, subsample=self.stack_subsample,
                     seed=self.seed)

    def stack_xgb(self) -> Boost:
        return Boost(self.stack_xgb_iter, self.stack_xgb_depth, self.stack_xgb_step, subsample=self.stack_subsample,
                     columns_tree=self.stack_xgb_columns, seed=self.seed)

    @staticmethod
    def small() -> "Settings":
        return Settings(lr_iter=30, rf_trees=20, rf_depth=5, gb_iter=10, gb_depth=3, xgb_iter=10, xgb_depth=4,
                        stack_rf_trees=10, stack_rf_depth=4, stack_gb_iter=3, stack_gb_depth=3, stack_xgb_iter=3,
                        stack_xgb_depth=3)

    @staticmethod
    def scoring() -> "Settings":
        """The stack that scores everybody has the single models' sizes."""
        return Settings(stack_rf_trees=500, stack_rf_depth=15, stack_gb_iter=500, stack_gb_depth=6, stack_gb_step=0.05,
                        stack_xgb_iter=500, stack_xgb_depth=7, stack_xgb_step=0.05, stack_subsample=0.8,
                        stack_xgb_columns=0.8, stack_min_leaf=2)


def assemble(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """'balanced' weights: n / (2 n_class)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}  # two classes
    n = sum(counts.values())
    w = F.lit(None).cast("double")
    for cls, nc in counts.items():
        w = F.when(F.col(label) == cls, F.lit(n / (2.0 * nc))).otherwise(w)
    return df.withColumn("_w", w)


class Boosted:
    """A boosted model with the ``fit`` of an estimator."""

    def __init__(self, cols: list[str], st: Boost):
        self.cols, self.st = cols, st

    def fit(self, rows: DataFrame):
        return boosting.fit_many(rows, self.cols, [(self.st, None)], KEY, LABEL, bins=TREE_BINS)[0]


def forest(st: Settings, trees: int, depth: int, min_leaf: int, min_split: int = 2) -> Boost:
    return Boost(trees, depth, l2=0.0, min_child=0.0, min_leaf=min_leaf, min_split=min_split, columns_node="sqrt", forest=True, seed=st.seed)


def models(cols: list[str], st: Settings, n_train: int) -> dict:
    """M6-M9 as estimators."""
    asm = assemble(cols)
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=st.lr_iter, tol=st.lr_tol,
                            regParam=1.0 / (st.lr_c * max(n_train, 1)), elasticNetParam=0.0, standardization=False)
    return {"Logistic Regression": Pipeline(stages=[asm, lr]), "Random Forest": Boosted(cols, forest(st, st.rf_trees, st.rf_depth, 2, 5)),
            "Gradient Boosting": Boosted(cols, st.gb()), "XGBoost": Boosted(cols, st.xgb())}


def compact(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` for an iterative fit: one partition per ``FIT_ROWS`` rows, kept."""
    return rows.repartition(max(1, -(-n // FIT_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)


def probability() -> F.Column:
    """P(class 1) out of a fitted classifier's probability vector."""
    return vector_to_array(F.col("probability"))[1]


def fit_stack(train: DataFrame, cols: list[str], st: Settings) -> tuple[list, object]:
    """Base models (RF, GB, XGBoost) give out-of-fold probabilities on stratified
    folds; a logistic meta-model learns from them; bases are refitted on all
    training rows. The bases of all folds are grown together.
    Returns (base models, meta model)."""
    asm = assemble(cols)
    outs = [*range(st.folds), None]                     # the fold left out; None: all rows
    n = max(train.count(), 1)
    tr = compact(stratified_folds(train, st.folds, seed=st.seed).select(KEY, LABEL, "_fold", *cols), n)
    rf = forest(st, st.stack_rf_trees, st.stack_rf_depth, st.stack_min_leaf)
    made = boosting.fit_many(tr, cols, [(b, out) for out in outs for b in (rf, st.stack_gb(), st.stack_xgb())], KEY, LABEL, "_fold", TREE_BINS)
    bases = {out: made[3 * i:3 * i + 3] for i, out in enumerate(outs)}
    oof = None
    for f in range(st.folds):
        hold = base_probabilities(bases[f], tr.filter(F.col("_fold") == f)).select(KEY, LABEL, "_p0", "_p1", "_p2")
        oof = hold if oof is None else oof.unionByName(hold)
    meta_in = VectorAssembler(inputCols=["_p0", "_p1", "_p2"], outputCol="meta").transform(oof)
    # the reference's library regularises with C = 1
    meta = LogisticRegression(featuresCol="meta", labelCol=LABEL, maxIter=1000, regParam=1.0 / n, standardization=False).fit(compact(meta_in, n))
    tr.unpersist()
    return [asm, *bases[None]], meta


def base_probabilities(bases: list, df: DataFrame) -> DataFrame:
    """``df`` with the probability of every base model as _p0, _p1, ..."""
    for i, m in enumerate(bases):
        df = m.transform(df).withColumn(f"_p{i}", probability()).drop("rawPrediction", "probability", "prediction")
    return df


def stack_transform(models_, meta, df: DataFrame) -> DataFrame:
    asm, *bases = models_
    x = base_probabilities(bases, asm.transform(df))
    x = VectorAssembler(inputCols=[f"_p{i}" for i in range(len(bases))], outputCol="meta").transform(x)
    return meta.transform(x)


def fit_named(name: str, rows: DataFrame, cols: list[str], st: Settings, n_train: int):
    """(fitted model, function that scores a frame) of one of the five classifiers."""
    if name == STACK:
        bases, meta = fit_stack(rows, cols, st)
        return (bases, meta), lambda df: stack_transform(bases, meta, df)
    kept = compact(rows, n_train)
    model = models(cols, st, n_train)[name].fit(kept)
    kept.unpersist()
    return model, model.transform


def compare(over: DataFrame, test: DataFrame, cols: list[str], st: Settings, n_train: int):
    """(metrics of the five classifiers with the best by F1 flagged, its name, name -> fitted model)."""
    every = models(cols, st, n_train)
    trees = {name: x.st for name, x in every.items() if isinstance(x, Boosted)}

    def grown():
        """The tree models, from one set of blocks."""
        kept = compact(over, n_train)
        made = boosting.fit_many(kept, cols, [(x, None) for x in trees.values()], KEY, LABEL, bins=TREE_BINS)
        kept.unpersist()
        return {name: (model, model.transform) for name, model in zip(trees, made)}

    names = [*every, STACK]
    with ThreadPoolExecutor(max_workers=len(names)) as ex:  # independent fits, concurrent jobs
        forms = ex.submit(grown)
        others = [name for name in names if name not in trees]
        fits = dict(zip(others, ex.map(lambda n: fit_named(n, over, cols, st, n_train), others))) | forms.result()
    fits = {name: fits[name] for name in names}
    tables = [evaluate(score(test), name) for name, (_, score) in fits.items()]
    rows = [r for t in tables for r in t.collect()]  # one row per model
    best = max(rows, key=lambda r: (r["f1"], r["auc"]))["model"]
    table = over.sparkSession.createDataFrame(rows, tables[0].schema).withColumn("best", F.col("model") == best)
    return table, best, {name: model for name, (model, _) in fits.items()}


def importances(model, cols: list[str]) -> list[tuple[str, float]]:
    """M12d: importances of a fitted tree model, absolute coefficients of a linear one."""
    if isinstance(model, boosting.Model):
        return list(zip(cols, model.importances()))
    last = model.stages[-1]
    v = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return [(c, abs(float(x))) for c, x in zip(cols, v.toArray())]


def cross_val_f1(name: str, df: DataFrame, cols: list[str], st: Settings) -> list[tuple[int, float]]:
    """M12e: (fold, F1) of one of the five classifiers on stratified folds."""
    folded = stratified_folds(df, st.folds, seed=st.seed).persist(StorageLevel.MEMORY_AND_DISK)
    n = {r[0]: r[1] for r in folded.groupBy("_fold").agg(F.count(F.lit(1))).collect()}  # one row per fold

    def fold(f):
        tr, te = folded.filter(F.col("_fold") != f).drop("_fold"), folded.filter(F.col("_fold") == f).drop("_fold")
        _, score = fit_named(name, tr, cols, st, sum(n.values()) - n.get(f, 0))
        return f, f1_of(score(te))
    with ThreadPoolExecutor(max_workers=2) as ex:  # independent fold fits, each of concurrent jobs
        rows = list(ex.map(fold, range(st.folds)))
    folded.unpersist()
    return rows


def evaluate(scored: DataFrame, name: str) -> DataFrame:
    """M11 for one model: metrics of its probability column."""
    s = scored.select(LABEL, probability().alias("p"))
    return metrics_table(s, "p", LABEL, name)


def score_frame(scored: DataFrame) -> DataFrame:
    """M12f + P18: probability (DECIMAL(5,4)), predicted flag, risk bucket."""
    p = probability()
    return scored.select(KEY, F.round(p, 4).cast("decimal(5,4)").alias("churn_probability"),
                         (p >= 0.5).alias("churn_predicted"), risk_segment(p).alias("churn_risk_segment"))


def f1_of(scored: DataFrame) -> float:
    """F1 of predictions >= 0.5 (one aggregate, one number to the driver)."""
    p = probability() >= 0.5
    y = F.col(LABEL) == 1
    r = scored.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
                   F.count_if(~p & y).alias("fn")).first()
    d = 2 * r.tp + r.fp + r.fn
    return 2 * r.tp / d if d else 0.0
