"""Score reports and write-back (A9, A16, M11, M12a-c, S8, S9).

Every report starts with an aggregate: counts per (label, prediction), per
distinct score or per value. Distinct scores are summed up by range partitions,
so no window without a partition runs over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir
from tessera.sources import io


def write_back(dim: DataFrame, scores: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Replace score columns on a dimension with one LEFT join (no per-row
    updates). Rows without a score keep NULL, like columns added without a
    default for existing rows."""
    base = dim.drop(*[c for c in cols if c in dim.columns])
    return base.join(scores.select(key, *cols), key, "left")


def rewrite(dim: DataFrame, updates: list[tuple[DataFrame, list[str]]], key: str, base: str, name: str, run_id: str) -> DataFrame:
    """The dimension with the score columns of all ``updates`` written as a new version below ``base`` and read back from
    there; the version it came from stays until the pointer has moved."""
    for scores, cols in updates:
        dim = write_back(dim, scores, key, cols)
    io.reload({name: dim}, base, run_id)
    spark = dim.sparkSession
    return spark.read.schema(dim.schema).parquet(f"{io.current(spark, base)}/{name}")


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Value counts with their percentage of the total."""
    g = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def score_histogram(df: DataFrame, score: str, label: str, bins: int = 40) -> DataFrame:
    """Equal-width histogram of a score split by class (A16). Rows are counted once per (score, class); range and bins come
    from these counts."""
    checkpoint_dir(df.sparkSession)  # the cluster's shared folder (set locally only when unset)
    seen = df.groupBy(F.col(score).alias("_s"), F.col(label).alias("churned")).agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
    ends = seen.agg(F.struct(F.min("_s").alias("lo"), F.max("_s").alias("hi"))).scalar()
    width = F.try_divide(ends["hi"] - ends["lo"], F.lit(float(bins)))
    b = F.least(F.floor(F.try_divide(F.col("_s") - ends["lo"], width)), F.lit(bins - 1)).cast("long")
    return seen.groupBy(b.alias("bin"), "churned").agg(F.sum("_n").alias("n"))


def confusion(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """(label, predicted, n)."""
    pred = (F.col(score) >= threshold).cast("int")
    return df.groupBy(F.col(label).alias("label"), pred.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _counts(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    p, y = F.col(score) >= threshold, F.col(label) == 1
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                  F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def _running(df: DataFrame, score: str, label: str) -> DataFrame:
    """(s, pos, neg, pos_below, neg_below, all_pos, all_neg): counts per distinct score, those of all smaller scores,
    and the totals. Scores stay exact and no window runs over all of them in one task: they are range-partitioned
    (checkpointed, as in W2), summed within a partition, and lifted by the partitions' offsets (one row each)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = per.repartitionByRange(n, "s").withColumn("_p", F.spark_partition_id()).checkpoint(eager=True)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_p").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    sums = sums.select("_p", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in ("pos", "neg")],
                       *[F.sum(f"_{c}").over(Window.partitionBy()).alias(f"all_{c}") for c in ("pos", "neg")])
    inside = Window.partitionBy("_p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(sums), "_p").select(
        "s", "pos", "neg", *[(F.col(f"_{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below") for c in ("pos", "neg")],
        "all_pos", "all_neg")


def _auc():
    """Rank-statistic AUC (ties count one half), an aggregate over the rows of ``_running``."""
    return F.try_divide(F.sum(F.col("pos") * F.col("neg_below")) + 0.5 * F.sum(F.col("pos") * F.col("neg")),
                        (F.sum("pos") * F.sum("neg")).cast("double"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC of a scored frame (null with one class only)."""
    return _running(df, score, label).agg(_auc().alias("auc"))


def metrics_table(df: DataFrame, score: str, label: str, model: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC of one scored frame, from its counts per score."""
    over = F.col("s") >= threshold
    c = _running(df, score, label).agg(
        F.sum(F.when(over, F.col("pos"))).alias("tp"), F.sum(F.when(over, F.col("neg"))).alias("fp"),
        F.sum(F.when(~over, F.col("pos"))).alias("fn"), F.sum(F.when(~over, F.col("neg"))).alias("tn"), _auc().alias("auc"))
    tp, fp, fn, tn = (F.coalesce(F.col(x), F.lit(0)).cast("double") for x in ("tp", "fp", "fn", "tn"))

    def r(e):
        return F.round(F.coalesce(e, F.lit(0.0)), 6)
    return c.select(F.lit(model).alias("model"),
                    r(F.try_divide(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
                    r(F.try_divide(tp, tp + fp)).alias("precision"),
                    r(F.try_divide(tp, tp + fn)).alias("recall"),
                    r(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
                    r(F.col("auc")).alias("auc"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score."""
    return _running(df, score, label).select(
        F.col("s").alias("threshold"),
        F.round(F.try_divide(F.col("all_pos") - F.col("pos_below"), F.col("all_pos")), 9).alias("tpr"),
        F.round(F.try_divide(F.col("all_neg") - F.col("neg_below"), F.col("all_neg")), 9).alias("fpr"))


def class_report(df: DataFrame, score: str, label: str, threshold: float = 0.5,
                 names: tuple[str, str] = ("Actif", "Churne")) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    c = _counts(df, score, label, threshold)
    per = c.select(F.inline(F.array(
        F.struct(F.lit(names[0]).alias("classe"), F.col("tn").alias("tp_c"), F.col("fn").alias("fp_c"),
                 F.col("fp").alias("fn_c"), (F.col("tn") + F.col("fp")).alias("support")),
        F.struct(F.lit(names[1]).alias("classe"), F.col("tp").alias("tp_c"), F.col("fp").alias("fp_c"),
                 F.col("fn").alias("fn_c"), (F.col("tp") + F.col("fn")).alias("support")))))
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp_c", "fp_c", "fn_c"))
    per = per.select("classe", "support",
                     F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("p"),
                     F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("r"))
    per = per.withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")),
                                         F.lit(0.0)))
    macro = per.agg(F.lit("macro avg").alias("classe"), F.avg("p").alias("p"), F.avg("r").alias("r"),
                    F.avg("f").alias("f"), F.sum("support").alias("support"))
    wsum = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("classe"),
                       (F.sum(F.col("p") * F.col("support")) / wsum).alias("p"),
                       (F.sum(F.col("r") * F.col("support")) / wsum).alias("r"),
                       (F.sum(F.col("f") * F.col("support")) / wsum).alias("f"), wsum.alias("support"))
    allr = per.select("classe", "p", "r", "f", "support").unionByName(macro).unionByName(weighted)
    return allr.select("classe", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"),
                       F.round("f", 6).alias("f1"), F.col("support").cast("long").alias("support"))
