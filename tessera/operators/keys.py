"""Surrogate keys (W1 for small dimensions, W2 for facts and large dimensions)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

TASK_ROWS = 500_000     # rows of a task, about, where rows are hashed by their number


def spread(df: DataFrame, rows: int | None, *cols) -> DataFrame:
    """``df``, of about ``rows`` rows, hashed by ``cols`` into tasks of ``TASK_ROWS`` rows each, so that a task's memory
    stays the same whatever the size. A group-by of the columns needs no other shuffle then. While the cores take all such
    tasks at once, the frame is left as it is, for Spark's own shuffle."""
    spark = df.sparkSession
    n = -(-(rows or 0) // TASK_ROWS)
    if n <= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), *cols)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: who reads it several times, a few columns each
    time, does not compute it again and reads those columns alone."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_number(df: DataFrame, order_cols, name: str) -> DataFrame:
    """Dense 1..n key by a global order. Only for frames with a proven
    small size (a window without partition runs in one task)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order_cols)).cast("long"))


def with_surrogate(df: DataFrame, order_cols, name: str, num_partitions: int | None = None) -> DataFrame:
    """Dense 1..n key in the order of ``order_cols`` without a single-task window.

    1. range-partition and sort within partitions on the order columns;
    2. record (partition id, position in partition) and cut lineage with a
       reliable checkpoint in the cluster's checkpoint folder, so both passes
       below see the same partitioning even if the input came out of a
       shuffle or an executor is lost;
    3. count rows per partition (one tiny row per partition), turn the counts
       into start offsets, and broadcast them (their size is the partition count);
    4. key = offset + position + 1.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)  # the cluster's shared folder (set locally only when unset)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("__w2_pid", F.spark_partition_id())
        .withColumn("__w2_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ).checkpoint(eager=True)
    offsets = (
        ranged.groupBy("__w2_pid").agg(F.count(F.lit(1)).alias("__w2_n"))
        .withColumn("__w2_off", F.sum("__w2_n").over(Window.orderBy("__w2_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .select("__w2_pid", F.coalesce("__w2_off", F.lit(0)).alias("__w2_off"))
    )
    return (
        ranged.join(F.broadcast(offsets), "__w2_pid")
        .withColumn(name, (F.col("__w2_off") + F.col("__w2_pos") + 1).cast("long"))
        .drop("__w2_pid", "__w2_pos", "__w2_off")
    )


def extend_keys(known: DataFrame | None, ids: DataFrame, source: str, name: str) -> DataFrame:
    """Keys that survive a reload: (source, name) of an earlier load keep their key, ids met for the first time follow the highest
    one in the order of their source id (W2). A key is never given twice, also where its id has left the source.

    Null ids get no key; ids that stand more than once get one."""
    ids = ids.select(source).where(F.col(source).isNotNull()).distinct()
    if known is None:
        return with_surrogate(ids, [source], name)
    fresh = with_surrogate(ids.join(known.select(source), source, "left_anti"), [source], "__w2_new")
    highest = F.coalesce(known.agg(F.max(name)).scalar(), F.lit(0))
    return known.select(source, name).unionByName(fresh.select(source, (F.col("__w2_new") + highest).cast("long").alias(name)))
