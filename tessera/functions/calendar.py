"""Calendar dimension.

The reference fills the calendar with a recursive CTE whose stop test
``d <= end`` lets one extra day through; ``include_next_day`` keeps that.
The spine is ``spark.range`` (already split into partitions) rather than one
exploded array on a single row, so it never sits on one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import date_key, day_name, month_name


def _as_date(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x))


def calendar(spark: SparkSession, start, end, include_next_day: bool = True) -> DataFrame:
    s, e = _as_date(start), _as_date(end)
    n = (e - s).days + (2 if include_next_day else 1)
    d = F.date_add(F.lit(s), F.col("id").cast("int"))
    spine = spark.range(0, n, 1, numPartitions=max(1, min(8, n // 2000 + 1))).select(d.alias("date_complete"))
    return _parts(spine)


def calendar_rows(start, end, include_next_day: bool = True) -> int:
    """Row count of ``calendar`` without running a job (its proven size bound)."""
    s, e = _as_date(start), _as_date(end)
    return (e - s).days + (2 if include_next_day else 1)


def calendar_spanning(dates: DataFrame, col: str) -> DataFrame:
    """Calendar from 1 January of the first year to 31 December of the last
    year of ``dates[col]`` (plus the reference's extra day). The span is bounded
    by the number of days, so one generated row set is small."""
    b = dates.agg(F.min(F.to_date(col)).alias("_s"), F.max(F.to_date(col)).alias("_e"))
    spine = b.select(F.explode(F.sequence(
        F.make_date(F.year("_s"), F.lit(1), F.lit(1)),
        F.date_add(F.make_date(F.year("_e"), F.lit(12), F.lit(31)), 1))).alias("date_complete"))
    return _parts(spine)


def _parts(spine: DataFrame) -> DataFrame:
    return spine.select(
        date_key(F.col("date_complete")).alias("temps_id"),
        "date_complete",
        F.dayofmonth("date_complete").alias("jour"),
        F.month("date_complete").alias("mois"),
        F.year("date_complete").alias("annee"),
        F.quarter("date_complete").alias("trimestre"),
        day_name(F.col("date_complete")).alias("nom_jour"),
        month_name(F.col("date_complete")).alias("nom_mois"),
        (F.weekday("date_complete") + 1).alias("jour_semaine"),
        F.weekofyear("date_complete").alias("semaine_annee"),
        (F.weekday("date_complete") >= 5).alias("est_weekend"),
    )
