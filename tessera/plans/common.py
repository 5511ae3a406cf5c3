"""Shared helpers of the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Report types: integers -> long, decimals -> double, dates/timestamps -> ISO text.

    Results are exact inside the plan (decimals, dates); only the final
    projection is cast so both engines of the oracle check print alike."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(t, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(t, T.DateType):
            c = c.cast("string")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def plain_sql(inner: str, casts: str = "") -> str:
    """DuckDB side of ``plain``: ``casts`` is "col:kind,..." with kind in
    i (BIGINT), d (DOUBLE), s (VARCHAR)."""
    kinds = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR"}
    items = [x.strip() for x in casts.split(",") if x.strip()]
    if not items:
        return inner
    rep = ", ".join(f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in (i.split(":") for i in items))
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) _q"
