"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch on its way to Python and back; Spark's own 64 MB stand several times in an executor.
ARROW_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Plans that run inside exchange small Arrow batches with Python; afterwards the session's setting holds again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, so a lost
    executor costs a re-read and no recomputation, and every later pass sees the same rows."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id's decimal text, modulo ``modulus``, equals ``remainder`` (null ids: false)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def slices(lengths, limit: int):
    """Cut consecutive items into runs of at most ``limit`` in total length (a longer item stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def parts(batches, column: int, limit: int):
    """Cut Arrow batches, without copying, into batches with at most ``limit`` characters in a text column (a longer
    text stands alone), so that what a task holds and hands on depends on that limit and not on the rows in a batch."""
    import pyarrow as pa
    import pyarrow.compute as pc
    for batch in batches:
        for a, b in slices([n or 0 for n in pc.utf8_length(batch.column(column)).to_pylist()], limit):
            yield batch.slice(a, b - a)
    # workers outlive tasks: what this one freed goes back to the system
    pa.default_memory_pool().release_unused()
