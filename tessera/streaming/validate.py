"""Stream validation of arriving rows against the national-id mirror.

Per-row insert triggers become a Structured Streaming query: file stream ->
stream-static LEFT join with the id mirror -> ``foreachBatch`` writing
accepted and rejected rows to two Parquet sinks, with a checkpoint so a
restarted query resumes where it stopped. ``Trigger.AvailableNow`` drains
what has arrived and stops. Update triggers become keyed state: the last id of every person, so
that only an id that changed is checked, also across restarts.

A query resumes where the caller gives it the folder of its earlier run; without one every call starts anew.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.operators.quality import REJECT_MESSAGE, validate_ids
from tessera.session import checkpoint_dir


def validate_stream(spark: SparkSession, stream: DataFrame, mirror: DataFrame, out_dir: str | None = None,
                    id_col: str = "jeune_cin", prepare=None, known_col: str | None = None) -> tuple[str, str]:
    """Run the validation stream to completion of the available input.

    ``prepare`` maps the raw stream rows to rows carrying ``id_col`` (for
    example a stream-static join that looks the id up). A row whose boolean
    ``known_col`` is not true has no holder and is rejected, while a known holder's
    NULL id passes; the column is not written. Returns the paths of
    the accepted and rejected sinks."""
    base = out_dir or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    ok_path, ko_path, ckpt = f"{base}/accepted", f"{base}/rejected", f"{base}/_checkpoint"
    rows = prepare(stream) if prepare else stream
    checked = validate_ids(rows, mirror, id_col)
    if known_col:
        known = F.coalesce(F.col(known_col), F.lit(False))
        checked = checked.withColumn("accepted", F.col("accepted") & known).withColumn(
            "message", F.when(known, F.col("message")).otherwise(F.lit(REJECT_MESSAGE))).drop(known_col)

    _run(checked, ok_path, ko_path, ckpt)
    return ok_path, ko_path


def _run(checked: DataFrame, ok_path: str, ko_path: str, ckpt: str) -> None:
    """Drain the stream into the two sinks."""

    def sink(batch: DataFrame, epoch: int) -> None:
        # idempotent per epoch: a replayed micro-batch overwrites its own folder;
        # an empty side still writes a schema-only file, so readers never miss it
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)     # joined once, written twice
        (batch.filter("accepted").drop("accepted", "message").write.mode("overwrite")
         .parquet(f"{ok_path}/epoch={epoch}"))
        (batch.filter("NOT accepted").drop("accepted").write.mode("overwrite")
         .parquet(f"{ko_path}/epoch={epoch}"))
        batch.unpersist()

    q = (checked.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def with_changes(events: DataFrame, key: str, id_col: str, ts: str, event: str, late: str) -> DataFrame:
    """The stream's events, each once, with ``changed``: the id is not NULL and differs from the one that the person's
    event before carried (a person's first event counts as changed). State: one id per person.

    Events of a person that arrive together are taken in the order of (``ts``, ``event``). An event met again within ``late`` of
    the newest one is dropped; so is one that arrives later than that, as watermarks demand."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([event])
    out = T.StructType([*once.schema.fields, T.StructField("changed", T.BooleanType())])

    def step(_, frames, state):
        import pandas as pd
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([ts, event])
        changed = []
        for value in rows[id_col].tolist():
            value = None if pd.isna(value) else value
            changed.append(value is not None and value != last)
            last = value
        state.update((last,))
        yield rows.assign(changed=changed)[out.names]

    found = once.groupBy(key).applyInPandasWithState(step, out, "last string", "append", GroupStateTimeout.NoTimeout)
    # a projection: this Spark version cannot shuffle the rows as the operator hands them on
    return found.withColumn("changed", F.coalesce("changed", F.lit(False)))


def validate_updates(spark: SparkSession, events: DataFrame, mirror: DataFrame, out_dir: str | None = None, key: str = "id",
                     id_col: str = "jeune_cin", ts: str = "ts", event: str = "event_id", known_col: str | None = None,
                     late: str = "3650 days") -> tuple[str, str]:
    """G8 on arriving events: an id that changed must be in the mirror; an unchanged or NULL id passes unchecked. Events whose
    ``known_col`` is not true have no holder and are rejected. Returns the paths of the accepted and rejected sinks."""
    base = out_dir or f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    checked = validate_ids(with_changes(events, key, id_col, ts, event, late), mirror, id_col)
    fine = ~F.col("changed") | F.col("accepted")
    if known_col:
        fine = fine & F.coalesce(F.col(known_col), F.lit(False))
    checked = checked.withColumn("accepted", fine).withColumn("message", F.when(~F.col("accepted"), F.lit(REJECT_MESSAGE)))
    _run(checked.drop(known_col) if known_col else checked, f"{base}/accepted", f"{base}/rejected", f"{base}/_checkpoint")
    return f"{base}/accepted", f"{base}/rejected"
