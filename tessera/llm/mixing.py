"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r >= 0: how often the mix takes it. Among all rates that meet the token
constraints (for each value of each constraint column: sum of size * r = target), entropy balancing picks
those closest to the documents' base rates b in token-weighted Kullback-Leibler distance, with the cap r <= c
as a box. The solution is exponentially tilted: ``r = min(c, b * exp(sum of multipliers))``, one multiplier
per constraint value, and the multipliers minimise a convex dual whose gradient is (reached - target) tokens.

The dual is solved by Newton steps that are grouped aggregates: documents are first reduced to one row per
distinct (constraint values, base rate) cell with its token count, each step is one aggregate over those
cells per constraint column (cells at the cap leave the Hessian), and the multipliers live in a frame keyed by
constraint value. Nothing is collected but the largest relative residual. One constraint column needs a few
steps; several overlapping columns are stepped in turn.

Rates become copies by systematic rounding: within slots of a source (salted by a hash of the row's place in the
order of ids, so a source with a third of all rows is spread over many tasks, whatever ids repeat or are null) documents go through in descending size and the
error of the running total is carried on, so a slot ends within half a small document of its share.

Edge cases: null text has size 0, null source is a source of its own (last in order), an empty table gives no
rows, sources whose sizes are all 0 have target 0, documents of size 0 take nothing, repeated rows are separate
documents (so are rows without an id), ties in size go by id.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut
from tessera.operators.keys import with_surrogate

MAX_COPIES = 3
TOLERANCE = 1e-9
SLOT_ROWS = 2_000
_KEY, _SIZE, _BASE, _CELL = "__mix_value", "__mix_size", "__mix_base", "__mix_cell"
_ROW, _PLACE = "__mix_row", "__mix_place"


def word_count(text):
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights=(1, 2, 3), cap: float = MAX_COPIES) -> DataFrame:
    """One row per source: source_size and target.

    Sources in code-point order (null last) weigh ``weights`` in turn and share the total of all sizes; a target
    stops at ``cap`` times its source's size and the excess is shared again by weight until none is above.

    The order is a dense rank over one row per source. The water level is found without a loop: with sources
    sorted by cap-to-weight ratio, exactly a prefix of them is capped."""
    by = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                         (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = (by.withColumn("w", cycle).withColumn("limit", F.col("source_size") * float(cap))
         .withColumn("ratio", F.col("limit") / F.col("w")))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = (w.withColumn("total", F.sum("source_size").over(every)).withColumn("w_all", F.sum("w").over(every))
         .withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
         .withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
         .withColumn("level", (F.col("total") - F.col("full")) / F.col("w_left")))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return w.withColumn("target", F.least(F.col("limit"), F.coalesce(first * F.col("w"), F.col("limit")))) \
            .select("source", "source_size", "target")


def balance(docs: DataFrame, size: str, constraints: dict[str, DataFrame], cap: float = MAX_COPIES,
            base_rate: str | None = None, max_steps: int = 60) -> DataFrame:
    """``docs`` with a column ``rate``. ``constraints``: column -> frame (value, target). Raises if the residual
    does not fall below the tolerance (targets that contradict each other or exceed the cap)."""
    keys = list(constraints)
    work = docs.withColumn(_BASE, F.col(base_rate).cast("double") if base_rate else F.lit(1.0)) \
               .withColumn(_SIZE, F.col(size).cast("double"))
    cells = cut(work.groupBy(*keys, _BASE).agg(F.sum(_SIZE).alias(_SIZE)), "mix-cells")
    dual = {k: cut(t.select(F.col(t.columns[0]).alias(_KEY), F.col(t.columns[1]).cast("double").alias("target"),
                            F.lit(0.0).alias("lam")), "mix-dual") for k, t in constraints.items()}

    def rates(frame: DataFrame) -> DataFrame:
        for i, k in enumerate(keys):
            d = dual[k].select(F.col(_KEY).alias(f"__k{i}"), F.col("lam").alias(f"__l{i}"))
            frame = frame.join(d, F.col(k).eqNullSafe(F.col(f"__k{i}")), "left").drop(f"__k{i}")
        tilt = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__l{i}"), F.lit(0.0)) for i in range(len(keys))])
        return frame.withColumn("rate", F.least(F.lit(float(cap)), F.col(_BASE) * F.exp(tilt))) \
                    .drop(*[f"__l{i}" for i in range(len(keys))])

    for step in range(max_steps + 1):
        worst = 0.0
        for k in keys:
            reach = rates(cells).groupBy(F.col(k).alias("__v")).agg(
                F.sum(F.col(_SIZE) * F.col("rate")).alias("reached"),
                F.sum(F.when(F.col("rate") < cap, F.col(_SIZE) * F.col("rate"))).alias("slope"),
                F.sum(F.col(_SIZE)).alias("tokens"))
            d = dual[k].join(reach, F.col(_KEY).eqNullSafe(F.col("__v")), "left").drop("__v")
            gap = F.col("target") - F.coalesce(F.col("reached"), F.lit(0.0))
            # Newton on the logarithm of the optimality condition (the same root; one step is exact where no
            # cap binds), held to +-4 so that the cap's kink cannot throw it out. A constraint whose cells all
            # stand at the cap, and one without tokens, stay where they are.
            newton = F.log(F.greatest("target", F.lit(1e-300)) / F.col("reached")) * F.col("reached") / F.col("slope")
            move = F.when(F.col("tokens") > 0, F.when(F.col("slope") > 0, F.greatest(F.lit(-4.0), F.least(
                F.lit(4.0), newton))).when(gap < 0, F.lit(-1.0)))
            at = cut(d.select(_KEY, "target", (F.col("lam") + F.coalesce(move, F.lit(0.0))).alias("lam"),
                              F.when(F.col("tokens") > 0, F.abs(gap) / F.greatest("target", F.lit(1.0)))
                              .alias("residual")), "mix-dual")
            worst = max(worst, at.agg(F.max("residual")).first()[0] or 0.0)
            dual[k] = at.drop("residual")
        if worst < TOLERANCE:
            break
    else:
        raise ValueError(f"entropy balancing did not reach the targets: relative residual {worst:.3g}")
    return rates(work).drop(_BASE, _SIZE)


def _round_slot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of one slot's documents, in the given order, carrying the rounding error on."""
    error, copies = 0.0, []
    for size, rate, cap in zip(pdf["__size"], pdf["rate"], pdf["__cap"]):
        want = rate * size + error
        n = min(cap, max(0, int(want / size + 0.5))) if size > 0 else 0
        error = want - n * size
        copies.append(n)
    return pdf.assign(copies=copies)


def copies(rated: DataFrame, doc_id: str, source: str, size: str, place: str, cap: int = MAX_COPIES,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """``rated`` (a frame with ``rate``) reduced to (doc_id, source, size, rate, copies long) and ``keep``, row by row.
    ``place`` is a number of its own for every row."""
    slots = rated.groupBy(F.col(source).alias("__s")).agg(
        F.ceil(F.count(F.lit(1)) / SLOT_ROWS).cast("int").alias("__slots"))
    work = (rated.select(F.col(doc_id).alias("__id"), F.col(source).alias("__source"), F.col(size).alias("__size"), "rate",
                         F.col(place).alias("__place"), *keep)
            .join(slots, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
            .withColumn("__cap", F.lit(int(cap)))
            .withColumn("__slot", F.pmod(F.xxhash64("__place"), F.col("__slots")).cast("int")))
    # ids stay out of the Python rows: with nulls among them they would pass through floats
    schema = T.StructType([*[f for f in work.schema.fields if f.name != "__id"], T.StructField("id", T.StringType()),
                           T.StructField("copies", T.LongType())])

    def slot(pdf):
        pdf = pdf.sort_values("__place", kind="stable").sort_values("__size", ascending=False, kind="stable")
        return _round_slot(pdf)

    work = work.withColumn("id", F.col("__id").cast("string")).drop("__id")
    out = work.groupBy("__source", "__slot").applyInPandas(slot, schema)
    return out.select(F.col("id").cast(rated.schema[doc_id].dataType).alias(doc_id), F.col("__source").alias(source),
                      F.col("__size").alias(size), "rate", "copies", *keep)


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = MAX_COPIES, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken for every document; with ``row`` (a column that
    numbers the rows) that column too."""
    # written first: dealing into ranges reads its input twice, and texts are to be counted once
    numbered = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               (F.col(row) if row else F.monotonically_increasing_id()).alias(_ROW)), "mix-numbered")
    # rows alike in id, source and size are alike in the result, so places do not depend on how rows are dealt
    sizes = cut(with_surrogate(numbered, ["doc_id", "source", "size", _ROW], _PLACE), "mix-sizes")
    targets = cut(source_targets(sizes, "source", "size", weights, cap), "mix-targets")
    rated = balance(sizes, "size", {"source": targets.select("source", "target")}, cap)
    t = targets.withColumnRenamed("source", "__t")
    out = (copies(rated, "doc_id", "source", "size", _PLACE, cap, (_ROW,))
           .join(t, F.col("source").eqNullSafe(F.col("__t"))).drop("__t")
           .withColumn("taken", F.col("copies") * F.col("size")))
    return out.withColumnRenamed(_ROW, row) if row else out.drop(_ROW)
