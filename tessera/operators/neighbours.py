"""Exact nearest neighbours with pivots.

A few pivots are drawn among the points; every point lies on a ring of its nearest pivot. Sorted by (pivot, ring), points are packed
into blocks, and a block keeps its least and largest distance to every pivot. By the triangle inequality a point of block B
is at least ``max_p(B.low[p] - A.high[p], A.low[p] - B.high[p])`` away from every point of block A, so B is visited only if that is no
more than A's reach: the largest distance that a point of A has to its k-th neighbour inside its own block. Candidate pairs of blocks
come from a join of ring intervals, never from all pairs; a task then visits a block's partners nearest first and
skips those that the neighbours found meanwhile rule out.

Points that stand more than once are one point with its k + 1 smallest keys, since no other of its keys can be anyone's
neighbour; so a group of equal rows of any size costs one point, and its other rows take that point's answer. A task holds
two blocks; what reaches the driver is the pivots and one number per pivot. Keys are unique; ties go to the smaller key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import kmeans
from tessera.session import checkpoint_dir

PIVOTS = 8
RINGS = 64              # intervals of a pivot's distances in the join of blocks
ASK = 128               # rows that ask at once
BLOCK = 1024
SLACK = 1e-9            # relative room for rounding in the bounds


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, summed feature by feature (equal rows have distance 0)."""
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c][:, None] - y[:, c][None, :]) ** 2
    return d


class Best:
    """The ``k`` nearest candidates of every asking row, ordered by (distance, key), with their vectors."""

    def __init__(self, ask: np.ndarray, k: int):
        self.ask, self.k = ask, k
        self.d = np.full((len(ask), k), np.inf)
        self.id = np.full((len(ask), k), np.iinfo(np.int64).max)
        self.v = np.zeros((len(ask), k, ask.shape[1]))

    def reach(self) -> float:
        """Squared distance within which another candidate could still enter a list."""
        return float(self.d[:, -1].max()) if len(self.d) else -1.0

    def add(self, points: np.ndarray, ids: np.ndarray, of: np.ndarray) -> None:
        """Candidates ``ids`` standing at ``points[of]``."""
        for at in range(0, len(self.ask), ASK):
            part = slice(at, at + ASK)
            d = squared(self.ask[part], points)[:, of]
            rows, cols = np.nonzero(d <= np.minimum(self.d[part, -1], _kth(d, self.k))[:, None])
            if not len(rows):
                continue
            n = len(self.d[part])
            all_row = np.concatenate([np.repeat(np.arange(n), self.k), rows])
            all_d = np.concatenate([self.d[part].ravel(), d[rows, cols]])
            all_id = np.concatenate([self.id[part].ravel(), ids[cols]])
            order = np.lexsort((all_id, all_d, all_row))
            first = np.searchsorted(all_row[order], np.arange(n))
            take = order[(first[:, None] + np.arange(self.k)).ravel()]
            old = take < n * self.k
            v = np.empty((len(take), self.ask.shape[1]))
            v[old] = self.v[part].reshape(n * self.k, -1)[take[old]]
            v[~old] = points[of[cols[take[~old] - n * self.k]]]
            self.d[part], self.id[part] = all_d[take].reshape(n, -1), all_id[take].reshape(n, -1)
            self.v[part] = v.reshape(n, self.k, -1)


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    return np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)


@dataclass
class Search:
    """The prepared search: packed blocks and the pairs of blocks that may hold neighbours."""

    vec: DataFrame          # _a, _v
    points: DataFrame       # _v, ids (at most k + 1 of them)
    blocks: DataFrame       # block, pivot, ids, owner, points, low, high, reach
    pairs: DataFrame        # a, b, bound (squared; -1: the block itself)
    width: int
    k: int


def prepare(rows: DataFrame, features: list[str], k: int, key: str, block: int = BLOCK, pivots: int = PIVOTS) -> Search | None:
    """None where there are no rows."""
    spark, width = rows.sparkSession, len(features)
    checkpoint_dir(spark)  # the cluster's shared folder (set locally only when unset)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vec = rows.select(F.col(key).cast("long").alias("_a"),
                      F.array(*[F.col(c).cast("double") for c in features]).alias("_v")).checkpoint(eager=True)
    # Spark limits each group to k + 1 rows before the shuffle
    first = vec.withColumn("_n", F.row_number().over(Window.partitionBy("_v").orderBy("_a"))).where(F.col("_n") <= k + 1)
    points = first.groupBy("_v").agg(F.array_sort(F.collect_list("_a")).alias("ids")).checkpoint(eager=True)
    draw = kmeans.Model(pivots, 0, 0)
    packed = kmeans.packed(points.select(F.col("ids")[0].alias("p"), F.col("_v").alias("features")), "p")
    for step in range(pivots):
        kmeans._draw(packed, [draw], step, 42)
        if not len(draw.centres):
            return None
    centres = np.unique(draw.centres, axis=0)

    def ring(batches):
        import pyarrow as pa
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            d = np.sqrt(squared(x, centres))
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])],
                                             ["_v", "ids", "pivot", "ring"])

    placed = points.mapInArrow(ring, "_v array<double>, ids array<long>, pivot int, ring double")
    placed = placed.repartitionByRange(parts, "pivot", "ring", F.col("ids")[0]).sortWithinPartitions("pivot", "ring", F.col("ids")[0])

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number, held = TaskContext.get().partitionId() << 32, []

        def out(pivot, x, ids):
            nonlocal number
            owner = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            flat = np.concatenate(ids).astype("<i8")
            best = Best(x, k + 1)
            best.add(x, flat, owner)
            d = np.sqrt(squared(x, centres))
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((number, pa.int64()), (pivot, pa.int32()), (flat.tobytes(), pa.binary()), (owner.astype("<i4").tobytes(), pa.binary()),
                                               (x.tobytes(), pa.binary()), (d.min(axis=0).tolist(), pa.list_(pa.float64())),
                                               (d.max(axis=0).tolist(), pa.list_(pa.float64())), (best.reach(), pa.float64()))],
                ["block", "pivot", "ids", "owner", "points", "low", "high", "reach"])

        def blocks(whole):
            """Blocks of one pivot each; the last one waits for more rows unless ``whole``."""
            nonlocal held
            while held and (whole or len(held) > block or held[-1][0] != held[0][0]):
                n = next((i for i, h in enumerate(held[:block]) if h[0] != held[0][0]), min(block, len(held)))
                now, held = held[:n], held[n:]
                yield out(now[0][0], np.array([h[1] for h in now], dtype="<f8").reshape(n, width), [np.array(h[2]) for h in now])

        for batch in batches:
            v, ids, pivot, _ = (c.to_pylist() for c in batch.columns)
            held += list(zip(pivot, v, ids))
            yield from blocks(False)
        yield from blocks(True)

    schema = "block long, pivot int, ids binary, owner binary, points binary, low array<double>, high array<double>, reach double"
    blocks = placed.mapInArrow(pack, schema).checkpoint(eager=True)
    return Search(vec, points, blocks, _pairs(blocks, len(centres)), width, k)


def _pairs(blocks: DataFrame, pivots: int) -> DataFrame:
    """(a, b, bound): blocks b that may hold neighbours of block a, by a join of ring intervals."""
    far = {r["pivot"]: r["m"] for r in blocks.select("pivot", F.col("high")[F.col("pivot")].alias("h")).groupBy("pivot").agg(F.max("h").alias("m")).collect()}
    step = F.array(*[F.lit((far.get(p) or 0.0) / RINGS or 1.0) for p in range(pivots)])
    interval = lambda x, p: F.least(F.greatest(F.floor(x / step[p]), F.lit(0)), F.lit(RINGS)).cast("int")
    b = blocks.select(F.col("block").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), "pivot")
    b = b.withColumn("from_b", interval(F.col("bl")[F.col("pivot")], F.col("pivot"))).withColumn("to_b", interval(F.col("bh")[F.col("pivot")], F.col("pivot")))
    b = b.withColumn("bin", F.explode(F.sequence("from_b", "to_b"))).drop("to_b")
    a = blocks.select(F.col("block").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), (F.sqrt("reach") * (1 + SLACK) + SLACK).alias("r"))
    a = a.withColumn("pivot", F.explode(F.sequence(F.lit(0), F.lit(pivots - 1))))
    a = a.withColumn("from_a", interval(F.col("al")[F.col("pivot")] - F.col("r"), F.col("pivot"))) \
         .withColumn("to_a", interval(F.col("ah")[F.col("pivot")] + F.col("r"), F.col("pivot")))
    a = a.withColumn("bin", F.explode(F.sequence("from_a", "to_a"))).drop("to_a")
    apart = F.array_max(F.zip_with(F.zip_with("bl", "ah", lambda x, y: x - y), F.zip_with("al", "bh", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    bound = F.greatest(apart, F.lit(0.0))
    # a pair meets in several intervals; the first common one counts
    return (a.join(b, ["pivot", "bin"]).where((F.col("bin") == F.greatest("from_a", "from_b")) & (bound <= F.col("r")))
            .select("a", "b", F.when(F.col("a") == F.col("b"), F.lit(-1.0)).otherwise(bound).alias("bound")))


def answers(s: Search) -> DataFrame:
    """(p, ids, vectors): the k + 1 nearest candidates of every point, p being its smallest key."""
    width, k = s.width, s.k
    payload = s.blocks.select(F.col("block").alias("b"), "ids", "owner", "points")
    work = s.pairs.join(payload, "b").repartition(F.col("a")).sortWithinPartitions("a", "bound", "b")

    def visit(batches):
        import pyarrow as pa
        best = asked = None
        now = None

        def out():
            heads = np.unique(asked[1], return_index=True)[1]
            found = best.id != np.iinfo(np.int64).max
            ids = [row[f].tolist() for row, f in zip(best.id, found)]
            vectors = [[x.tolist() for x in v[f]] for v, f in zip(best.v, found)]
            return pa.RecordBatch.from_arrays([pa.array(asked[0][heads], pa.int64()), pa.array(ids, pa.list_(pa.int64())),
                                               pa.array(vectors, pa.list_(pa.list_(pa.float64())))], ["p", "near", "vectors"])

        for batch in batches:
            for a, bound, ids, owner, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids, owner = np.frombuffer(ids, "<i8"), np.frombuffer(owner, "<i4")
                points = np.frombuffer(raw, "<f8").reshape(-1, width)
                if a != now:
                    if best is not None:
                        yield out()
                    now, best, asked = a, Best(points, k + 1), (ids, owner)
                elif bound * bound * (1 - SLACK) - SLACK > best.reach():
                    continue
                best.add(points, ids, owner)
        if best is not None:
            yield out()

    return work.select("a", "bound", "ids", "owner", "points").mapInArrow(visit, "p long, near array<long>, vectors array<array<double>>")


def nearest(rows: DataFrame, features: list[str], k: int, key: str, block: int = BLOCK) -> DataFrame:
    """(_a, _r, _b, _nv): the exact k nearest other rows of every row (Euclidean; ties by key), with their features."""
    s = prepare(rows, features, k, key, block)
    if s is None:
        return rows.sparkSession.createDataFrame([], "_a long, _r int, _b long, _nv array<double>")
    got = answers(s).join(s.points.select(F.col("ids")[0].alias("p"), "_v", "ids"), "p").checkpoint(eager=True)  # read twice
    listed = got.select(F.explode("ids").alias("_a"), "near", "vectors")
    # rows beyond the k + 1 listed ones of their point take its answer; the point's one row is repeated for salts
    salts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = got.where(F.size("ids") > k).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rest = s.vec.join(listed.select("_a"), "_a", "left_anti").withColumn("salt", F.pmod(F.xxhash64("_a"), F.lit(salts)).cast("int"))
    rest = rest.join(full, ["_v", "salt"]).select("_a", "near", "vectors")
    own = F.filter(F.arrays_zip("near", "vectors"), lambda x: x["near"] != F.col("_a"))
    return (listed.unionByName(rest).select("_a", F.posexplode(F.slice(own, 1, k)).alias("_r", "x"))
            .select("_a", (F.col("_r") + 1).alias("_r"), F.col("x.near").alias("_b"), F.col("x.vectors").alias("_nv")))
