"""Many K-Means models fitted together: every (k, start) shares the passes over the rows.

Rows are packed once into blocks (keys and a matrix of doubles). The centres of all models that still move are sent together;
a pass multiplies each block with them, and one aggregate sums counts, distances and vectors by (model, cluster). Converged
models leave. So the number of jobs is that of the slowest model, not of all fits, and each job reads the rows once.

* Starts are k-means++, drawn without a pass per model: in pass j every row runs an exponential race, -ln(u) / D², whose
  smallest key is a draw in proportion to D²; u comes from a hash of the row's key, so reruns and any partitioning agree.
* A model ends when its centres move by no more than ``tol`` times the mean variance, or after ``max_iter`` passes; an empty cluster keeps its centre.
* The silhouette is Euclidean, of a sample bounded by ``SILHOUETTE_ROWS`` rows (by a hash of the key; all rows where there are fewer)
  against its own clusters, for all models in one pass: blocks of the sample meet the whole sample.

What reaches the driver is one row per (model, cluster), ``FEW_TASKS`` times that at most, and the silhouette's bounded sample. Each task of
each pass also reports its metrics there, so a pass has ``CORE_TASKS`` tasks a core however many rows there are (more only where a
task would hold over ``MOST_ROWS`` rows), and is one stage while they are few.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

BLOCK = 8192
ASK = 1024              # rows of a block worked on at once
TASK_ROWS = 4096        # rows of a task, at least
CORE_TASKS = 2          # tasks of a core
MOST_ROWS = 1_000_000   # rows of a task, at most, about
FEW_TASKS = 32          # up to so many tasks hand their sums straight to the driver
SILHOUETTE_ROWS = 5_000


@dataclass
class Model:
    k: int
    start: int
    max_iter: int
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    inertia: float = 0.0
    iterations: int = 0
    done: bool = False


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1] for every key, by a 64-bit mix of key and salt."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x1234567) % 2 ** 64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0 ** 53


def packed(vec: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(ids, points, n): consecutive rows of a partition as blocks of about ``BLOCK`` rows."""
    as_array = vector_to_array(features) if isinstance(vec.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")

    def pack(batches):
        ids, points = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            points.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids[-1]), -1))
            if sum(map(len, ids)) >= BLOCK:
                yield out(ids, points)
                ids, points = [], []
        if sum(map(len, ids)):
            yield out(ids, points)

    def out(ids, points):
        import pyarrow as pa
        i, x = np.concatenate(ids), np.concatenate(points)
        return pa.RecordBatch.from_arrays([pa.array([i.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
                                           pa.array([len(i)], pa.int64())], ["ids", "points", "n"])

    return vec.select(F.col(key).cast("long").alias("id"), as_array.alias("x")).mapInArrow(pack, "ids binary, points binary, n long")


def _blocks(batches):
    """(ids, points) of every block of Arrow batches of packed rows."""
    for batch in batches:
        for ids, points, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            yield np.frombuffer(ids, "<i8"), np.frombuffer(points, "<f8").reshape(n, -1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, summed feature by feature so that equal points have distance 0."""
    d = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        d += (x[:, j][:, None] - centres[:, j][None, :]) ** 2
    return d


def _draw(blocks: DataFrame, models: list[Model], step: int, seed: int) -> None:
    """Append one k-means++ centre to every model: the winner of a race in proportion to D²."""
    have = [m.centres for m in models]
    salts = [((seed * 131 + m.start) * 131 + m.k) * 131 + step for m in models]

    def race(batches):
        import pyarrow as pa
        best = [(np.inf, 0, b"")] * len(have)
        for ids, x in _blocks(batches):
            for at in range(0, len(ids), ASK):
                i, part = ids[at:at + ASK], x[at:at + ASK]
                d = _distances(part, np.concatenate(have)) if step else None
                for m, centres in enumerate(have):
                    near = d[:, m * step:(m + 1) * step].min(axis=1) if step else np.ones(len(i))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        race_key = np.where(near > 0, -np.log(uniform(i, salts[m])) / near, np.inf)
                    w = np.lexsort((i, race_key))[0]
                    found = (float(race_key[w]), int(i[w]), part[w].tobytes())
                    if not best[m][2] or found[:2] < best[m][:2]:
                        best[m] = found
        rows = [(m, *b) for m, b in enumerate(best) if b[2]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.int64(), pa.binary()))],
                                             ["m", "key", "id", "point"])

    won = blocks.mapInArrow(race, "m int, key double, id long, point binary") \
        .groupBy("m").agg(F.min_by("point", F.struct("key", "id")).alias("point")).collect()      # a row per model
    for r in won:
        point = np.frombuffer(bytes(r["point"]), "<f8")[None]
        model = models[r["m"]]
        model.centres = np.concatenate([model.centres, point]) if len(model.centres) else point


def _pass(blocks: DataFrame, models: list[Model], width: int):
    """An array (k, 2 + width) per model, from one job: rows, summed squared distance and summed vector of every cluster."""
    groups: dict[int, list[int]] = {}                       # models of the same k are assigned together
    for i, m in enumerate(models):
        groups.setdefault(m.k, []).append(i)
    stacked = {k: np.stack([models[i].centres for i in of]) for k, of in groups.items()}
    edges = dict(zip(groups, np.cumsum([0, *[k * len(of) for k, of in groups.items()]])))
    size = sum(k * len(of) for k, of in groups.items())

    def sums(batches):
        total = np.zeros((size, width + 2))
        for _, x in _blocks(batches):
            for at in range(0, len(x), ASK):
                part = x[at:at + ASK]
                rows = np.arange(len(part))[:, None]
                own = (part * part).sum(axis=1)
                for k, centres in stacked.items():
                    flat = centres.reshape(-1, width)
                    # |c|² - 2 x.c orders the centres of a row as their distances do
                    score = ((flat * flat).sum(axis=1) - 2 * (part @ flat.T)).reshape(len(part), -1, k)
                    near = score.argmin(axis=2)
                    one = np.zeros((len(part), len(flat)))
                    one[rows, near + k * np.arange(len(centres))] = 1
                    t = total[edges[k]:edges[k] + len(flat)]
                    t[:, 0] += one.sum(axis=0)
                    t[:, 1] += own @ one
                    t[:, 2:] += one.T @ part
        return total

    def few(batches):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([sums(batches).tobytes()], pa.binary())], ["t"])

    def many(batches):
        import pyarrow as pa
        total = sums(batches)
        used = np.flatnonzero(total[:, 0])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(total[used, c]) for c in range(width + 2)]],
                                             ["c", *[f"v{c}" for c in range(width + 2)]])

    total = np.zeros((size, width + 2))
    if blocks.rdd.getNumPartitions() <= FEW_TASKS:          # a few arrays of the models' size
        for r in blocks.mapInArrow(few, "t binary").collect():
            total += np.frombuffer(bytes(r["t"]), "<f8").reshape(size, -1)
    else:
        cols = [f"v{c}" for c in range(width + 2)]
        got = blocks.mapInArrow(many, "c int, " + ", ".join(f"{c} double" for c in cols)) \
            .groupBy("c").agg(*[F.sum(c).alias(c) for c in cols]).collect()                       # a row per (model, cluster)
        for r in got:
            total[r["c"]] = r[1:]
    out: list = [None] * len(models)
    for k, of in groups.items():
        for place, i in enumerate(of):
            t = total[edges[k] + place * k:edges[k] + (place + 1) * k].copy()
            c = models[i].centres
            # from the sums: sum |x - c|² = sum |x|² - 2 c . sum x + n |c|²
            t[:, 1] = np.maximum(t[:, 1] - 2 * (c * t[:, 2:]).sum(axis=1) + t[:, 0] * (c * c).sum(axis=1), 0)
            out[i] = t
    return out


def lloyd(blocks: DataFrame, models: list[Model], tol: float = 1e-4) -> list[Model]:
    """Move the centres of all models until they rest; ``inertia`` belongs to the final centres."""
    width = models[0].centres.shape[1]
    first = blocks.mapInArrow(_moments(width), "n double, " + ", ".join(f"s{c} double, q{c} double" for c in range(width)))
    row = first.agg(F.sum("n"), *[F.sum(f"{p}{c}") for c in range(width) for p in "sq"]).first()
    n = row[0] or 1.0
    spread = float(np.mean([max(0.0, row[2 + 2 * c] / n - (row[1 + 2 * c] / n) ** 2) for c in range(width)])) if row[0] else 0.0
    moving = list(models)
    while moving:
        still = []
        for m, sums in zip(moving, _pass(blocks, moving, width)):
            m.inertia = float(sums[:, 1].sum())
            if m.done:                                      # this pass gave the inertia of its final centres
                continue
            after = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1), m.centres)
            shift = float(((after - m.centres) ** 2).sum())
            m.centres, m.iterations = after, m.iterations + 1
            m.done = shift <= tol * spread or m.iterations >= m.max_iter
            still.append(m)
        moving = still
    return models


def _moments(width: int):
    def run(batches):
        import pyarrow as pa
        for _, x in _blocks(batches):
            values = [float(len(x)), *[v for c in range(width) for v in (x[:, c].sum(), (x[:, c] ** 2).sum())]]
            names = ["n", *[f"{p}{c}" for c in range(width) for p in "sq"]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)
    return run


def fit_many(blocks: DataFrame, ks, starts: int, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> list[Model]:
    """``starts`` models for every k of ``ks``, over packed rows. Without rows there are no models."""
    models = [Model(k, s, max_iter) for k in ks for s in range(starts)]
    for step in range(max(m.k for m in models)):
        drawing = [m for m in models if m.k > step]
        _draw(blocks, drawing, step, seed)
        if not len(drawing[0].centres):
            return []
    return lloyd(blocks, models, tol)


def best_per_k(models: list[Model]) -> dict[int, Model]:
    """k -> the model with the lowest inertia (the first of equals)."""
    out: dict[int, Model] = {}
    for m in sorted(models, key=lambda m: (m.k, m.inertia, m.start)):
        out.setdefault(m.k, m)
    return out


def silhouettes(blocks: DataFrame, models: list[Model], rows: int = SILHOUETTE_ROWS, seed: int = 42) -> list[float]:
    """Mean Euclidean silhouette of every model over the bounded sample, in one pass of its blocks."""
    spark = blocks.sparkSession
    n = blocks.agg(F.sum("n")).first()[0] or 0
    limit = 1.0 if n <= rows else min(1.0, 1.2 * rows / n + 20 / n)     # a little more, then exactly ``rows``

    def pick(batches):
        import pyarrow as pa
        for ids, x in _blocks(batches):
            u = uniform(ids, seed)
            keep = u <= limit
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(ids[keep]), pa.array([p.tobytes() for p in x[keep]], pa.binary())],
                                             ["u", "id", "point"])

    found = blocks.mapInArrow(pick, "u double, id long, point binary").orderBy("u", "id").limit(rows).collect()
    if not found:
        return [float("nan")] * len(models)
    x = np.stack([np.frombuffer(bytes(r["point"]), "<f8") for r in found])
    labels = [_distances(x, m.centres).argmin(axis=1) for m in models]
    shared = spark.sparkContext.broadcast((x, labels, [m.k for m in models]))     # at most ``rows`` rows

    def score(batches):
        import pyarrow as pa
        x, labels, ks = shared.value
        one = [np.eye(k)[lab] for k, lab in zip(ks, labels)]
        size = [o.sum(axis=0) for o in one]
        for batch in batches:
            for at in batch.column(0).to_pylist():
                part = slice(at, min(at + ASK // 4, len(x)))
                d = np.sqrt(_distances(x[part], x))
                out = []
                for o, s, lab in zip(one, size, labels):
                    out.append(_silhouette(d @ o, s, lab[part]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), pa.array(out)], ["m", "s"])

    names = list(range(0, len(x), ASK // 4))
    parts_ = spark.createDataFrame([(i,) for i in names], "at long").repartition(len(names))
    got = {r["m"]: r["s"] for r in parts_.mapInArrow(score, "m long, s double").groupBy("m").agg(F.sum("s").alias("s")).collect()}
    shared.unpersist()
    return [got[i] / len(x) for i in range(len(models))]


def _silhouette(to: np.ndarray, size: np.ndarray, own: np.ndarray) -> float:
    """Summed silhouettes of rows with summed distances ``to`` each cluster; a row alone in its cluster counts 0."""
    rows = np.arange(len(own))
    inside = to[rows, own] / np.maximum(size[own] - 1, 1)
    mean = np.where(size > 0, to / np.maximum(size, 1), np.inf)
    mean[rows, own] = np.inf
    outside = mean.min(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = (outside - inside) / np.maximum(inside, outside)
    return float(np.where((size[own] > 1) & np.isfinite(s), s, 0.0).sum())


def keep(vec: DataFrame, key: str, features: str = "features") -> DataFrame:
    """Packed rows, kept in memory or on disk between passes; ``unpersist()`` ends that. Few rows stand in few partitions, one per
    ``TASK_ROWS`` rows, and many rows in ``CORE_TASKS`` a core, since every pass is a job. The blocks go through the checkpoint folder:
    a task of a pass would otherwise carry, and report the metrics of, every operator that made them."""
    checkpoint_dir(vec.sparkSession)  # the cluster's shared folder (set locally only when unset)
    blocks = packed(vec, key, features).checkpoint(eager=True)
    n = blocks.agg(F.sum("n")).first()[0] or 0
    cores = CORE_TASKS * vec.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-n // TASK_ROWS), max(cores, -(-n // MOST_ROWS))))
    now = blocks.rdd.getNumPartitions()
    dealt = blocks if tasks // 2 < now <= tasks else blocks.coalesce(tasks) if tasks < now else blocks.repartition(tasks)
    return dealt.persist(StorageLevel.MEMORY_AND_DISK)
