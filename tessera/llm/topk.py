"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (dimension, weight) terms with integer weights. Rows travel as blocks: a
candidate block keeps one posting list per dimension, a query block keeps its sparse rows, both with the narrowest
integers that hold their weights. The candidate blocks are dealt to groups, one for each task; every query block meets every
candidate block once, in the task of its group. There each query term scatters ``query weight * posting weight`` into a dense
score array, a partition selection keeps the k best, and the k best of a group leave the task; a window with a limit merges
the groups' lists per query.

Bounds: a task holds the candidate blocks of its group, one query block with its k best so far, and a score array of
``TILE x CANDIDATE_BLOCK``; nothing but the groups' numbers is collected, no side is broadcast (the query blocks stand once for every
group, which the size of their files does not show, so the join is told), and the blocks are recomputed from their Parquet copy in the
shared folder when an executor is lost.

Edge cases: null vectors and vectors holding a null or non-finite component take no part (neither as
query nor as candidate). Every finite vector stays: a quantised component or a score of the result that does not fit
64 bits raises, and blocks whose scores could pass 64 bits are scored in Python integers. An empty vector, and
dimensions beyond the shorter vector, count as zeros. Equal scores rank by smaller id, rows that repeat
an id each stand in the ranking but never rank for a query of that id. Empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 4096
LIMIT = 2.0 ** 63
TILE = 32                # query rows scored at a time
WIDE_ROWS = 16           # the same in Python integers

_BLOCK = "block long, place int, n int, ids binary, dims int, width int, weights binary"


def quantise(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, terms array<long>): floor(scale * component), valid vectors only."""
    v = F.col(vector_col)
    too_big = F.raise_error(F.lit("a vector component does not fit 64 bits after scaling")).cast("long")
    scaled = F.transform(v, lambda x: F.when(F.abs(x.cast("double") * scale) < LIMIT, F.floor(x.cast("double") * scale))
                         .otherwise(too_big))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN sorts above
    return (vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(finite)
            .select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("terms")))


def _blocks(rows: int, groups: int = 1):
    """mapInPandas function: consecutive vectors of a partition as dense integer blocks of at most ``rows``, dealt in turn to places."""
    import pandas as pd

    def pack(batches):
        from pyspark import TaskContext
        at_task, seq = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at:at + rows]
                dims = max((len(t) for t in part["terms"]), default=0)
                m = np.zeros((len(part), dims), dtype="<i8")
                for i, t in enumerate(part["terms"]):
                    m[i, :len(t)] = t
                ids = part["vec_id"].to_numpy("<i8")
                order = np.argsort(ids, kind="stable")
                low, high = int(m.min(initial=0)), int(m.max(initial=0))
                width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
                yield pd.DataFrame({"block": [(at_task << 32) + seq], "place": [(7919 * at_task + seq) % groups], "n": [len(part)],
                                    "ids": [ids[order].tobytes()], "dims": [dims], "width": [width],
                                    "weights": [m[order].astype(f"<i{width}").tobytes()]})
                seq += 1
    return pack


def _kind(q, c):
    """The narrowest integers that hold every partial sum of the products of two blocks' rows."""
    long = [np.sqrt((x.astype("f8") ** 2).sum(axis=1).max(initial=0)) for x in (q, c)]     # no partial sum is above their product
    if long[0] * long[1] < 2 ** 15 - 1:
        return np.int16
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.int32 if top < 2 ** 30 else np.int64 if top < 2 ** 63 else object


def block_top_k(q_ids, q, c_ids, c, k: int, least=None):
    """The k best candidates of one block for each query row: (query position, candidate positions, scores). Where
    ``least`` gives a query row's score (not None), lower ones are left out.

    ``c_ids`` ascend, so among equal scores the earlier position is the smaller id."""
    nq, nc = len(q_ids), len(c_ids)
    dims = min(q.shape[1], c.shape[1])
    q, c = q[:, :dims].astype("<i8"), c[:, :dims].astype("<i8")
    kind = _kind(q, c)
    c, q = np.ascontiguousarray(c.T.astype(kind)), np.ascontiguousarray(q.T.astype(kind))
    postings = [np.flatnonzero(x) for x in c]
    own = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    out, tile = [], WIDE_ROWS if kind is object else TILE
    for at in range(0, nq, tile):
        n = min(tile, nq - at)
        scores, term = np.zeros((n, nc), dtype=kind), np.empty((n, nc), dtype=kind)
        for d in range(dims):                                   # one term at a time
            of, posting = q[d, at:at + n], postings[d]
            rows = np.flatnonzero(of)
            if not len(rows) or not len(posting):
                continue
            if 4 * len(posting) >= nc and 4 * len(rows) >= n:   # a long list: add it as one dense column
                scores += np.multiply(of[:, None], c[d], out=term)
            else:
                scores[np.ix_(rows, posting)] += np.multiply.outer(of[rows], c[d, posting])
        for i in range(n):
            s, (low, high) = scores[i], (own[0][at + i], own[1][at + i])
            if least is not None and least[at + i] is not None:
                keep = np.flatnonzero(s >= least[at + i])
                keep = keep if low == high else keep[(keep < low) | (keep >= high)]
            else:
                keep = np.arange(nc) if low == high else np.concatenate([np.arange(low), np.arange(high, nc)])
            if not len(keep):
                continue
            s = s[keep]
            m = min(k, len(keep))
            kth = np.partition(s, len(s) - m)[len(s) - m]
            above = np.flatnonzero(s > kth)
            best = np.concatenate([above, np.flatnonzero(s == kth)[:m - len(above)]])
            out.append((at + i, keep[best], s[best] if kind is object else s[best].astype(np.int64)))
    return out


def _merged(a, b, k: int):
    """The k best of two lists (ids, scores), best first; among equal scores the smaller id."""
    ids, scores = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    if scores.dtype == object:
        best = np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k])
    else:
        best = np.lexsort((ids, ~scores))[:k]
    return ids[best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with every
    vector of another id. Both frames are (vec_id long, terms array<long>), see ``quantise``."""
    spark = vectors.sparkSession
    groups = partitions(spark)
    # numbers of groups that the join's hash sends to one partition each
    at = F.pmod(F.hash(F.col("id").cast("int")), F.lit(groups))
    numbers = [r["g"] for r in spark.range(16 * groups).groupBy(at.alias("at")).agg(F.min("id").cast("int").alias("g")).collect()]
    cand = cut(vectors.mapInPandas(_blocks(candidate_block, len(numbers)), _BLOCK), "topk-candidates")
    ask = cut(queries.mapInPandas(_blocks(query_block), _BLOCK), "topk-queries")
    parts = ("block", "n", "ids", "dims", "width", "weights")
    of = F.lit(numbers).cast("array<int>")
    left = ask.select(F.explode(of).alias("g"), *[F.col(c).alias(f"q_{c}") for c in parts])
    right = cand.select(of[F.col("place")].alias("g"), *[F.col(c).alias(f"c_{c}") for c in parts if c != "block"]).repartition(groups, "g")  # so many tasks, however few bytes

    def fitting(scores):
        """Scores as longs: one above their range is in every result, one below ranks last (and raises if it is in the result)."""
        if max(scores) >= 2 ** 63:
            raise OverflowError("a score of the result does not fit 64 bits")
        return [int(s) if s >= -2 ** 63 else None for s in scores]

    def block(n, dims, width, weights):
        return np.frombuffer(weights, f"<i{width}").reshape(n, dims)

    def score(rows):
        asked, qi, best = None, [], []

        def ready():
            for query, found in zip(qi, best):
                if found is not None:
                    ids, s = found
                    yield from zip([int(query)] * len(ids), ids.tolist(), s.tolist() if s.dtype != object else fitting(s))

        for r in rows:                                      # rows are pickled in batches bounded by bytes
            if r.q_block != asked:                          # a query block meets its candidate blocks one after the other
                yield from ready()
                asked, qi, q = r.q_block, np.frombuffer(r.q_ids, "<i8"), block(r.q_n, r.q_dims, r.q_width, r.q_weights)
                best, least = [None] * len(qi), [None] * len(qi)
            ci = np.frombuffer(r.c_ids, "<i8")
            for i, places, s in block_top_k(qi, q, ci, block(r.c_n, r.c_dims, r.c_width, r.c_weights), k, least):
                found = ci[places], s
                best[i] = found if best[i] is None else _merged(best[i], found, k)
                if len(best[i][0]) == k:
                    least[i] = int(min(best[i][1]))
        yield from ready()

    found = spark.createDataFrame(left.join(right.hint("merge"), "g").rdd.mapPartitions(score),
                                  "query_id long, vec_id long, score long", verifySchema=False)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    too_low = F.raise_error(F.lit("a score of the result does not fit 64 bits")).cast("long")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.coalesce("score", too_low).alias("score")))
