"""Item-based recommendation.

One plan for every catalogue size, all distributed, nothing collected:
  1. user_item: Σ operations per (user, item), long form (sparse).
  2. item Gram matrix Σ_u v_u v_uᵀ: each task multiplies dense blocks of its
     users (numpy, one user's items kept in one block), adds the products to a
     running sum, hands that on when it holds ``GRAM_CELLS`` cells, and the
     partial sums are summed by (i, j). No per-user pair rows are shuffled.
  3. cosine = dot(i, j) / sqrt(dot(i, i) dot(j, j)).
  4. scores: a blocked matrix product. Users and items are dealt to blocks of about ``USER_BLOCK`` users and
     ``ITEM_BLOCK`` items; user rows (user block, item block) meet the similarity's blocks (item block, candidate block) on
     the item block, a task multiplies the two matrices, and the partial score matrices of a (user block,
     candidate block) are added. No (user, item, candidate) rows exist. Items already used leave there; a
     candidate without similarity to any used item scores 0.
  5. top n per user: (score desc, item id asc) over all free items, zeros included, is chosen
     inside each block of candidates and merged per user; users without
     history get the global top n of the popularity list. Labels come by joins.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import offer_label

# The per-task Gram function below is shipped to executors by value, so
# workers need numpy/pandas only, not this package on their path.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError):  # pragma: no cover - older cloudpickle
    pass

# Labels used when a recommended offer has no name, by slot,
# and when fewer than three offers were found.
DEFAULT_LABELS = ["Offre Culturelle Pass", "Offre Transport Pass", "Offre Sport Pass"]
MISSING_LABELS = ["Offre Culture", "Offre Transport", "Offre Sport"]
BLOCK = 2048  # items per dense block inside a task
GRAM_CELLS = 4_000_000  # cells of partial dot products a task holds before it hands them on
GRAM_START = 100_000  # cells before partial dot products are first added up
GRAM_USERS = 1024  # users multiplied at once
USER_BLOCK, ITEM_BLOCK = 512, 1024  # users and items of a block of the score product, about

U, I, N = "beneficiaire_id", "offre_id", "n"


def user_item(ops: DataFrame) -> DataFrame:
    """A6 in long form: (user, item, n = Σ nb_operations)."""
    return ops.groupBy(U, I).agg(F.sum("nb_operations").cast("long").alias(N))


_GRAM = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()),
                      T.StructField("dot", T.DoubleType())])


def _gram_partition(batches):
    """Per-task Σ v vᵀ over complete users (rows arrive sorted by user)."""
    held: list[pd.Series] = []
    cells = 0
    limit = min(GRAM_START, GRAM_CELLS)  # a few times the distinct pairs, however many users there are
    carry = None

    def products(df):
        """Partial dot products of some complete users, one (i, j)-indexed series per pair of item blocks."""
        items, icode = np.unique(df[I].to_numpy(), return_inverse=True)
        users, ucode = np.unique(df[U].to_numpy(), return_inverse=True)
        vals = df[N].to_numpy().astype(np.float64)

        def dense(at):
            block = np.zeros((len(users), min(BLOCK, len(items) - at)))
            inside = (icode >= at) & (icode < at + BLOCK)
            block[ucode[inside], icode[inside] - at] = vals[inside]
            return block

        for b0 in range(0, len(items), BLOCK):
            left = dense(b0)
            for b1 in range(0, len(items), BLOCK):
                g = left.T @ dense(b1)
                r, c = np.nonzero(g)
                yield pd.Series(g[r, c], index=pd.MultiIndex.from_arrays([items[r + b0], items[c + b1]], names=["i", "j"]))

    def users_of(df):
        """``df`` in pieces of at most GRAM_USERS complete users."""
        starts = np.flatnonzero(np.append(True, df[U].to_numpy()[1:] != df[U].to_numpy()[:-1]))[::GRAM_USERS]
        for x, y in zip(starts, [*starts[1:], len(df)]):
            yield df.iloc[x:y]

    def out(s):
        return s.rename("dot").reset_index().astype({"i": "int64", "j": "int64", "dot": "float64"})

    def total():
        return pd.concat(held).groupby(level=["i", "j"]).sum()

    def add(df):
        nonlocal held, cells, limit
        for piece in users_of(df):
            for part in products(piece):
                held.append(part)
                cells += len(part)
                if cells >= limit:
                    held = [total()]
                    cells = len(held[0])
                    limit = min(GRAM_CELLS, max(limit, 4 * cells))
                    if 2 * cells >= GRAM_CELLS:  # summing frees too little: hand it on
                        yield out(held[0])
                        held, cells = [], 0

    for pdf in batches:
        if carry is not None:
            pdf = pd.concat([carry, pdf], ignore_index=True)
        if pdf.empty:
            continue
        done = (pdf[U] != pdf[U].iloc[-1]).to_numpy()
        carry = pdf[~done]
        if done.any():
            yield from add(pdf[done])
    if carry is not None:
        yield from add(carry)
    if held:
        yield out(total())


def item_similarity(ui: DataFrame) -> DataFrame:
    """Cosine similarity of items over user counts, non-zero pairs only."""
    gram = (ui.repartition(U).sortWithinPartitions(U).select(U, I, N)
            .mapInPandas(_gram_partition, _GRAM)
            .groupBy("i", "j").agg(F.sum("dot").alias("dot"))
            .persist(StorageLevel.MEMORY_AND_DISK))  # at most C x C rows, read by the diagonal and the pairs
    diag = gram.filter(F.col("i") == F.col("j")).select(F.col("i").alias("_k"), F.col("dot").alias("_nn"))
    g = gram.join(diag.withColumnRenamed("_k", "_ki").withColumnRenamed("_nn", "_ni"), F.col("i") == F.col("_ki"))
    g = g.join(diag.withColumnRenamed("_k", "_kj").withColumnRenamed("_nn", "_nj"), F.col("j") == F.col("_kj"))
    return g.select("i", "j", (F.col("dot") / F.sqrt(F.col("_ni") * F.col("_nj"))).alias("similarity"))


_PART = "ub int, cb int, users binary, items binary, scores binary, used_users binary, used_items binary"
_SCORED = T.StructType([T.StructField(U, T.LongType()), T.StructField("cand", T.LongType()), T.StructField("score", T.DoubleType())])


def _columns(scalars):
    """The fields of a row's array of structs as numpy arrays."""
    fields = scalars.flatten()
    return [fields.field(i).to_numpy(zero_copy_only=False) for i in range(fields.type.num_fields)]


def _multiply(batches):
    """(ub, cb, users, candidates, partial scores) of every pair of a user block with a block of the similarity."""
    import pyarrow as pa
    for batch in batches:
        for at in range(batch.num_rows):
            ub, cb = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            users, items, counts = _columns(batch.column(2).slice(at, 1))
            i, j, similar = _columns(batch.column(3).slice(at, 1))
            (user_ids, u), (rows, r), (cands, c) = (np.unique(x, return_inverse=True) for x in (users, i, j))
            right = np.zeros((len(rows), len(cands)))
            right[r, c] = similar
            left = np.zeros((len(user_ids), len(rows)))
            where = np.minimum(np.searchsorted(rows, items), len(rows) - 1)
            known = rows[where] == items
            left[u[known], where[known]] = counts[known]
            raw = [x.tobytes() for x in (user_ids.astype("<i8"), cands.astype("<i8"), left @ right)]
            yield pa.RecordBatch.from_arrays([pa.array([ub], pa.int32()), pa.array([cb], pa.int32()), *[pa.array([x], pa.binary()) for x in raw],
                                              pa.array([None], pa.binary()), pa.array([None], pa.binary())],
                                             ["ub", "cb", "users", "items", "scores", "used_users", "used_items"])


def _zeros(batches):
    """Rows with users and candidates whose scores are 0."""
    import pyarrow as pa
    for batch in batches:
        for at in range(batch.num_rows):
            raw = [batch.column(c).slice(at, 1).flatten().to_numpy().astype("<i8") for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1),
                                              *[pa.array([np.sort(x).tobytes()], pa.binary()) for x in raw], pa.array([b""], pa.binary()),
                                              *[pa.array([None], pa.binary())] * 2],
                                             ["ub", "cb", "users", "items", "scores", "used_users", "used_items"])


def _pack_used(batches):
    """Rows with the users and candidates of a block, and which of them are used."""
    import pyarrow as pa
    for batch in batches:
        for at in range(batch.num_rows):
            users, items, _ = _columns(batch.column(2).slice(at, 1))
            raw = [np.ascontiguousarray(x, "<i8").tobytes() for x in (users, items)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), *[pa.array([None], pa.binary())] * 3,
                                              *[pa.array([x], pa.binary()) for x in raw]],
                                             ["ub", "cb", "users", "items", "scores", "used_users", "used_items"])


def _finish(n):
    """Add a block's partial scores, leave out used items, keep each user's ``n`` best (None: all)."""
    def run(pdf):
        ids = lambda col: [np.frombuffer(x, "<i8") for x in pdf[col].dropna()]
        parts = list(zip(ids("users"), ids("items"), pdf["scores"].dropna()))
        used = list(zip(ids("used_users"), ids("used_items")))
        users = np.unique(np.concatenate([p[0] for p in parts] or [np.zeros(0, "<i8")]))
        cands = np.unique(np.concatenate([p[1] for p in parts] or [np.zeros(0, "<i8")]))
        total, free = np.zeros((len(users), len(cands))), np.ones((len(users), len(cands)), bool)
        for u, c, raw in parts:
            if len(raw):
                total[np.ix_(np.searchsorted(users, u), np.searchsorted(cands, c))] += np.frombuffer(raw, "<f8").reshape(len(u), len(c))
        for u, c in used:   # every item in use is a candidate of its block
            free[np.searchsorted(users, u), np.searchsorted(cands, c)] = False
        total = np.round(total, 9)
        if n is None:
            r, c = np.nonzero(free)
        else:
            order = np.argsort(np.where(free, -total, np.inf), axis=1, kind="stable")[:, :n]   # ties: the smaller id
            r, k = np.nonzero(np.take_along_axis(free, order, axis=1))
            c = order[r, k]
        return pd.DataFrame({U: users[r], "cand": cands[c], "score": total[r, c]})
    return run


def blocked_scores(ui: DataFrame, sim: DataFrame, n: int | None = None, user_block: int = USER_BLOCK,
                   item_block: int = ITEM_BLOCK) -> DataFrame:
    """R2 + J14: (user, cand, score), Σ similarity × count over the user's items, zeros included, for items in use that the
    user has not used; with ``n`` only the ``n`` best of each block of candidates (ties: the smaller id).

    A row of users holds at most a block of users times a block of items, a row of the similarity two blocks of items, so
    memory does not depend on hot users or items; where there are few item blocks, the similarity's rows are repeated
    for a few salts over which user blocks are dealt."""
    size = ui.agg(F.approx_count_distinct(U).alias("u"), F.approx_count_distinct(I).alias("i")).first()  # two numbers
    n_users, n_items = max(1, -(-size["u"] // user_block)), max(1, -(-size["i"] // item_block))
    tasks = max(1, int(ui.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = max(1, min(n_users, -(-tasks // n_items)))
    block = lambda c, k: F.pmod(F.xxhash64(c, F.lit("block")), F.lit(k)).cast("int")
    rows = (ui.select(block(U, n_users).alias("ub"), block(I, n_items).alias("ib"), F.struct(U, I, F.col(N).cast("double").alias(N)).alias("x"))
            .groupBy("ub", "ib").agg(F.collect_list("x").alias("x")))
    every = ui.select(F.col(I).alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("similarity"))
    # every item stands in the similarity, also one without a positive count
    pairs = sim.select("i", "j", "similarity").unionByName(every).groupBy("i", "j").agg(F.max("similarity").alias("similarity"))
    square = (pairs.select(block("i", n_items).alias("ib"), block("j", n_items).alias("cb"), F.struct("i", "j", "similarity").alias("s"))
              .groupBy("ib", "cb").agg(F.collect_list("s").alias("s"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    met = rows.withColumn("salt", F.col("ub") % salts).join(square, ["ib", "salt"]).select("ub", "cb", "x", "s")
    partial = met.mapInArrow(_multiply, _PART)
    if n_items > 1:
        # users without an item similar to a block of candidates: its free items score 0
        users = ui.select(block(U, n_users).alias("ub"), U).distinct().groupBy("ub").agg(F.collect_list(U).alias("users"))
        items = ui.select(block(I, n_items).alias("cb"), I).distinct().groupBy("cb").agg(F.collect_list(I).alias("items"))
        items = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        each = users.withColumn("salt", F.col("ub") % salts).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1))))
        partial = partial.unionByName(each.join(items, ["cb", "salt"]).select("ub", "cb", "users", "items").mapInArrow(_zeros, _PART))
    used = rows.select("ub", F.col("ib").alias("cb"), "x").mapInArrow(_pack_used, _PART)
    return partial.unionByName(used).groupBy("ub", "cb").applyInPandas(_finish(n), _SCORED)


def candidate_scores(ui: DataFrame, sim: DataFrame) -> DataFrame:
    """R2 whole: the score of every item in use for every user who has not used it, zeros included.

    Its result has users x items rows by definition; ``recommend`` does not need it."""
    return blocked_scores(ui, sim)


def popularity(ops: DataFrame, offers: DataFrame, count_col: str = "nb_operations") -> DataFrame:
    """Total operations per offer, its name and sector, ranked (total desc, id).
    ``ops`` may be the operations or the user-item aggregate (``count_col`` = n)."""
    g = ops.groupBy(I).agg(F.sum(count_col).cast("long").alias("total_ops"))
    o = (offers.select(I, "nom_offre", "secteur"))
    g = g.join(o, I, "left")
    # bounded: one row per offer of the catalogue
    return g.withColumn("rang", F.row_number().over(Window.orderBy(F.col("total_ops").desc(), F.col(I))))


def favourite_sector(ops: DataFrame) -> DataFrame:
    """A8 + W3: sector with the most operations per user (ties: sector name)."""
    return _favourite(sector_totals(ops)).drop("_n")


def sector_totals(ops: DataFrame) -> DataFrame:
    """(user, sector, total, _n): operations and rows of every user in every sector."""
    return ops.groupBy(U, "secteur").agg(F.sum("nb_operations").cast("long").alias("total"), F.count(F.lit(1)).alias("_n"))


def _favourite(totals: DataFrame) -> DataFrame:
    w = Window.partitionBy(U).orderBy(F.col("total").desc(), F.col("secteur"))
    return totals.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_sector(rows: DataFrame, count: str | None = None):
    """Most frequent sector over all operations, as a scalar (ties: name); ``count``: rows that stand for so many."""
    g = rows.groupBy("secteur").agg((F.sum(count) if count else F.count(F.lit(1))).alias("_n"))
    return g.agg(F.min_by("secteur", F.struct(-F.col("_n"), F.col("secteur")))).scalar()


def recommend(users: DataFrame, ops: DataFrame, offers: DataFrame, n: int = 3) -> DataFrame:
    """(user, rec_1..rec_n item ids) for every user in ``users``.

    Candidates are all items with at least one operation, minus the user's
    own; order is (score desc, item id asc); fewer than n candidates leave the last
    places empty (the popularity list names the same items); users without history
    get its top n."""
    # feeds the similarity, the scores and the popularity: computed once, kept (spilling to disk if large)
    ui = user_item(ops).persist(StorageLevel.MEMORY_AND_DISK)
    order = Window.partitionBy(U).orderBy(F.col("score").desc(), "cand")
    ranked = (blocked_scores(ui, item_similarity(ui), n)
              .withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= n))
    warm = ranked.groupBy(U).agg(
        *[F.max(F.when(F.col("slot") == k + 1, F.col("cand"))).alias(f"_w{k + 1}") for k in range(n)])
    seen = ui.select(U).distinct().withColumn("_seen", F.lit(True))
    # the first n of the popularity list: one row of n ids
    totals = ui.groupBy(I).agg(F.sum(N).alias("total_ops"))
    pop = totals.orderBy(F.col("total_ops").desc(), F.col(I)).limit(n)
    cold = pop.agg(F.array_sort(F.collect_list(F.struct((-F.col("total_ops")).alias("t"), F.col(I).alias("id"))))).scalar()
    out = users.select(U).join(seen, U, "left").join(warm, U, "left")
    return out.select(U, *[F.when(F.col("_seen").isNull(), F.try_element_at(cold, F.lit(k + 1))["id"])
                           .otherwise(F.col(f"_w{k + 1}")).alias(f"rec_{k + 1}") for k in range(n)])


def label(recs: DataFrame, offers: DataFrame, n: int = 3) -> DataFrame:
    """Display names of the recommended offers by one join; only active offers have a
    name, others get the slot's default label, missing slots another one."""
    names = offers.filter(F.col("actif")).select(F.col(I).alias("_id"), offer_label(F.col("nom_offre"), F.col("nom_partenaire")).alias("_name"))
    slots = recs.select(U, F.posexplode(F.array(*[F.col(f"rec_{k + 1}") for k in range(n)])).alias("_k", "_id"))
    named = slots.join(names, "_id", "left")
    cols = [F.max(F.when(F.col("_k") == k, F.when(F.col("_id").isNull(), F.lit(MISSING_LABELS[k]))
                         .otherwise(F.coalesce("_name", F.lit(DEFAULT_LABELS[k]))))).alias(f"recommandation_offre_{k + 1}")
            for k in range(n)]
    return named.groupBy(U).agg(*cols)


def recommend_sector(users: DataFrame, ops: DataFrame) -> DataFrame:
    """Own favourite sector, else the globally most frequent one. Both come from one row per user and sector, kept
    (spilling to disk), so that the operations are read and joined once."""
    totals = sector_totals(ops).persist(StorageLevel.MEMORY_AND_DISK)
    fav = _favourite(totals).select(U, "secteur")
    return users.select(U).join(fav, U, "left").select(
        U, F.coalesce(F.col("secteur"), top_sector(totals, "_n")).alias("secteur_recommande"))
