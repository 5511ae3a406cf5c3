"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence; none: empty, linked with
nothing). Two documents are linked when 100 * intersection >= 75 * union, confirmed on the full sets; groups are the
connected components of the links. Candidates come from signatures of ``COORDINATES`` minima: documents are posted
under every (coordinate, minimum) pair and a pair of documents counts one collision per shared posting list. A
pair needs ``MATCHES`` collisions to be confirmed (at similarity 0.75 the chance to have fewer is about 4e-6).

* Equal sets are one class, represented by the smallest id; only representatives go on.
* Prefix: ordered from the rarest list to the most frequent, a pair with ``MATCHES`` collisions must share a list
  among the first ``COORDINATES - MATCHES + 1`` of both. Lists of one document count towards that prefix but are
  never shipped, so a document without near copies drops out, and very frequent shingles hardly ever count.
* Merging by skips: round one joins every list's members to the list's smallest id only, one pair per posting
  at most. Confirmed links give components. Round two skips every list whose members are one component and
  compares the others' members across components only: short lists as pairs, long ones in blocks that
  meet in a task, hold sets and signatures, and give back a spanning forest of the links found, never all pairs. In
  a long list the members of its largest component meet the other members only, not each other.

So no link between different texts is lost to the merging, and no group is collected: a posting list with a
third of all documents is a star of as many pairs, and rows beyond that only for what the star left apart.

Edge cases: null ids take no part (component null, kept); null, empty and wordless texts are linked with
nothing, so they are components of their own; rows that repeat an id are one node: the classes of all its texts are linked, and
its wordless rows follow them; ties go to the smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, parts

WORDS = 5
COORDINATES = 64
MATCHES = 32
SHORT_LIST = 32
BLOCK = 256
SALTS = 32              # a long list meets its block counts in so many tasks
SLICE_CHARS = 3_000_000
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2 ** 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2 ** 63, COORDINATES, dtype=np.uint64)
_SHINGLE_MUL = _RNG.integers(1, 2 ** 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts):
    """Yield the sorted distinct shingle hashes (u64) of every text of an Arrow array (null: empty)."""
    import pandas as pd
    import pyarrow.compute as pc
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    real = np.array([w != "" for w in words], dtype=bool)
    codes, at = coded.indices.to_numpy(), 0
    for n in pc.list_value_length(lists).to_pylist():
        c = codes[at:at + n]
        at += n
        h = hashes[c[real[c]]]
        k = min(WORDS, len(h))
        if not k:
            yield np.zeros(0, np.uint64)
            continue
        s = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            s = _mix(s + h[i:len(h) - k + 1 + i] * _SHINGLE_MUL[i])
        yield np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every coordinate's 32-bit hash."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(shingles), 4096):
        h = shingles[at:at + 4096][None, :] * _MUL[:, None] + _ADD[:, None]
        out = np.minimum(out, (h >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, sig (array<int>) of all documents, written to the shared folder."""

    def sign(batches):
        import pyarrow as pa
        for batch in parts(batches, 1, SLICE_CHARS):
            n, key, sig = [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).hexdigest() if len(s) else None)
                sig.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(sig, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "set_hash", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return cut(rows.mapInArrow(sign, "doc_id long, n_shingles long, set_hash string, sig array<int>"), "minhash-signed")


def _prefix(reps: DataFrame) -> DataFrame:
    """(token, node): the shipped part of every representative's prefix."""
    post = reps.select("node", F.posexplode("sig").alias("c", "v")).select(
        "node", (F.shiftleft(F.col("c").cast("long"), 32) + F.pmod(F.col("v").cast("long"), F.lit(2 ** 32))).alias("token"))
    shared = post.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    mine = post.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    # lists of one document come first in the order and take their places in the prefix
    room = F.lit(COORDINATES - MATCHES + 1) - (F.lit(COORDINATES) - F.size("t"))
    return mine.where(room > 0).select("node", F.explode(F.slice("t", F.lit(1), room)).alias("x")) \
               .select("node", F.col("x.token").alias("token"))


def _confirm(pairs: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a, b) that collide often enough and whose full sets (node, shingles) are similar."""
    sig_a = reps.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    sig_b = reps.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    hits = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    near = cut(pairs.join(sig_b, "b").join(sig_a, "a").where(hits >= MATCHES).select("a", "b").distinct(), "minhash-near")
    set_a = full.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))
    set_b = full.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return (near.join(set_b, "b").join(set_a, "a").withColumn("i", both)
            .where(100 * F.col("i") >= 75 * (F.size("xa") + F.size("xb") - F.col("i"))).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link (a, b).

    Rounds of "take the smallest label around" and pointer jumping; each round is written to the shared folder."""
    links = cut(links.distinct(), "minhash-links")
    edges = links.union(links.select("b", "a"))
    state = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "minhash-labels")
    while True:
        around = edges.join(state, edges["b"] == state["node"]).select(F.col("a").alias("node"), "component")
        low = around.union(state).groupBy("node").agg(F.min("component").alias("low"))
        jump = state.select(F.col("node").alias("low"), F.col("component").alias("far"))
        after = cut(low.join(jump, "low").join(state, "node")
                    .select("node", F.least("low", "far").alias("component"),
                            (F.least("low", "far") < F.col("component")).alias("moved")), "minhash-labels")
        state = after.drop("moved")
        if after.where("moved").isEmpty():
            return state


def _forest(match: np.ndarray, comp: np.ndarray):
    """Index pairs of a spanning forest of ``match`` over nodes already joined by ``comp``."""
    parent = {c: c for c in comp.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(match)):
        x, y = root(comp[i]), root(comp[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            yield int(i), int(j)


def block_links(node, comp, side, sigs, sets):
    """Links across components between the rows of side 0 and those of side 1 (all pairs where side 1 is empty)."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    sig = np.stack(sigs)
    hits = np.zeros((len(left), len(right)), dtype=np.int16)
    for k in range(sig.shape[1]):
        hits += sig[left, k][:, None] == sig[right, k][None, :]
    may = (hits >= MATCHES) & (comp[left][:, None] != comp[right][None, :])
    if right is left:
        may = np.triu(may, 1)
    if not may.any():
        return []
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    used = sorted({*left[rows].tolist(), *right[cols].tolist()})
    place = {r: i for i, r in enumerate(used)}
    values, code = np.unique(np.concatenate([sets[r] for r in used]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[r]) for r in used])
    size = np.bincount(owner, minlength=len(used))
    x, y = [place[r] for r in left[rows].tolist()], [place[r] for r in right[cols].tolist()]
    both = np.zeros((len(x), len(y)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, len(values), 8192):                  # incidence matrix in strips of shingles
        lo, hi = np.searchsorted(code, [a, a + 8192])
        m = np.zeros((len(used), min(8192, len(values) - a)), dtype=np.float32)
        m[owner[lo:hi], code[lo:hi] - a] = 1
        both += m[x] @ m[y].T
    union = size[x][:, None] + size[y][None, :] - both
    match = may[np.ix_(rows, cols)] & (100 * both >= 75 * union)
    whole = np.zeros((len(node), len(node)), dtype=bool)
    whole[np.ix_(left[rows], right[cols])] = match
    return [(int(node[i]), int(node[j])) for i, j in _forest(whole, comp)]


def _long_lists(members: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    """Links across components within long lists. ``members``: token, node, component, n (members of the list)."""
    per = members.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    top = per.groupBy("token").agg(F.max(F.struct("k", "component")).alias("t"), F.sum("k").alias("n")) \
        .select("token", F.col("t.component").alias("major"), F.col("t.k").alias("k"), "n")
    blocks = lambda n: F.ceil(n / F.lit(float(BLOCK))).cast("int")
    # the one row of a list is repeated for every salt, its members are dealt over the salts
    top = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = members.select("token", "node", "component", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt"))
    m = salted.join(top, ["token", "salt"]) \
        .withColumn("nm", blocks(F.col("n") - F.col("k"))).withColumn("nj", blocks(F.col("k"))) \
        .withColumn("is_major", F.col("component") == F.col("major")) \
        .withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("nj")).otherwise(F.col("nm"))).cast("int"))
    # a minor block meets every minor block (once) and every major block; major blocks never meet each other
    ids = lambda n: F.sequence(F.lit(0), n - 1)
    minor = F.concat(
        F.transform(ids(F.col("nm")), lambda k: F.struct(F.least(k, F.col("i")).alias("p"), F.greatest(k, F.col("i")).alias("q"),
                                                         F.lit(False).alias("mixed"), (k < F.col("i")).cast("int").alias("side"))),
        F.transform(ids(F.col("nj")), lambda k: F.struct(F.col("i").alias("p"), k.alias("q"), F.lit(True).alias("mixed"),
                                                         F.lit(0).alias("side"))))
    major = F.transform(ids(F.col("nm")), lambda k: F.struct(k.alias("p"), F.col("i").alias("q"), F.lit(True).alias("mixed"),
                                                             F.lit(1).alias("side")))
    placed = m.select("token", "node", "component", F.explode(F.when(F.col("is_major"), major).otherwise(minor)).alias("x"))
    rows = full.join(members.select("node").distinct(), "node", "left_semi").join(reps.select("node", "sig"), "node")

    def link(key, pdf):
        import pandas as pd
        found = block_links(pdf["node"].to_numpy(), pdf["component"].to_numpy(), pdf["side"].to_numpy(),
                            pdf["sig"].tolist(), pdf["shingles"].tolist())
        return pd.DataFrame(found, columns=["a", "b"])

    return (placed.select("token", "node", "component", "x.*").join(rows, "node")
            .groupBy("token", "p", "q", "mixed").applyInPandas(link, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    signed = _signed(docs)
    classes = cut(signed.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
                  .groupBy("set_hash").agg(F.min("doc_id").alias("node")), "minhash-classes")
    reps = cut(signed.join(classes, "set_hash").where(F.col("doc_id") == F.col("node"))
               .select("node", "set_hash", "sig").dropDuplicates(["node", "set_hash"]).select("node", "sig"), "minhash-reps")

    def shingle(batches):
        import pyarrow as pa
        for batch in parts(batches, 1, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(batch.column(1))],
                                                                        pa.list_(pa.int64()))], ["node", "shingles"])

    posted = cut(_prefix(reps), "minhash-prefix")
    hub = posted.groupBy("token").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    star = posted.join(hub, "token").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    # full sets, from the texts, of what shares a list: one shuffle of the texts at any size, kept for both rounds
    nodes = posted.join(hub.select("token"), "token").select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi")
    full = cut(texts.mapInArrow(shingle, "node long, shingles array<long>").where(F.size("shingles") > 0), "minhash-sets")
    first = cut(_confirm(star, reps, full), "minhash-star")
    joined = components(first)
    # lists that still hold several components
    label = posted.join(joined, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
    apart = (label.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where(F.col("lo") < F.col("hi")).select("token", "n"))
    rest = cut(label.join(apart, "token"), "minhash-rest")
    short = rest.where(F.col("n") <= SHORT_LIST)
    other = short.select("token", F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = (short.select("token", F.col("node").alias("a"), F.col("component").alias("ca")).join(other, "token")
             .where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct())
    second = _confirm(pairs.join(star, ["a", "b"], "left_anti"), reps, full)
    long = rest.where(F.col("n") > SHORT_LIST)
    if not long.isEmpty():
        second = second.union(_long_lists(long, reps, full))
    # an id with several texts links their classes
    texts_of = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id") \
        .agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi"), F.count(F.lit(1)).alias("n"), F.count("set_hash").alias("worded"))
    several = texts_of.where((F.col("lo") < F.col("hi")) | (F.col("worded") < F.col("n")) & (F.col("worded") > 0)).select("doc_id")
    several = cut(signed.select("doc_id", "set_hash").join(several.hint("merge"), "doc_id", "left_semi"), "minhash-several")
    same_id = several.join(classes, "set_hash").where(F.col("node") != F.col("doc_id")).select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    final = components(first.union(second).union(same_id))
    found = classes.join(final, "node", "left").select("set_hash", F.coalesce("component", "node").alias("component_id"))
    wordless = several.where(F.col("set_hash").isNotNull()).join(found, "set_hash").groupBy("doc_id").agg(F.min("component_id").alias("by_id"))
    return (signed.drop("sig").join(found, "set_hash", "left").join(wordless, "doc_id", "left")
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "by_id", "doc_id"))).drop("by_id")
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")))
