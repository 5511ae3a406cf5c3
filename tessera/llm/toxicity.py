"""Toxicity by non-negative positive-unlabelled learning.

Training knows confirmed toxic documents (P) and a sample of all training documents whatever their label
(U, so that toxic ones are in it at the class prior pi). A linear classifier over the presence of words
and character 3- to 5-grams of words minimises ``pi * R_P(+) + max(0, R_U(-) - pi * R_P(-))`` with the logistic
loss: the second term is the risk of the clean class with the toxic part of U taken out, and it is kept from going
negative (a step that would overfit it is reversed). ``BAGS`` classifiers on disjoint parts of U are trained in
numpy; the score is the logistic function of their mean.

The prior is a parameter; by default it is the toxic share among the labelled training documents.

Distribution: features are counted per task and summed by a grouped aggregate over the bounded training sample;
the selected ones (at most ``MAX_FEATURES``) and the sample's sparse rows are all that reaches the driver. Scoring
is one pass over whole texts without a shuffle; a word's features are cached per worker, up to ``CACHE_WORDS``.

Bounds (documented parameters): ``max_positive`` and ``max_unlabelled`` documents are used for fitting, chosen by a
hash of the id. Everything is scored.

Edge cases: null and empty texts get the model's bias; without any confirmed toxic training document every score
is the prior (or 0); null labels are no labels; repeated rows are scored alike; empty tables give no rows. Only
``text`` enters a score; ``doc_id`` only picks training rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import parts

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 12_000
MAX_FEATURES = 30_000
BAGS = 3
MIN_DOCS = 3            # a feature occurs in so many toxic training documents,
MIN_RATIO = 2.5         # so many times as often in P as in U,
MIN_SIGMA = 3.0         # and so many standard deviations more often than U's rate explains
CACHE_WORDS = 150_000
SLICE_CHARS = 1_000_000
COUNTED = 250_000       # feature counts a task holds before it hands them on
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and the character 3- to 5-grams of its marked form."""
    w = f"<{word}>"
    n = len(w)
    return [w, *[w[i:i + 3] for i in range(n - 2) if n > 3], *[w[i:i + 4] for i in range(n - 3) if n > 4],
            *[w[i:i + 5] for i in range(n - 4) if n > 5]]


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0

    def scorer(self):
        """A function text -> score; caches the features of words it has met."""
        index = {f: i for i, f in enumerate(self.weights)}
        value = np.array(list(self.weights.values()) or [0.0])

        class Cache(dict):
            def __missing__(self, word):
                if len(self) > CACHE_WORDS:
                    self.clear()
                hit = self[word] = tuple({index[f] for f in features(word) if f in index})
                return hit

        cache = Cache()

        def score(text):
            found = set()
            for w in words(text) if text else ():
                hit = cache[w]
                if hit:
                    found.update(hit)
            z = self.bias + (float(value[sorted(found)].sum()) if found else 0.0)
            return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))
        return score


def train_nnpu(p_rows: list, u_rows: list, n_features: int, prior: float, steps: int = 400, rate: float = 0.1,
               decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the non-negative risk; rows are arrays of feature numbers."""

    def flat(rows):
        n = np.array([len(r) for r in rows])
        return np.repeat(np.arange(len(rows)), n), np.concatenate([np.asarray(r, np.int64) for r in rows] or [[]]).astype(np.int64), len(rows)

    p, u = flat(p_rows), flat(u_rows)
    w = np.zeros(n_features + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def logits(x):
        return np.bincount(x[0], w[x[1]], x[2]) + w[-1]

    def grad(x, g):                                       # of the mean over rows of a loss with row gradient g
        return np.append(np.bincount(x[1], g[x[0]], n_features), g.sum()) / max(1, x[2])

    for t in range(1, steps + 1):
        zp, zu = logits(p), logits(u)
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_clean = grad(u, sigmoid(zu)) - prior * grad(p, sigmoid(zp))
        g = prior * grad(p, sigmoid(zp) - 1) + g_clean if clean >= 0 else -g_clean
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    # the mean probability over U is the prior by definition: the bias takes up what is left
    z, low, high = logits(u) - w[-1], -40.0, 40.0
    for _ in range(60):
        bias = (low + high) / 2
        low, high = (bias, high) if sigmoid(z + bias).mean() < prior else (low, bias)
    return w[:-1], float(bias)


def fit(docs: DataFrame, labels: DataFrame, exclude, prior: float | None = None, max_positive: int = MAX_POSITIVE,
        max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). ``exclude`` is a condition on doc_id:
    neither texts nor labels of such documents are used."""
    known = labels.where(F.col("toxic").isNotNull() & ~exclude).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")).first()
    n_docs = docs.where(~exclude).count()
    if not n["p"] or not n_docs:
        return Model(bias=math.log(prior / (1 - prior)) if prior else -30.0)
    if prior is None:
        prior = min(0.9, max(0.001, n["p"] / n["n"])) if n["n"] > n["p"] else 0.1
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # about max_positive ids, so they are sent to the documents and no text is shuffled
    chosen = F.broadcast(known.where((F.col("toxic") == 1) & (pick < max_positive / n["p"])).select("doc_id", F.lit(True).alias("p")))
    both = docs.where(~exclude & F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id", "left")
    unlabelled = F.pmod(F.xxhash64("doc_id", F.lit("u")), F.lit(1 << 30)) / float(1 << 30) < max_unlabelled / n_docs
    sample = both.withColumn("p", F.coalesce("p", F.lit(False))).withColumn("u", unlabelled).where("p or u") \
        .select("doc_id", "text", F.col("p").cast("int").alias("p"), F.col("u").cast("int").alias("u"))

    def count(batches):
        import pyarrow as pa
        in_p, in_u = Counter(), Counter()
        for batch in parts(batches, 1, SLICE_CHARS):
            for _, text, p, u in zip(*(c.to_pylist() for c in batch.columns)):
                found = set().union(*map(features, words(text)))
                if p:
                    in_p.update(found)
                if u:
                    in_u.update(found)
            if len(in_u) + len(in_p) > COUNTED:            # hand on what is counted so far
                yield pa.RecordBatch.from_arrays(_columns(in_p, in_u), ["f", "p", "u"])
                in_p, in_u = Counter(), Counter()
        yield pa.RecordBatch.from_arrays(_columns(in_p, in_u), ["f", "p", "u"])

    def _columns(in_p, in_u):
        import pyarrow as pa
        keys = list(in_p.keys() | in_u.keys())
        return [pa.array(keys, pa.string()), pa.array([in_p[k] for k in keys], pa.int64()),
                pa.array([in_u[k] for k in keys], pa.int64())]

    seen = sample.agg(F.sum("p").alias("p"), F.sum("u").alias("u")).first()
    np_, nu = max(1, seen["p"] or 0), max(1, seen["u"] or 0)
    counted = sample.mapInArrow(count, "f string, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    ratio = (F.col("p") / np_) / ((F.col("u") + 1) / nu)
    expected = F.col("u") * (np_ / nu)
    sigma = (F.col("p") - expected) / F.sqrt(expected + 1)
    chosen = [r["f"] for r in counted.where((F.col("p") >= MIN_DOCS) & (ratio >= MIN_RATIO) & (sigma >= MIN_SIGMA))
              .orderBy(F.col("p").desc(), "f").limit(MAX_FEATURES).collect()]
    index = {f: i for i, f in enumerate(chosen)}
    known_features = index.keys()
    if not index:
        return Model(bias=math.log(prior / (1 - prior)))

    def sparse(batches):
        import pyarrow as pa
        for batch in parts(batches, 1, SLICE_CHARS):
            ids, text, p, u = (c.to_pylist() for c in batch.columns)
            rows = [sorted(index[f] for f in set().union(*map(features, words(t))) & known_features) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.int32()))],
                                             ["doc_id", "p", "u", "x"])

    rows = sample.mapInArrow(sparse, "doc_id long, p int, u int, x array<int>") \
        .select("p", "u", "x", F.xxhash64("doc_id", F.lit("bag")).alias("h")).collect()
    rows.sort(key=lambda r: (r["h"], r["x"]))
    p_rows = [r["x"] for r in rows if r["p"]]
    total, bias = np.zeros(len(index)), 0.0
    for bag in range(BAGS):
        u_rows = [r["x"] for i, r in enumerate(r for r in rows if r["u"]) if i % BAGS == bag]
        w, b = train_nnpu(p_rows, u_rows or p_rows, len(index), prior)
        total, bias = total + w / BAGS, bias + b / BAGS
    return Model(dict(zip(chosen, total.tolist())), bias)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into`` (replaced if there): the score of every whole text, 0 to 1."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # at most MAX_FEATURES weights
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        one = shared.value.scorer()
        for batch in parts(batches, at, SLICE_CHARS):
            scores = pa.array([one(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)
