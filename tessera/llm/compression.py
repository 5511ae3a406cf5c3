"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is compressed in blocks of
``BLOCK`` bytes under either dictionary; ``(size under bad - size under good) / bytes`` is positive where the text looks like the
good one. A logistic calibration, fitted on labelled texts that built no dictionary and weighted back to the
classes' true shares, turns it into the probability that the label is 1.

Distribution: the labelled sample is bounded by two documented parameters: about ``max_rows`` documents a class, chosen by a
hash of the id, of which one half builds the dictionaries and the other calibrates; and ``sample_bytes`` of a class for its
dictionary, dealt evenly over the documents of that half as blocks of ``BLOCK`` bytes, which the executors choose
out of whole texts by a hash (a document gives one block at least). These blocks, and one number for every calibrating document,
whose whole text is compressed on the executors, are all that reaches the driver. The model (two dictionaries of
``DICTIONARY`` bytes, two numbers) is broadcast. Scoring is one pass over whole texts without a shuffle.

Edge cases: null and empty texts have difference 0; with only one class in the labels every score is that
class's (0 or 1), without labels 0.5; texts too few to train a dictionary serve as its raw content; null labels are no
labels; repeated rows score alike; empty tables give no rows. Only ``text`` enters a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import parts

MAX_ROWS = 4_000
SAMPLE_BYTES = 8_000_000
BLOCK = 1024
DICTIONARY = 112_640
LEVEL = 3
SLICE_CHARS = 1_000_000


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    raw: tuple[bool, bool] = (False, False)
    slope: float = 0.0
    offset: float = 0.0

    def difference(self):
        """A function text -> normalised compressed-size difference."""
        import zstandard
        coders = []
        for data, raw in zip((self.good, self.bad), self.raw):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        good, bad = coders

        def difference(text):
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            if not raw:
                return 0.0
            total = 0
            for i in range(0, len(raw), BLOCK):
                part = raw[i:i + BLOCK]
                total += len(bad(part)) - len(good(part))
            return total / len(raw)
        return difference

    def scorer(self):
        if not self.good:
            return lambda text: 1 / (1 + math.exp(-self.offset))
        difference = self.difference()

        def score(text):
            z = self.slope * difference(text) + self.offset
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
        return score


def dictionary(blocks: list[bytes]) -> tuple[bytes, bool]:
    """(dictionary, is raw content) of a bounded list of blocks."""
    import zstandard
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes(), False
    except zstandard.ZstdError:
        return (b"".join(blocks)[:DICTIONARY] or b" " * 8).ljust(8), True


def _blocks(texts: DataFrame, quota: int) -> list[tuple[int, bytes]]:
    """(quality, block) of at most ``quota`` blocks of every text (text, quality, h), in an order of their own."""

    def choose(batches):
        import pyarrow as pa
        for batch in parts(batches, 0, SLICE_CHARS):
            quality, block, order = [], [], []
            for text, q, h in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass")
                n = -(-len(raw) // BLOCK)
                for i in sorted(np.random.default_rng(h & 0xFFFFFFFF).permutation(n)[:quota].tolist()):
                    quality.append(q)
                    block.append(raw[i * BLOCK:(i + 1) * BLOCK])
                    order.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(quality, pa.int32()), pa.array(block, pa.binary())],
                                             ["h", "q", "block"])

    rows = texts.select("text", F.col("quality").cast("int"), "h").mapInArrow(choose, "h long, q int, block binary").collect()
    return [(r["q"], bytes(r["block"])) for r in sorted(rows, key=lambda r: (r["h"], r["q"], bytes(r["block"])))]


def _differences(texts: DataFrame, model: Model) -> list[tuple[int, float]]:
    """(quality, difference) of every whole text (text, quality, h)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def compare(batches):
        import pyarrow as pa
        difference = shared.value.difference()
        for batch in parts(batches, 0, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([difference(t) for t in batch.column(0).to_pylist()], pa.float64())], ["q", "x"])

    found = texts.select("text", F.col("quality").cast("int")).mapInArrow(compare, "q int, x double").collect()
    shared.unpersist()
    return sorted((r["q"], r["x"]) for r in found)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit (Newton, slightly ridged so that separable classes converge)."""
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    weight = weight / weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        g = a.T @ (weight * (p - y)) + 1e-4 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, exclude, max_rows: int = MAX_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); ``exclude`` is a condition on doc_id."""
    known = labels.where(F.col("quality").isNotNull() & ~exclude).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model(offset=0.0 if not n else 30.0 if n.get(1) else -30.0)
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("quality") == 1, max_rows / n[1]).otherwise(max_rows / n[0])
    # about 2 * max_rows ids are sent to the documents; texts stay on the executors
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known.where(pick < share)), "doc_id") \
        .select("text", "quality", F.xxhash64("doc_id", F.lit("half")).alias("h"))
    first = F.pmod("h", F.lit(2)) == 0
    quota = max(1, int(sample_bytes // (BLOCK * max(1, max_rows // 2))))
    blocks, rest = _blocks(texts.where(first), quota), texts.where(~first)
    if {q for q, _ in blocks} != {0, 1}:
        blocks, rest = _blocks(texts, quota), texts
    build = [[b for q, b in blocks if q == k] for k in (1, 0)]
    if not all(build):
        return Model(offset=math.log(n[1] / n[0]))
    (good, raw_good), (bad, raw_bad) = map(dictionary, build)
    model = Model(good, bad, (raw_good, raw_bad))
    found = _differences(rest, model)
    if {q for q, _ in found} != {0, 1}:
        found = _differences(texts, model)
    y, x = (np.array([r[i] for r in found], dtype=float) for i in (0, 1))
    weight = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
    model.slope, model.offset = calibrate(x, y, weight)
    return model


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into`` (replaced if there): the score of every whole text, 0 to 1."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # two dictionaries of DICTIONARY bytes
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        one = shared.value.scorer()
        for batch in parts(batches, at, SLICE_CHARS):
            scores = pa.array([one(t) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, into])

    return docs.mapInArrow(run, schema)
