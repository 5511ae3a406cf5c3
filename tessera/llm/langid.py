"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into segments of ``SEGMENT`` bytes, and two gated recurrent layers read each segment, one from either end.
Their states label every position with a distribution over the learned languages; a document's probabilities are the
mean over its positions, in whole texts of any length. The network is written in numpy and trained by
backpropagation through time with Adam; its gates use the piecewise linear sigmoid.

Training takes a bounded, documented sample of the labelled documents: about ``max_docs`` of each language, chosen
by a hash of the id, and of each of them at most ``max_segments`` segments out of the whole text, chosen by a hash too. The sample
is all that reaches the driver: its bytes are bounded by languages x max_docs x max_segments x SEGMENT, whatever the texts' lengths
are; segments are cut on the executors. The number of languages is the only other factor.

Distribution: one aggregate counts documents by language, one pass gathers the sample, one pass without a shuffle scores
whole texts. A worker reads ``BATCH`` segments at a time, so a long text is spread over several batches and its sum carried on.

Edge cases: null texts and texts without a letter get ``und`` and score 0; without any labelled training document
everything is ``und``; one learned language gets score 1; ties go to the language that sorts first; labels that are
null teach nothing; rows that repeat an id are scored alike if their texts are; other columns are kept, those named like a result replaced;
empty tables give no rows. Only ``text`` enters a prediction; ``doc_id`` and ``lang`` only pick and label training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import parts

SEGMENT = 96
BATCH = 1536            # segments read together
HIDDEN = 12             # states of each direction
MAX_DOCS = 600          # training documents of a language, about
MAX_SEGMENTS = 6        # segments of one of them
EPOCHS = 12
TRAIN_BATCH = 192
PAD = 256               # the symbol after a segment's last byte
UNKNOWN = "und"
LETTER = r"\p{L}"
SLICE_CHARS = 1_000_000


def segments(data: bytes) -> np.ndarray:
    """The bytes as rows of ``SEGMENT`` symbols, the last one filled up with ``PAD``."""
    n = -(-len(data) // SEGMENT)
    out = np.full(n * SEGMENT, PAD, dtype=np.int16)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, SEGMENT)


@dataclass
class Layer:
    """One direction: a column of ``table`` for every symbol (update, reset, candidate), recurrent weights ``u``."""

    table: np.ndarray       # 3 H x 257
    u: np.ndarray           # 3 H x H

    def read(self, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) after each of the symbols ``steps`` (T, B). ``keep`` receives what ``back`` needs."""
        size = self.u.shape[1]
        state = np.zeros((size, steps.shape[1]), np.float32)
        out = np.empty((len(steps), *state.shape), np.float32)
        for t, symbols in enumerate(steps):
            given, own = self.table.take(symbols, axis=1), self.u @ state
            gates = given[:2 * size]
            gates += own[:2 * size]
            np.minimum(gates, 1, out=gates)
            np.maximum(gates, 0, out=gates)
            new = gates[size:] * own[2 * size:]
            new += given[2 * size:]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((state.copy(), gates, own[2 * size:], new))
            state = new + gates[:size] * (state - new) if keep is not None else _step(state, new, gates[:size])
            out[t] = state
        return out

    def back(self, steps: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of table and u, given those of the states: backpropagation through time."""
        size = self.u.shape[1]
        du, carry = np.zeros_like(self.u), np.zeros_like(grad[0])
        table = np.zeros((257, 3 * size), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            state, gates, own, new = keep[t]
            z, r = gates[:size], gates[size:]
            d = grad[t] + carry
            d_new = d * (1 - z) * (1 - new * new)
            inside = ((gates > 0) & (gates < 1)).astype(np.float32)
            d_gates = np.concatenate([d * (state - new), d_new * own]) * inside
            pre = np.concatenate([d_gates, d_new * r])          # of u @ state
            du += pre @ state.T
            carry = d * z + self.u.T @ pre
            given = np.concatenate([d_gates, d_new])            # of the symbols' columns
            np.add.at(table, steps[t], given.T)
        return table.T, du


def _step(state, new, z):
    state -= new
    state *= z
    state += new
    return state


@dataclass
class Network:
    """Both directions and the labels' weights: (2 H + 1) x languages."""

    languages: list[str]
    forward: Layer
    backward: Layer
    label: np.ndarray

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 42) -> "Network":
        rng = np.random.default_rng(seed)

        def layer():
            table = rng.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
            table[:2 * hidden] += 0.5                            # gates start half open
            return Layer(table, rng.normal(0, 0.3 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32))
        return Network(languages, layer(), layer(), rng.normal(0, 0.1, (2 * hidden + 1, len(languages))).astype(np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.u, self.backward.table, self.backward.u, self.label]

    def _labels(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Distribution (T, languages, B) at every position."""
        size = one.shape[1]
        z = np.matmul(self.label[:size].T, one)
        z += np.matmul(self.label[size:2 * size].T, two)
        z += self.label[-1][:, None]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """Distribution (B, T, languages) at every position of the segments ``rows`` (B, T)."""
        steps = np.ascontiguousarray(rows.T)
        p = self._labels(self.forward.read(steps), self.backward.read(steps[::-1])[::-1])
        return p.transpose(2, 0, 1)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """(B, languages): the positions' distributions added up over each segment, without those after its end."""
        steps = np.ascontiguousarray(rows.T)
        p = self._labels(self.forward.read(steps), self.backward.read(steps[::-1])[::-1])
        if steps[-1].max(initial=0) == PAD:
            p *= (steps != PAD)[:, None, :]
        return p.sum(axis=0, dtype=np.float64).T

    def loss_and_gradients(self, rows: np.ndarray, target: np.ndarray):
        """Mean cross entropy of all positions against the segment's language, and the weights' gradients."""
        steps = np.ascontiguousarray(rows.T)
        kept_f, kept_b = [], []
        one = self.forward.read(steps, kept_f)
        two = self.backward.read(steps[::-1], kept_b)[::-1]
        p = self._labels(one, two)
        real = (steps != PAD).astype(np.float32)
        real /= real.sum()
        right = p[:, target, np.arange(len(target))]
        loss = float(-(np.log(np.maximum(right, 1e-9)) * real).sum())
        d = p.copy()
        d[:, target, np.arange(len(target))] -= 1
        d *= real[:, None, :]
        size = one.shape[1]
        label = np.concatenate([np.einsum("thb,tkb->hk", one, d, optimize=True), np.einsum("thb,tkb->hk", two, d, optimize=True),
                                d.sum(axis=(0, 2))[None]])
        d_one, d_two = np.matmul(self.label[:size], d), np.matmul(self.label[size:2 * size], d)
        ft, fu = self.forward.back(steps, kept_f, d_one)
        bt, bu = self.backward.back(steps[::-1], kept_b, d_two[::-1])
        return loss, [ft, fu, bt, bu, label.astype(np.float32)]

    def train(self, rows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, seed: int = 42) -> "Network":
        """Adam with clipped gradients and a falling rate; languages weigh alike by drawing each as often."""
        rng = np.random.default_rng(seed)
        weights = self.weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        of = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        of = [x for x in of if len(x)]
        steps = max(40, epochs * len(rows) // TRAIN_BATCH)
        for t in range(1, steps + 1):
            lang = rng.integers(0, len(of), TRAIN_BATCH)
            pick = np.array([of[k][rng.integers(len(of[k]))] for k in lang])
            _, grads = self.loss_and_gradients(rows[pick], target[pick])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            scale, now = min(1.0, 1.0 / (norm + 1e-9)), rate * (1 - t / (steps + 1))
            for w, g, m, v in zip(weights, grads, first, second):
                g = g * scale
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= now * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return self


def sample(docs: DataFrame, exclude, max_docs: int = MAX_DOCS, max_segments: int = MAX_SEGMENTS):
    """(languages, segments, language numbers) of the training sample; see the module's docstring for its bound."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~exclude & F.regexp_like("text", F.lit(LETTER)))
    known = known.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, SEGMENT), np.int16), np.zeros(0, np.int64)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, max_docs / counts[k])])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    number = {k: i for i, k in enumerate(languages)}

    def cut_up(batches):
        import pyarrow as pa
        for batch in parts(batches, 1, SLICE_CHARS):
            lang, data, order = [], [], []
            for text, k, h in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                rows = segments(text.encode("utf-8", "replace"))
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                for i in sorted(rng.permutation(len(rows))[:max_segments].tolist()):
                    lang.append(number[k])
                    data.append(rows[i].tobytes())
                    order.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(lang, pa.int32()), pa.array(data, pa.binary())],
                                             ["h", "k", "data"])

    picked = known.where(draw < share).select("doc_id", "text", "lang", F.xxhash64("doc_id", F.lit("segment")).alias("h"))
    got = picked.mapInArrow(cut_up, "h long, k int, data binary").collect()
    got.sort(key=lambda r: (r["h"], r["k"], bytes(r["data"])))
    rows = np.frombuffer(b"".join(bytes(r["data"]) for r in got), np.int16).reshape(-1, SEGMENT)
    return languages, rows, np.array([r["k"] for r in got], dtype=np.int64)


def fit(docs: DataFrame, exclude, max_docs: int = MAX_DOCS, max_segments: int = MAX_SEGMENTS, epochs: int = EPOCHS,
        hidden: int = HIDDEN, seed: int = 42) -> Network:
    """A network from ``docs`` (doc_id, text, lang); documents for which the condition ``exclude`` holds are not used."""
    languages, rows, target = sample(docs, exclude, max_docs, max_segments)
    net = Network.fresh(languages, hidden, seed)
    return net.train(rows, target, epochs, seed=seed) if len(rows) and len(languages) > 1 else net


def document_sums(net: Network, texts):
    """Summed distributions (documents x languages) and byte counts of ``texts``, ``BATCH`` segments at a time."""
    total, sizes = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    held, owner, count = [], [], 0

    def flush():
        rows, own = np.concatenate(held), np.concatenate(owner)
        for at in range(0, len(rows), BATCH):
            np.add.at(total, own[at:at + BATCH], net.sums(rows[at:at + BATCH]))

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        sizes[i] = len(data)
        for at in range(0, len(data), SEGMENT * BATCH):
            rows = segments(data[at:at + SEGMENT * BATCH])
            held.append(rows)
            owner.append(np.full(len(rows), i))
            count += len(rows)
            if count >= BATCH:
                flush()
                held, owner, count = [], [], 0
    if count:
        flush()
    return total, sizes


def predict(docs: DataFrame, net: Network, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability (the mean over all positions of the whole text)."""
    docs = docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(net)      # a few thousand weights
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    width = len(docs.columns)
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns],
                       F.when(F.regexp_like("text", F.lit(LETTER)), F.col("text")).alias("__lang_text"))

    def run(batches):
        import pyarrow as pa
        net = shared.value
        for batch in parts(batches, width, SLICE_CHARS):
            texts = batch.column(width).to_pylist()
            real = [i for i, t in enumerate(texts) if t is not None] if net.languages else []
            out, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
            total, sizes = document_sums(net, [texts[i] for i in real])
            for i, p in zip(real, total / np.maximum(sizes, 1)[:, None]):
                k = int(p.argmax())
                out[i], sure[i] = net.languages[k], min(1.0, float(p[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.string()), pa.array(sure, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)
