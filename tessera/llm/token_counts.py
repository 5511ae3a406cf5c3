"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The model takes its pieces from a public piece vocabulary; the probability of the piece of rank r is
``1 / ((1 + r) * H)`` (Zipf's law over the file's order, H the sum of ``1 / (1 + r)``). A pre-token is a run without
ASCII white space with the word mark in front. A prefix's forward score is the best log probability of a
segmentation of that prefix (ties: fewer tokens, then the longer last piece), and its count is the number of tokens
of that segmentation. A character in no piece costs one token per UTF-8 byte, each as unlikely as rank V.

A task dictionary-encodes a slice's pre-tokens, walks the distinct ones in sorted order, which is a depth-first
walk of their trie (the path to the last word is the stack; what a word shares with it is kept), so
each shared prefix is scored once, and stores terminal counts. Texts then sum the terminals of their pre-tokens.
Nothing is shuffled or broadcast but the vocabulary's path; memory is bounded by a slice and the cache limit.

Edge cases: null and empty texts have no tokens; a pre-token of any length is scored (time grows with its length
times the longest piece); null ids and repeated rows stay rows; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices

SLICE_CHARS = 4_000_000
CACHE_WORDS = 300_000
MARK = "▁"
_MODELS: dict = {}


class Unigram:
    """Piece log probabilities and the trie walk."""

    def __init__(self, pieces: list[str]):
        h = math.log(sum(1.0 / (1 + r) for r in range(len(pieces) + 1)))
        self.logp = {}
        for r, p in enumerate(pieces):
            self.logp.setdefault(p, -math.log(1 + r) - h)
        self.unknown = -math.log(1 + len(pieces)) - h
        # lengths of pieces by their last character: only those can end at a position
        ends: dict = {}
        for p in self.logp:
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: sorted(v) for c, v in ends.items()}
        self.terminal: dict[str, tuple[int, float]] = {}

    def score_sorted(self, words: list[str]) -> None:
        """Terminal (tokens, log probability) of every word; ``words`` ascend."""
        logp, ends = self.logp, self.ends
        best, count, last = [0.0], [0], ""
        for w in words:
            n, k = len(w), 0
            limit = min(n, len(last))
            while k < limit and w[k] == last[k]:
                k += 1
            del best[k + 1:], count[k + 1:]               # the path down to the shared prefix stays
            for i in range(k, n):
                c = w[i]
                b, t = -math.inf, 0
                for size in ends.get(c, ()):
                    j = i + 1 - size
                    if j < 0:
                        break
                    p = logp.get(w[j:i + 1])
                    if p is not None:
                        s, m = best[j] + p, count[j] + 1
                        if s > b or s == b and m <= t:
                            b, t = s, m
                if b == -math.inf:
                    raw = len(c.encode("utf-8", "surrogatepass"))
                    b, t = best[i] + raw * self.unknown, count[i] + raw
                best.append(b)
                count.append(t)
            self.terminal[w] = (count[n], best[n])
            last = w

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.terminal) > CACHE_WORDS:
            self.terminal.clear()
        known = self.terminal
        self.score_sorted(sorted(w for w in words if w not in known))
        got = [known[w] for w in words]
        return (np.fromiter((t for t, _ in got), np.int64, len(got)), np.fromiter((s for _, s in got), np.float64, len(got)))


def model(path: str) -> Unigram:
    """The worker's model of a sentencepiece file: its ordinary pieces in file order."""
    if path not in _MODELS:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ok = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        _MODELS[path] = Unigram([sp.id_to_piece(i) for i in ok])
    return _MODELS[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens, log_prob (natural logarithm) per document."""

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        m = model(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            chars = pc.utf8_length(texts)
            for a, b in slices(chars.to_pylist(), SLICE_CHARS):
                lists = pc.ascii_split_whitespace(texts.slice(a, b - a))
                flat = lists.flatten()
                real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                coded = flat.dictionary_encode()
                tokens, score = m.learn([MARK + w if w else "" for w in coded.dictionary.to_pylist()])
                codes = coded.indices.to_numpy()
                edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])

                def per_text(x):
                    total = np.concatenate([[0], np.cumsum(x)])
                    return total[edges[1:]] - total[edges[:-1]]

                sums = np.array([s.sum() for s in np.split(score[codes], edges[1:-1])]) if b > a else np.zeros(0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), chars.slice(a, b - a).cast(pa.int64()), pa.array(per_text(real)),
                     pa.array(per_text(tokens[codes])), pa.array(sums)],
                    ["doc_id", "n_chars", "n_pretokens", "n_tokens", "log_prob"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_chars long, n_pretokens long, n_tokens long, log_prob double")
