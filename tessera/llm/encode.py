"""Token ids of whole texts, one Arrow batch at a time.

A batch is cut into chunks at blanks that are always boundaries of pre-tokens, the chunks are dictionary-encoded
in Arrow, and only chunks not met before by this worker go to the tokenizer; ids of texts are then gathered
with numpy. The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` over the whole text.

* ``words``: a vocabulary that drops white space (each chunk between blanks or line ends stands alone).
* ``bytes``: byte-level pre-tokens that keep a leading blank. Chunks are cut before a single blank or line end
  between two other characters; a text with any other white space is cut in Python by the same rule.

The worker's memory is bounded: the cache of chunks is emptied at ``CACHE_CHUNKS`` entries and a batch is worked
off in slices of ``SLICE_CHARS`` characters (one longer text is one slice).
"""

from __future__ import annotations

import os
import re

import numpy as np

from tessera.llm.common import slices

CACHE_CHUNKS = 600_000
SLICE_CHARS = 5_000_000
_TAIL = ".,!?;:|&%$#*"
#: Punctuation behind an ASCII letter, up to a blank: a pre-token of its own also with a blank before it.
_ENDED = r"([A-Za-z])([.,!?;:|&%$#*]+)( |$)"
#: In front of a text's first chunk, which has no blank before it.
_FIRST = "\x02"
#: Texts (RE2) whose white space is more than single blanks and line ends between other characters.
_ODD = (r"(?s)^[ \n]|[ \n]$|[ \n][ \n]|[\t\r\x0b\x0c\x1c-\x1f\x02\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
        r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CODERS: dict = {}


def coder(path: str, kind: str) -> "Coder":
    """The worker's coder for a vocabulary file: workers outlive tasks, so its cache does too."""
    if (path, kind) not in _CODERS:
        _CODERS[path, kind] = Coder(path, kind)
    return _CODERS[path, kind]


class Coder:
    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.kind, self.cache = kind, {}
        size = self.tok.get_vocab_size()
        mark = (lambda t: t.endswith("</w>")) if kind == "words" else (lambda t: t.startswith("Ġ"))
        normaliser = self.tok.normalizer
        self.normal = normaliser.normalize_str if normaliser else lambda t: t
        self.edge = np.array([mark(self.tok.id_to_token(i) or "") for i in range(size)])

    def _encode(self, texts: list[str]) -> list:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, texts: list[str]):
        return (np.array(ids, dtype="<u4").tobytes() for ids in self._encode(texts))

    def _plain(self, heads: list[str]) -> None:
        """Ids of letter-only chunks: they are single pre-tokens, so one call over all of them can be cut again."""
        if not heads:
            return
        lead = "" if self.kind == "words" else " "
        ids = np.array(self._encode([lead + " ".join(heads)])[0], dtype="<u4")
        edge = np.flatnonzero(self.edge[ids])
        if len(edge) != len(heads):                     # never seen; the slow way is always right
            self.cache.update(zip(heads, self._bytes([lead + h for h in heads])))
            return
        ends = 4 * (edge + 1 if self.kind == "words" else np.append(edge[1:], len(ids)))
        raw, at = ids.tobytes(), 0
        for h, end in zip(heads, ends.tolist()):
            self.cache[h] = raw[at:end]
            at = end

    def _letters(self, chunks: list[str]) -> set[str]:
        """Those of letters only, and also after the vocabulary's normaliser: lower-casing or composing turns some
        letters into a letter and a mark, which would join the punctuation behind. One call normalises all of them,
        blanks between them."""
        found = {c for c in chunks if c.isalpha()}
        wide = [c for c in found if not c.isascii()]
        if wide:
            normal = self.normal(" ".join(wide)).split(" ")
            if len(normal) != len(wide):                # never seen; the slow way is always right
                normal = [self.normal(c) for c in wide]
            found.difference_update([c for c, n in zip(wide, normal) if not n.isalpha()])
        return found

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids (little-endian, 4 bytes each) of each distinct chunk."""
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        fresh = [c for c in chunks if c not in cache]
        if fresh:
            letters = self._letters(fresh)
            ends = {c: c.rstrip(_TAIL) for c in fresh if c not in letters}
            stems = self._letters([h for c, h in ends.items() if h != c])
            parts = {c: h for c, h in ends.items() if h in stems}   # letters, then punctuation: two pre-tokens
            self._plain([h for h in letters | set(parts.values()) if h not in cache])
            # a tail's key starts with a blank, which no chunk holds
            tails = {" " + c[len(h):] for c, h in parts.items()}
            tails = [t for t in tails if t not in cache]
            cache.update(zip(tails, self._bytes([t[1:] for t in tails])))
            for c, h in parts.items():
                cache[c] = cache[h] + cache[" " + c[len(h):]]
            other = [c for c in ends if c not in parts]
            cache.update(zip(other, self._bytes([self._context(c) for c in other])))
        return [cache[c] for c in chunks]

    def _context(self, chunk: str) -> str:
        if self.kind == "words":
            return chunk
        if chunk[:1] == _FIRST:
            return chunk[1:]
        return chunk if chunk[:1] == "\n" else " " + chunk

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, number of ids per text) of an Arrow string array without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if self.kind == "words":
            texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _ENDED, r"\1 \2\3")
        else:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            if odd.any():
                ids, n = self.encode(texts.filter(pa.array(~odd)))
                plain = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
                lists = [self._odd(t.as_py()) if o else next(plain) for t, o in zip(texts, odd)]
                return np.concatenate(lists), np.array([len(x) for x in lists], dtype=np.int64)
            first, none = pa.scalar(_FIRST, texts.type), pa.scalar("", texts.type)
            texts = pc.replace_substring(pc.binary_join_element_wise(first, texts, none), "\n", " \n")
        lists = pc.split_pattern(texts, " ")
        per_text = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        got = self.learn(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        pool = np.frombuffer(b"".join(got), "<u4")
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy()
        n = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        # place of every id in the pool: its chunk's start plus its place in the chunk
        where = np.arange(ends[-1]) + np.repeat(starts[codes] - ends[:-1], n)
        edges = np.concatenate([[0], np.cumsum(per_text)])
        return pool[where], ends[edges[1:]] - ends[edges[:-1]]

    def _odd(self, text: str) -> np.ndarray:
        """A text with runs of white space or rare white space: cut at single blanks between other characters."""
        parts = _SAFE.split(text)
        out = [np.zeros(0, "<u4")]
        for at in range(0, len(parts), 10_000):
            batch = [p if at + i == 0 else " " + p for i, p in enumerate(parts[at:at + 10_000])]
            out += [np.array(x, dtype="<u4") for x in self._encode(batch)]
        return np.concatenate(out)

    def documents(self, texts, end_id: int | None = None):
        """Yield the id array of each text in turn (an Arrow array or a list; null: empty), ``end_id`` appended."""
        import pyarrow as pa
        import pyarrow.compute as pc
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        for a, b in slices(pc.utf8_length(texts).to_pylist(), SLICE_CHARS):
            ids, n = self.encode(texts.slice(a, b - a))
            at = 0
            for k in n.tolist():
                yield np.concatenate([ids[at:at + k], tail])
                at += k
