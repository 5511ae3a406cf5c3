"""Toxicity, quality, token counts, token files and packing on small fixtures."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import compression, dac, packing, token_counts, toxicity
from tessera.llm.common import cut, held_out
from tessera.llm.encode import coder
from tessera.llm.queries import QUERIES, vocabulary
from tests.conftest import SF0001

DOCS = "doc_id long, text string, score string, piece string, ids string, task string, lang string"
EDGE = ["", " ", "a", "\n", " a", "a ", "a  b", "a\n\nb c", "don't it's  x", "<|endoftext|> hi<|endoftext|>x", "é　y 1234 a1",
        "a\x02b \x02", "\x1cq r", "Σας ΣΑΣ, x²y.", "word, word. word!! x.%%%", "日本語 です", "a .b", "\r\n x\ty", "😀 😀a .", " ́x",
        "x" * 3000, "long word " * 1500]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "s", "p", "i", "t", None) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_ids_equal_the_whole_text_encoding(name, kind):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary(name))
    want = [t.encode(x, add_special_tokens=False).ids + [7] for x in EDGE]
    assert [x.tolist() for x in coder(vocabulary(name), kind).documents(EDGE, 7)] == want
    assert [x.tolist() for x in coder(vocabulary(name), kind).documents([None, "a b"], 7)][0] == [7]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab C.,'\n\t é1<|>　") for _ in range(rnd.randrange(60))) for _ in range(300)]
    assert [x.tolist() for x in coder(vocabulary(name), kind).documents(texts)] == \
        [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")])
def test_every_letter_before_every_tail(name, kind):
    import sys
    import unicodedata

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary(name))
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]
    odd = [c for c in letters if len(unicodedata.normalize("NFC", c).lower()) > 1 or not unicodedata.normalize("NFC", c).lower().isalpha()]
    assert len(odd) > 50 and "İ" in odd
    texts = [f"{c}{tail} a{c}{tail}" for c in odd for tail in ".,!?;:|&%$#*"] + ["BİRLİĞİ.", "İ", "aİ b", "İb."]
    for a in range(0, len(letters), 40_000):                # one text for many letters: every one before a full stop
        texts.append(" ".join(f"{c}." for c in letters[a:a + 40_000]))
    for got, text in zip(coder(vocabulary(name), kind).documents(texts), texts):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def test_words_before_punctuation_are_kept_once_and_normalised_together():
    from tokenizers import Tokenizer

    from tessera.llm.encode import Coder
    path = vocabulary("word_bpe_49k.json")
    t, code, calls = Tokenizer.from_file(path), Coder(path, "words"), []
    normal, code.normal = code.normal, lambda x: calls.append(x) or normal(x)
    texts = ["plain plain, plain. plain!? (plain) été été, noël; İl, İl", "plain; it's, J\u030c, e\u0301. <|endoftext|>, a_b? x=1, N,\tO."]
    assert [x.tolist() for x in code.documents(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert not {"plain,", "plain.", "plain!?", "plain;"} & set(code.cache)
    assert len(calls) <= 2                               # letters alone, and letters before punctuation
    rnd = random.Random(9)
    texts = [" ".join("".join(rnd.choice("aBZ.,!?;:|&%$#*'_-\u0301é") for _ in range(rnd.randrange(6))) for _ in range(30)) for _ in range(300)]
    assert [x.tolist() for x in code.documents(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_codes_give_random_access():
    rnd = np.random.default_rng(3)
    ids = np.concatenate([rnd.integers(0, 2 ** b, 700, dtype=np.uint32) for b in (4, 8, 9, 16, 17, 31)])
    rnd.shuffle(ids)
    raw = dac.pack([5, None, 7], np.array([0, 0, 100, len(ids)]), ids)
    f = dac.DacFile(lambda at, n: raw[at:at + n])
    assert f.doc_ids == [5, None, 7]
    assert [f.token(i) for i in range(0, len(ids), 37)] == ids[::37].tolist()
    for a, b in [(0, len(ids)), (511, 513), (1023, 2050), (9, 9), (len(ids) - 1, len(ids))]:
        assert f.tokens(a, b).tolist() == ids[a:b].tolist()
    assert f.document(0).tolist() == [] and f.document(2).tolist() == ids[100:].tolist()
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = frame(spark, EDGE).union(spark.createDataFrame([(None, "null id", *"spit", None), (3, "twice", *"spit", None), (3, None, *"spit", None)], DOCS))
    files = dac.write(docs, vocabulary("word_bpe_49k.json"), "words", 1, file_tokens=500)
    got = sorted(dac.read(files).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([*range(len(EDGE)), 3, 3]) + [None]
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == at
        at += len(ids)
        if r["doc_id"] not in (3, None):
            assert ids == t.encode(EDGE[r["doc_id"]], add_special_tokens=False).ids + [1]
    row = files.orderBy("base").first()
    f = dac.open_remote(row["path"])
    assert [f.token(i) for i in range(f.n_tokens)] == f.tokens(0, f.n_tokens).tolist()
    assert dac.read(dac.write(frame(spark, EDGE).limit(0), vocabulary("word_bpe_49k.json"))).count() == 0


def test_combinations_use_every_piece_once():
    rnd = random.Random(1)
    for counts in [{}, {1024: 3}, {1: 5000}, {600: 100, 424: 30, 212: 200}, {rnd.randrange(1, 1025): rnd.randrange(1, 50) for _ in range(300)}]:
        plan = packing.combinations(counts, 1024)
        used = {}
        for lengths, n in plan:
            assert sum(lengths) <= 1024 and n > 0
            for x in lengths:
                used[x] = used.get(x, 0) + n
        assert used == counts
        sequences = sum(n for _, n in plan)
        assert sequences >= -(-sum(k * v for k, v in counts.items()) // 1024)
    assert sum(n for _, n in packing.combinations({600: 100, 424: 30, 212: 200}, 1024)) == 115


def test_packing_is_gapless_and_whole(spark):
    docs = frame(spark, EDGE).union(frame(spark, ["same text"] * 40, 100)).union(
        spark.createDataFrame([(None, None, *"spit", None), (100, "same text", *"spit", None)], DOCS))
    made = packing.pieces(docs.repartition(4), vocabulary("byte_bpe_50k.json"))
    packed = cut(packing.assign(made), "test-packed")
    rows = packed.collect()
    assert len(rows) == made.count()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for part in by.values():
        part.sort(key=lambda r: r["offset"])
        end = 0
        for r in part:
            assert r["offset"] == end and len(r["ids"]) == 4 * r["length"]
            end += r["length"]
        assert end <= 1024
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(bytes(r["ids"]) for r in v) for k, v in by.items()}
    longest = sorted((r for r in rows if r["doc_id"] == len(EDGE) - 1), key=lambda r: r["piece"])
    assert all(r["length"] == 1024 for r in longest[1:]) and longest[0]["start"] == 0
    assert packing.assign(packing.pieces(docs.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_trie_counts_equal_plain_viterbi():
    m = token_counts.Unigram(["▁", "a", "b", "ab", "▁a", "ba", "aba", "bb"])
    words = sorted({"▁" + "".join(random.Random(i).choices("abé", k=i % 9)) for i in range(120)})
    m.score_sorted(words)
    for w in words:
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            found = [(best[j][0] + m.logp[w[j:i]], best[j][1] + 1) for j in range(i) if w[j:i] in m.logp]
            raw = len(w[i - 1].encode())
            best.append(max(found, key=lambda x: (x[0], -x[1])) if found else (best[i - 1][0] + raw * m.unknown, best[i - 1][1] + raw))
        assert math.isclose(m.terminal[w][1], best[-1][0]) and m.terminal[w][0] == best[-1][1]


def test_token_counts_per_document(spark):
    docs = frame(spark, EDGE).union(spark.createDataFrame([(None, None, *"spit", None)], DOCS))
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect()}
    m = token_counts.model(vocabulary("piece_bpe_32k.model"))
    import re
    for i, text in enumerate(EDGE):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, score = m.learn([token_counts.MARK + w for w in words]) if words else (np.zeros(1), np.zeros(1))
        assert (rows[i]["n_chars"], rows[i]["n_pretokens"], rows[i]["n_tokens"]) == (len(text), len(words), int(n.sum()))
        assert math.isclose(rows[i]["log_prob"], float(score.sum()), rel_tol=1e-9, abs_tol=1e-9)
    assert (rows[None]["n_chars"], rows[None]["n_tokens"]) == (0, 0)
    assert token_counts.count_tokens(docs.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def _labelled(spark, n=400):
    rnd = random.Random(7)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "do", "tempor", "magna"]
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 5 == 0, i % 7 == 0
        text = " ".join(rnd.choices(words, k=60))
        if toxic:
            text += " vile" + rnd.choice(words)
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, *"spit", None))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs, labels = _labelled(spark)
    out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, labels, out)
    edge = docs.union(spark.createDataFrame([(None, None, *"spit", None), (1000, "", *"spit", None), (1000, "LOREM vilelorem", *"spit", None)], DOCS))
    rows = toxicity.score(edge, model, "tox").select("*", out.alias("h")).collect()
    assert len(rows) == docs.count() + 3 and all(0 <= r["tox"] <= 1 for r in rows)
    held = [r for r in rows if r["h"] and r["doc_id"] < 1000]
    assert all((r["tox"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held) and len(held) > 50
    assert next(r["h"] for r in rows if r["doc_id"] is None) is False
    assert {r["h"] for r in rows if r["doc_id"] == 1} == {zlib.crc32(b"1") % 4 == 2}
    none = toxicity.fit(docs, labels.where("toxic = 0"), out)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {1 / (1 + math.exp(30))}
    assert toxicity.score(docs.limit(0), model, "tox").count() == 0
    assert toxicity.fit(docs.limit(0), labels.limit(0), out).weights == {}


def test_nnpu_keeps_the_clean_risk_from_going_negative():
    w, b = toxicity.train_nnpu([[0]] * 20, [[0]] * 5 + [[1]] * 45, 2, 0.1)
    p = lambda f: 1 / (1 + math.exp(-(b + w[f])))
    assert p(0) > 0.5 > p(1)
    assert np.isfinite(w).all()


def test_compression_quality(spark):
    docs, labels = _labelled(spark)
    out = held_out(F.col("doc_id"), 5, 0)
    model = compression.fit(docs, labels, out)
    edge = docs.union(spark.createDataFrame([(None, None, *"spit", None), (1000, "", *"spit", None)], DOCS))
    rows = compression.score(edge, model, "q").select("*", out.alias("h")).collect()
    held = [r for r in rows if r["h"] and r["doc_id"] < 1000]
    right = sum((r["q"] >= 0.5) == (r["doc_id"] % 7 != 0) for r in held)
    assert right >= 0.95 * len(held) and all(0 <= r["q"] <= 1 for r in rows)
    assert compression.score(docs.limit(0), model, "q").count() == 0
    one = compression.fit(docs, labels.where("quality = 1"), out)
    assert min(r["score"] for r in compression.score(docs.drop("score"), one).collect()) > 0.99
    assert compression.fit(docs, labels.limit(0), out).scorer()("x") == 0.5
    # very long texts give the driver no more than their share of blocks
    long = docs.withColumn("text", F.repeat("text", 400))
    blocks = compression._blocks(long.select("text", F.lit(1).alias("quality"), F.xxhash64("doc_id").alias("h")), 3)
    assert len(blocks) <= 3 * long.count() and max(len(b) for _, b in blocks) <= compression.BLOCK
    again = compression.fit(docs.repartition(3), labels, out)
    assert (again.good, again.bad, again.slope, again.offset) == (model.good, model.bad, model.slope, model.offset)


@pytest.mark.parametrize("key", ["op1_nnpu_toxicity", "op7_compression_quality"])
def test_scoring_queries_on_given_tables(spark, key):
    rows = QUERIES[key](spark, SF0001).collect()
    n = spark.read.parquet(f"{SF0001}/documents.parquet").count()
    modulus, rest = (4, 2) if key.startswith("op1") else (5, 0)
    assert len(rows) == n
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
