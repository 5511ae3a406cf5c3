"""Near-duplicates, fingerprints, quotations, mixing, search and the pipeline on small fixtures."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import merkle, minhash, mixing, quotes, topk
from tessera.llm.queries import ORACLES, QUERIES
from tests.conftest import SF0001
from tools.oracle_check import TABLES, rows_of

DOCS = "doc_id long, text string, source string, node string, component string, rate string, size string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "n", "c", "r", "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    assert rows_of(QUERIES[key](spark, SF0001).toPandas()) == rows_of(con.execute(ORACLES[key]).df())


def brute_components(rows):
    """doc_id -> (set size, smallest id reachable) by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    comp = {i: i for i, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(i), root(j)
                comp[max(p, q)] = min(p, q)
    return {i: (len(x), root(i)) for i, x in sets}


def test_ids_with_several_texts_are_one_node(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (9, b), (11, c), (12, c), (20, d), (20, ""), (20, None), (21, ""), (11, c), (30, "x"), (30, "y"), (31, "y")]
    docs = frame(spark, [(i, t, None) for i, t in rows] + [(None, a, None)])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    assert {(r["doc_id"], r["component_id"]) for r in got} == {
        (1, 1), (5, 1), (9, 1), (11, 11), (12, 11), (20, 20), (21, 21), (30, 30), (31, 30), (None, None)}
    assert all(r["kept"] == (r["doc_id"] in (None, r["component_id"])) for r in got)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    base = [rnd.choices(words, k=120) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, "x " * 50), (7, "x y")]
    for n, edits in ((90, 3), (60, 6), (40, 10), (5, 1), (1, 0), (30, 0)):
        b = base[len(rows) % 6]
        for _ in range(n):
            t = list(b)
            for _ in range(rnd.randrange(edits + 1)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((len(rows), " ".join(t)))
    monkeypatch.setattr(minhash, "SHORT_LIST", 6)           # so that long lists and several blocks occur
    monkeypatch.setattr(minhash, "BLOCK", 10)
    docs = frame(spark, [(i, t, None) for i, t in rows] + [(None, "one two", None)])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] in (None, r["component_id"])) for r in got)
    assert len(set(want.values())) > 20
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprints_and_edits(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b c d e f\ng h\n\nsecond section"), (4, "a b c d e f\ng H\n\nsecond section"),
            (5, "a b c d e f\ng h\n\nsecond section"), (6, " x"), (7, "x "), (8, long), (None, "no id"), (8, long)]
    docs = frame(spark, [(i, t, None) for i, t in rows])
    f = merkle.fingerprints(docs, "text", "").select("text", "fingerprint").distinct().collect()
    assert len({r["fingerprint"] for r in f}) == len({r["text"] or "" for r in f})
    pairs = merkle.edited_pairs(docs).collect()
    assert len(pairs) == len(rows)
    chain = [8, 8, 7, 6, 5, 4, 3, 2, 1, None]
    texts = {i: t or "" for i, t in rows}
    import hashlib
    for a, b in zip(chain, chain[1:] + chain[:1]):
        third = len(texts[a]) // 3
        want = hashlib.sha256((texts[a][:len(texts[a]) - third] + texts[b][:third]).encode()).hexdigest()
        assert want in {r["edited_sha256"] for r in pairs if r["doc_id"] == a}
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in pairs)
    one = frame(spark, [(1, "a b c d e f\ng h\n\nsecond section", None), (2, "same", None)])
    two = frame(spark, [(1, "a b c d e F\ng h\n\nsecond section more", None), (2, "same", None)])
    found = {(r["doc_id"], r["section"], r["paragraph"], r["leaf"], r["start_a"]) for r in merkle.edits(merkle.tree(one), merkle.tree(two)).collect()}
    assert found == {(1, 0, 0, 1, 8), (1, 1, 0, 0, 17)}
    assert merkle.edited_pairs(docs.limit(0)).count() == 0
    solo = merkle.edited_pairs(docs.where("doc_id = 3")).first()
    assert solo["near_next"] == 1.0


def test_quotation_linking(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> how ARE  you?\nFine."),
            (1, 2, "user", "> > How are you?\n> Fine.\nGood"), (1, 5, "user", ">Hello there\n> Fine.\n> unknown line\nreply"),
            (2, 0, "user", "> Hello there\nfrom outside"), (3, 0, None, None), (3, 1, "user", ""), (None, 0, "user", "> Hello there"),
            (4, None, "user", "x"), (1, 1, "assistant", "repeated key")]
    m = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, thread int, norm int")
    got = {(r["conv_id"], r["turn"], r["text"]): r for r in quotes.conversations(m).collect()}
    assert len(got) == len(rows)
    r = got[1, 1, "Fine."]
    assert (r["reply_to"], r["thread"], r["depth"], r["n_quoted"], r["n_linked"], r["max_level"]) == (0, 0, 1, 1, 1, 1)
    r = got[1, 2, "Good"]
    assert (r["reply_to"], r["depth"], r["n_quoted"], r["n_linked"], r["max_level"]) == (1, 2, 2, 2, 2)
    r = got[1, 5, "reply"]                                  # one line of turn 0, one of turn 1: the later wins
    assert (r["reply_to"], r["thread"], r["n_quoted"], r["n_linked"]) == (1, 0, 3, 2)
    assert (got[2, 0, "from outside"]["n_linked"], got[2, 0, "from outside"]["reply_to"]) == (1, None)
    assert got[3, 1, ""]["reply_to"] == 0 and got[3, 0, ""]["thread"] == 0
    assert got[None, 0, ""]["n_linked"] == 0 and got[4, None, "x"]["depth"] == 0
    assert got[1, 1, "repeated key"]["thread"] == 0
    src = {(r["conv_id"], r["turn"], r["line_no"]): (r["src_conv"], r["src_turn"], r["src_first"]) for r in quotes.links(m).collect()}
    assert src[2, 0, 0] == (1, 0, True) and src[1, 2, 0] == (1, 0, False) and src[1, 5, 2] == (None, None, False)
    assert quotes.conversations(m.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.randrange(1, 40), "hot" if i % 3 == 0 else f"s{i % 10}") for i in range(3000)]
    rows += [(5000, None, "s1"), (5001, "", "empty"), (5002, "a b c", None), (7, "again", "s7")]
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), src=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.src).all()
    assert abs(by.target.sum() - by["size"].sum()) < 1e-6 and (by.target <= 3 * by.src + 1e-9).all()
    assert (abs(by.taken - by.target) <= 40 + 0.01 * by.target).all()
    again = mixing.mix(frame(spark, rows).repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0


def test_balance_with_two_constraints(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"l{i % 2 if i % 7 else 0}", 10 + i % 13) for i in range(600)], "id long, s string, l string, size long")
    total = docs.agg(F.sum("size")).first()[0]
    want_s = spark.createDataFrame([(f"s{i}", total * x) for i, x in enumerate((0.5, 0.3, 0.2))], "v string, t double")
    want_l = spark.createDataFrame([("l0", total * 0.6), ("l1", total * 0.4)], "v string, t double")
    out = mixing.balance(docs, "size", {"s": want_s, "l": want_l}).toPandas()
    out["tokens"] = out["size"] * out.rate
    assert np.allclose(out.groupby("s").tokens.sum(), [total * x for x in (0.5, 0.3, 0.2)], rtol=1e-6)
    assert np.allclose(out.groupby("l").tokens.sum(), [total * 0.6, total * 0.4], rtol=1e-6)
    with pytest.raises(ValueError):
        mixing.balance(docs, "size", {"s": want_s.withColumn("t", F.col("t") * 10)}, max_steps=5)


def test_top_k_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=16).astype("f4").tolist()) for i in range(300)] + [(300 + i, [0.5] * 16) for i in range(200)]
    odd = [(900, None), (901, [float("nan")] * 16), (902, [float("inf")] * 16), (903, []), (904, [1.0, None]), (905, [1.0] * 20), (None, [1.0])]
    v = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<float>, terms int, block int")
    q = topk.quantise(v, "vec_id", "embedding", 64)
    got = topk.top_k(q, q.where("vec_id % 20 = 0"), 20, query_block=7, candidate_block=33).collect()
    whole = {i: np.floor(64 * np.array((x + [0.0] * 20)[:20], dtype="f8")).astype(int) for i, x in rows + [odd[3], odd[5]]}
    for query in [i for i in whole if i % 20 == 0]:
        n = lambda i: len(whole[i])
        best = sorted(((-int(whole[query] @ whole[i]), i) for i in whole if i != query))[:20]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]
    assert topk.top_k(q.limit(0), q.limit(0), 20).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, SF0001), f"test-{name}")
        before, after = {r[0] for r in docs.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before and after
        if name != "packing":
            assert out.columns == columns
        if name == "near_dedup":
            want = {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
            assert after == want
        if name == "mixing":
            taken = mixing.mix(docs).where("copies > 0").select("doc_id", "copies").collect()
            assert {(r["doc_id"], r["n"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {tuple(r) for r in taken}
        if name == "packing":
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
        docs = out
    empty = spark.read.parquet(f"{SF0001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF0001).count() == 0


def test_pipeline_keeps_rows_apart_that_share_an_id_or_have_none(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    a, b, c, d = (text(80) for _ in range(4))
    near = a + " one more"
    rows = [(3, a, "s"), (7, near, "s"), (7, b, "s"), (7, c, "s"), (8, c, "s"), (9, d, "s"), (9, d, "s"), (4, "", "s"), (4, None, "s"),
            (None, a, "s"), (None, a, "s"), (None, d, "s")]
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), SF0001).collect()
    got = sorted(((r["doc_id"] or -1, r["text"] or "") for r in out))
    assert got == sorted([(3, a), (7, b), (7, c), (9, d), (4, ""), (-1, a), (-1, a), (-1, d)])
    # 300 rows without an id, two texts under one id: as many rows as copies, each text by its own count
    rows = [(None, text(1 + i % 37), f"s{i % 3}") for i in range(300)] + [(1, text(20), "s0"), (1, text(30), "s1")]
    docs = frame(spark, rows)
    n = mixing.mix(docs)
    assert n.count() == len(rows) and "__mix_row" not in n.columns
    mixed = corpus_pipeline.mixed(spark, docs, SF0001)
    assert mixed.count() == n.agg(F.sum("copies")).first()[0]
    assert mixed.groupBy("text").count().agg(F.max("count")).first()[0] <= mixing.MAX_COPIES
    taken = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("t")).collect()}
    assert taken == {r["source"]: r["t"] for r in n.groupBy("source").agg(F.sum("taken").alias("t")).collect()}


def test_rows_without_an_id_fill_several_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 50)
    seen = spark.sparkContext.accumulator(0)
    whole = mixing._round_slot
    def counted(pdf):
        seen.add(1 if len(pdf) else 0)
        return whole(pdf)
    monkeypatch.setattr(mixing, "_round_slot", counted)
    docs = frame(spark, [(None, "w " * (1 + i % 9), "s") for i in range(500)])
    mixing.mix(docs).collect()
    assert seen.value > 5


def test_rewrapped_quotes_find_their_message(spark):
    first = "The quick brown fox jumps over the lazy dog. It then walks home\nand sleeps until the sun\ncomes up. Nobody saw it."
    wrapped = "> the quick brown fox\n> jumps over the lazy dog. It then\n>   walks home and sleeps until the sun comes\n> up. Nobody saw it.\nYes"
    piece = "> It then walks home and sleeps\n> until the sun comes up. And a line\n> of nobody.\nNo"
    m = spark.createDataFrame([(1, 0, "u", first), (1, 1, "u", "other"), (1, 2, "u", wrapped), (1, 3, "u", piece), (2, 0, "u", wrapped)],
                              "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(m).collect()}
    assert (got[1, 2]["reply_to"], got[1, 2]["n_quoted"], got[1, 2]["n_linked"]) == (0, 4, 4)
    assert (got[1, 3]["reply_to"], got[1, 3]["n_quoted"], got[1, 3]["n_linked"]) == (0, 3, 2)
    assert got[2, 0]["n_linked"] == 0                       # passages are looked up in their own conversation


def test_hot_line_of_a_hot_conversation_makes_no_pairs(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quotes, "cut", lambda df, name, f=quotes.cut: plans.append(df) or f(df, name))
    rows = [(1, i, "u", "thanks" if i % 2 == 0 else f"> thanks\nown {i}") for i in range(2000)]
    rows += [(1, 3000, "u", "> thanks\n> own 7\n> own 1999"), (2, 5, "u", "thanks"), (2, 5, "u", "> thanks"), (2, 6, "u", "> Thanks")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = quotes.links(m)
    src = {(r["conv_id"], r["turn"], r["norm"]): r["src_turn"] for r in found.collect()}
    assert all(src[1, i, "thanks"] == i - 1 for i in range(1, 2000, 2))
    assert (src[1, 3000, "thanks"], src[1, 3000, "own 7"], src[1, 3000, "own 1999"]) == (1998, 7, 1999)
    assert (src[2, 5, "thanks"], src[2, 6, "thanks"]) == (0, 5)
    for df in [*plans, found]:
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
        assert not [x for x in joins if "turn#" in x and (" < turn#" in x or " > turn#" in x)]


def test_top_k_keeps_vectors_of_large_components(spark):
    big = float(2 ** 40)
    rows = [(20, [big, 1.0]), (1, [big, -1.0]), (2, [-big, 2.0]), (3, [1.0, 1.0]), (40, [0.0, 1.0])]
    rows = [(i, [x / 64 for x in v]) for i, v in rows] + [(50, [float("inf"), 1.0])]
    wide = [(60 + i, [2.0 ** 50 / 64, -(2.0 ** 50) / 64, float(i)]) for i in range(3)]
    q = topk.quantise(spark.createDataFrame(rows + wide, "vec_id long, embedding array<double>"), "vec_id", "embedding", 64)
    assert q.count() == 8
    ask = q.where("vec_id IN (40, 3)")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(q, ask, 20).collect()}
    assert got[3, 2] == 2 - 2 ** 40 and got[40, 2] == 2 and got[40, 60] == -(2 ** 50) and len(got) == 14
    # 2**31 * 2**32 passes 64 bits in between: the terms cancel, the score does not
    edge = spark.createDataFrame([(1, [2.0 ** 32, 2.0 ** 32, 3.0]), (2, [2.0 ** 32, -(2.0 ** 32), 5.0]), (3, [1.0, 0.0, 0.0])],
                                 "vec_id long, embedding array<double>")
    e = topk.quantise(edge, "vec_id", "embedding", 1)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(e, e.where("vec_id = 1"), 5).collect()}
    assert got == {(1, 2): 15, (1, 3): 2 ** 32}
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(e.unionByName(e.where("vec_id = 1").selectExpr("9L AS vec_id", "terms")), e.where("vec_id = 1"), 5).collect()
    with pytest.raises(Exception, match="64 bits"):
        topk.quantise(edge.selectExpr("vec_id", "transform(embedding, x -> x * 1e12D) AS embedding"), "vec_id", "embedding", 1).collect()


def test_top_k_never_broadcasts_its_query_blocks(spark, monkeypatch):
    # their files are small, but they stand once for every group
    joined, kind = [], type(spark.range(1))
    real = kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a, **b: joined.append(real(self, *a, **b)) or joined[-1])
    v = spark.range(400).selectExpr("id AS vec_id", "array(id % 7, id % 11, -id % 5) AS terms")
    assert topk.top_k(v, v.where("vec_id % 20 = 0"), 20).count() == 400
    assert joined and not [j for j in joined if "Broadcast" in j._jdf.queryExecution().executedPlan().toString()]


def test_block_top_k_in_every_width_of_integers():
    rnd = np.random.default_rng(9)
    for high in (3, 127, 2 ** 14, 2 ** 30, 2 ** 62):
        q, c = (rnd.integers(-high, high, (n, 5)) * (rnd.random((n, 5)) < 0.6) for n in (40, 90))
        least = [None, 10 ** 4] * 20
        whole = q.astype(object) @ c.T.astype(object)
        got = {i: dict(zip(places.tolist(), s.tolist())) for i, places, s in topk.block_top_k(np.arange(40), q, np.arange(90), c, 9, least)}
        for i in range(40):
            best = sorted((-whole[i, j], j) for j in range(90) if j != i and (least[i] is None or whole[i, j] >= least[i]))[:9]
            assert got.get(i, {}) == {j: -s for s, j in best}
