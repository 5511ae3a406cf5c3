"""Ranked lexical search by Block-Max MaxScore over sharded, compressed posting lists.

Index. Every task cuts its documents into shards of at most ``SHARD_TERMS`` terms (one longer document is a shard of its
own), sorted by id, and gives one row per (shard, term): the postings in blocks of ``BLOCK``, each with its first
document, byte widths, packed places and term counts, and its frontier: the (count, document length) pairs that no other posting of the
block beats in both. The bound of a block under any weights and any collection statistics is the best score on its
frontier, which is exact; so the index needs no statistics, shards can be added, and N, L and df are sums over its rows. The
index is a written table of all documents and all terms.

Search. Queries are inverted too: a row per (block of ``ITEMS`` queries, term) with the queries that use the term and its
weights. Joined to the index rows by term and grouped by (shard, query block), each group runs Block-Max MaxScore for its queries,
a window of ``WINDOW`` documents at a time: with the heap's threshold, the lists whose global bounds together stay below it are
non-essential; essential lists alone bring candidates; then, from the highest bound to the lowest, a candidate whose
score, block maximum and remaining bounds stay below the threshold is rejected, and only blocks that still hold
candidates are decompressed. Each group gives its k best, a window merges the shards' heaps. Bounds equal to the threshold stay
candidates, so ties are decided by the id exactly as in a full sort.

Scale: an index row is bounded by its shard, a group by a shard and a query block, so a word of every document is one list per shard and
one query set is dealt over all shards. The inverted queries are broadcast only up to ``SEND_USES`` entries (counted);
beyond that they are joined by a shuffle. Only N, L and that count reach the driver. All arithmetic but the weights is in 64-bit integers.

Edge cases: null texts, texts without terms and null ids are no documents; queries without terms and null item ids give no rows; rows of one
item id are one query with the terms of all; rows that repeat a document id rank as documents of their own; equal scores by
ascending id; terms of no document weigh nothing; scores of 0 are left out; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions, parts, slices

BLOCK = 64
WINDOW = 2048
SHARD_TERMS = 1_000_000
SLICE_CHARS = 6_000_000      # text that a task turns into postings at once
ITEMS = 256
SEND_USES = 500_000
SCHEMA = "shard string, term string, n long, total long, head binary, front binary, docs binary, counts binary"
HEAD = np.dtype([("first", "<u4"), ("docs", "u1"), ("counts", "u1"), ("front", "<u2")])
#: Bytes of terms: ASCII letters (A-Z lower-cased), digits and everything beyond ASCII; all else becomes a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_FOLD[65:91] = np.arange(97, 123)


def term_lists(texts):
    """A list of terms for every text of an Arrow string array (null: none); the lists hold empty strings too."""
    import pyarrow as pa
    import pyarrow.compute as pc
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return pc.split_pattern(texts, " ")
    folded = pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)])
    return pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), offsets, folded, offset=texts.offset), " ")


def _pack(values: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The lowest ``width`` bytes of every value, on end."""
    raw = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return raw[np.arange(4) < width[:, None]]


def _widths(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 256, 1, np.where(largest < 65536, 2, 4))


def _unpack(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, ("", "<u1", "<u2", "", "<u4")[width], n, at).astype(np.int64)


def shard_rows(ids: np.ndarray, codes: np.ndarray, owner: np.ndarray, terms):
    """Columns of the index rows of one shard after its name: ``codes`` are numbers into the Arrow array ``terms``,
    ``owner`` the documents' numbers, which follow ascending ids. The first row holds the documents themselves."""
    import pyarrow as pa
    lengths = np.bincount(owner, minlength=len(ids))
    pair, tf = np.unique(codes.astype(np.int64) * len(ids) + owner, return_counts=True)
    code, doc = pair // len(ids), pair % len(ids)
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))      # of lists
    n = np.diff(np.append(starts, len(code)))
    place = np.arange(len(code)) - np.repeat(starts, n)
    edge = place % BLOCK == 0
    block, begin = np.cumsum(edge) - 1, np.flatnonzero(edge)
    head = np.zeros(len(begin), HEAD)
    head["first"] = doc[begin]
    gap = doc - doc[begin][block]
    wide_d, wide_c = _widths(np.maximum.reduceat(gap, begin)), _widths(np.maximum.reduceat(tf, begin))
    head["docs"], head["counts"] = wide_d, wide_c
    # frontier: by falling count, a pair stays if its document is shorter than all before it in the block
    order = np.lexsort((lengths[doc], -tf, block))
    key = lengths[doc][order] - block[order] * (int(lengths.max()) + 1)
    low = np.minimum.accumulate(key)
    stay = order[np.append(True, key[1:] < low[:-1])]
    head["front"] = np.bincount(block[stay], minlength=len(begin))
    front = np.stack([tf[stay], lengths[doc][stay]], axis=1).astype("<u4")

    first_block = block[starts]
    bytes_d, bytes_c = wide_d[block], wide_c[block]

    def binary(data, per_list):
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per_list) + 1, [
            None, pa.py_buffer(np.concatenate([[0, 0], np.cumsum(per_list)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])

    per = lambda x: np.add.reduceat(x, starts)
    blocks = np.diff(np.append(first_block, len(begin)))
    fronts = np.add.reduceat(head["front"].astype(np.int64), first_block)
    names = pa.concat_arrays([pa.array([""], terms.type), terms.take(pa.array(code[starts]))])
    info = np.stack([ids.astype("<i8"), lengths.astype("<i8")])
    cols = [names, pa.array(np.append(len(ids), n)), pa.array(np.append(int(lengths.sum()), per(tf))),
            binary(head.view(np.uint8), blocks * HEAD.itemsize), binary(front.view(np.uint8).reshape(-1), fronts * 8),
            binary(_pack(gap, bytes_d), per(bytes_d)), binary(_pack(tf, bytes_c), per(bytes_c))]
    cols[3] = pa.concat_arrays([pa.array([info.tobytes()], pa.large_binary()), cols[3].slice(1)])
    return cols


def build(docs: DataFrame) -> DataFrame:
    """The index of all documents of ``docs`` (doc_id, text), written to the shared folder."""

    def index(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        part, serial = TaskContext.get().partitionId(), 0
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        held, size = [], 0

        def shards():
            nonlocal serial
            ids = np.concatenate([h[0] for h in held])
            lists = pa.chunked_array([h[1] for h in held]).combine_chunks()
            coded = lists.flatten().dictionary_encode()
            empty = np.array(pc.equal(coded.dictionary, ""), dtype=bool)
            codes = coded.indices.to_numpy()
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), pc.list_value_length(lists).to_numpy())
            real = ~empty[codes]
            codes, owner = codes[real], owner[real]
            n = np.bincount(owner, minlength=len(ids))
            rank = np.argsort(ids, kind="stable")
            rank = rank[n[rank] > 0]
            order = np.argsort(owner, kind="stable")
            edges = np.concatenate([[0], np.cumsum(n)])
            for a, b in slices(n[rank].tolist(), SHARD_TERMS):
                mine = rank[a:b]
                at = np.concatenate([order[edges[i]:edges[i + 1]] for i in mine])
                cols = shard_rows(ids[mine], codes[at], np.repeat(np.arange(len(mine), dtype=np.int32), n[mine]), coded.dictionary)
                name = pa.array([f"{part}-{serial}"] * len(cols[0]))
                serial += 1
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip([name, *cols], kinds)],
                                                 ["shard", "term", "n", "total", "head", "front", "docs", "counts"])

        for batch in parts(batches, 1, SLICE_CHARS // 4):
            held.append((batch.column(0).to_numpy(zero_copy_only=False), term_lists(batch.column(1))))
            size += pc.sum(pc.utf8_length(batch.column(1))).as_py() or 0
            if size >= SLICE_CHARS:
                yield from shards()
                held, size = [], 0
        if held:
            yield from shards()

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInArrow(index, SCHEMA), "blockmax-index", "zstd")


class Impact:
    """Points of a posting: (1000000000 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 75 + (25 * length * self.n_docs) // self.n_terms
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class PostingList:
    """One list of a shard. Blocks are decompressed when first asked for, and kept for the shard's other queries."""

    def __init__(self, n: int, head: bytes, front: bytes, docs: bytes, counts: bytes, lengths: np.ndarray, impact: Impact):
        self.head = np.frombuffer(head, HEAD)
        size = np.full(len(self.head), BLOCK)
        size[-1] = n - BLOCK * (len(size) - 1)
        self.size, self.docs, self.counts, self.lengths, self.impact = size, docs, counts, lengths, impact
        self.at_docs = np.cumsum(size * self.head["docs"]) - size * self.head["docs"]
        self.at_counts = np.cumsum(size * self.head["counts"]) - size * self.head["counts"]
        pairs = np.frombuffer(front, "<u4").reshape(-1, 2).astype(np.int64)
        begin = np.cumsum(self.head["front"], dtype=np.int64) - self.head["front"]
        self.first = self.head["first"].astype(np.int64)
        self.bound = np.maximum.reduceat(impact(pairs[:, 0], pairs[:, 1]), begin)     # per block, exact
        self.most = int(self.bound.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and points of block ``i``."""
        if i not in self.open:
            h, n = self.head[i], int(self.size[i])
            doc = self.first[i] + _unpack(self.docs, int(self.at_docs[i]), n, int(h["docs"]))
            tf = _unpack(self.counts, int(self.at_counts[i]), n, int(h["counts"]))
            self.open[i] = doc, self.impact(tf, self.lengths[doc])
        return self.open[i]

    def span(self, low: int, high: int):
        """Documents and points of the blocks that may hold documents from ``low`` to before ``high``."""
        a = max(0, int(np.searchsorted(self.first, low, "right")) - 1)
        b = int(np.searchsorted(self.first, high, "left"))
        if a >= b:
            return None
        got = [self.block(i) for i in range(a, b)]
        doc, points = (got[0] if len(got) == 1 else (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])))
        x, y = np.searchsorted(doc, [low, high])
        return (doc[x:y], points[x:y]) if y > x else None


def best_of_shard(lists: list[PostingList], weights: list[int], n_docs: int, k: int, count: dict | None = None):
    """(documents, scores) of a shard's ``k`` best for one query by Block-Max MaxScore. ``count``, if given, receives how many
    blocks candidates asked for and how many block maxima spared."""
    order = sorted((i for i in range(len(lists)) if weights[i] > 0), key=lambda i: weights[i] * lists[i].most)
    lists, weights = [lists[i] for i in order], [weights[i] for i in order]
    bounds = np.cumsum([w * x.most for w, x in zip(weights, lists)])           # of the lists up to each one
    heap_docs, heap_scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for low in range(0, n_docs, WINDOW):
        high = min(n_docs, low + WINDOW)
        # lists that together cannot reach the threshold bring no candidates
        first = int(np.searchsorted(bounds, least, "left"))
        score, seen = np.zeros(high - low, np.int64), np.zeros(high - low, bool)
        for i in range(first, len(lists)):
            got = lists[i].span(low, high)
            if got:
                score[got[0] - low] += weights[i] * got[1]
                seen[got[0] - low] = True
        cand = np.flatnonzero(seen)
        for i in range(first - 1, -1, -1):
            cand = cand[score[cand] + bounds[i] >= least]
            if not len(cand):
                break
            x, below = lists[i], int(bounds[i - 1]) if i else 0
            at = np.searchsorted(x.first, cand + low, "right") - 1
            inside = at >= 0
            most = np.where(inside, weights[i] * x.bound[np.maximum(at, 0)], 0)
            keep = score[cand] + most + below >= least
            if count is not None:
                count["spared"] = count.get("spared", 0) + len(np.unique(at[inside & ~keep])) - len(np.intersect1d(at[inside & ~keep], at[inside & keep]))
                count["asked"] = count.get("asked", 0) + len(np.unique(at[inside & keep]))
            cand, at = cand[keep], at[keep]
            for b in np.unique(at[at >= 0]).tolist():
                doc, points = x.block(b)
                mine = cand[at == b]
                hit = np.searchsorted(doc, mine + low)
                hit[hit == len(doc)] = 0
                same = doc[hit] == mine + low
                score[mine[same]] += weights[i] * points[hit[same]]
        cand = cand[score[cand] >= least]
        docs, scores = np.concatenate([heap_docs, cand + low]), np.concatenate([heap_scores, score[cand]])
        top = np.lexsort((docs, -scores))[:k]
        heap_docs, heap_scores = docs[top], scores[top]
        if len(top) == k:
            least = max(least, int(heap_scores[-1]))
    return heap_docs, heap_scores


def query_terms(queries: DataFrame) -> DataFrame:
    """(item_id, term, c): how often each item uses each of its terms."""

    def cut_up(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in parts(batches, 1, SLICE_CHARS):
            lists = term_lists(batch.column(1))
            item = batch.column(0).take(pc.list_parent_indices(lists))
            out = pa.RecordBatch.from_arrays([item, lists.flatten().cast(pa.string())], ["item_id", "term"])
            yield out.filter(pc.not_equal(out.column(1), ""))

    rows = queries.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInArrow(cut_up, "item_id long, term string").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("c"))


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item of ``queries`` (item_id, text)."""
    all_ = index.where(F.col("term") == "").agg(F.sum("n").alias("n"), F.sum("total").alias("l")).first()
    n_docs, n_terms = all_["n"] or 0, all_["l"] or 0
    asked = cut(query_terms(queries), "blockmax-terms")
    size = asked.agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("item_id").alias("items")).first()
    groups = max(1, -(-size["items"] // ITEMS))

    def send(df):       # counted; beyond the bound Spark joins by a shuffle
        return F.broadcast(df) if size["uses"] <= SEND_USES else df

    names = asked.select("term").distinct()
    df = index.join(send(names), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int")
    uses = asked.join(df, "term").select("term", block.alias("block"), F.struct("item_id", (F.col("c") * weight).alias("w")).alias("u"))
    uses = uses.groupBy("term", "block").agg(F.collect_list("u").alias("u"))
    uses = uses.select("term", "block", F.col("u.item_id").alias("items"), F.col("u.w").alias("weights"))
    # the shards' rows of documents go to every block of queries
    whole = index.where(F.col("term") == "").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) \
        .withColumn("items", F.array().cast("array<long>")).withColumn("weights", F.array().cast("array<long>"))
    # few bytes, much work: as many tasks as partitions, whatever their bytes
    rows = index.join(send(cut(uses, "blockmax-uses")), "term").unionByName(whole).repartition(partitions(index.sparkSession), "shard", "block")
    best = rows.groupBy("shard", "block").applyInPandas(_searcher(n_docs, n_terms, k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searcher(n_docs: int, n_terms: int, k: int):
    def run(pdf):
        import pandas as pd
        impact, lists, uses = Impact(n_docs, n_terms), [], {}
        whole = pdf[pdf["term"] == ""].iloc[0]
        ids, lengths = np.frombuffer(whole["head"], "<i8").reshape(2, -1)
        for r in pdf[pdf["term"] != ""].itertuples(index=False):
            lists.append(PostingList(r.n, r.head, r.front, r.docs, r.counts, lengths, impact))
            for item, w in zip(r.items, r.weights):
                uses.setdefault(int(item), []).append((len(lists) - 1, int(w)))
        out = []
        for item, terms in sorted(uses.items()):
            docs, scores = best_of_shard([lists[i] for i, _ in terms], [w for _, w in terms], len(ids), k)
            out.append(pd.DataFrame({"item_id": item, "doc_id": ids[docs], "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"item_id": [], "doc_id": [], "score": []}, dtype="int64")
    return run
