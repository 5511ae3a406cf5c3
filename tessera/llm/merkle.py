"""Document fingerprints: a Merkle tree over sections, paragraphs and leaves (DataFrame functions only).

A text is cut into sections (at blank lines), sections into paragraphs (lines) and paragraphs into leaves
(four words with their blanks; a leading run of blanks is a leaf). The pieces cover every character. A leaf
hashes its text, a paragraph its leaves' hashes, a section its paragraphs', the root its sections': equal texts
have equal roots, and where roots differ only the differing branches need a look (``tree`` and ``edits``).

A fingerprint is the root followed by a sketch, the ``SKETCH`` smallest distinct leaf hashes, so that its
length is bounded for texts of any length. The likeness of two fingerprints is the bottom-k estimate of the
share of distinct leaves they have in common.

``successor`` pairs each document with the next one in descending id order. Ids are cut into ranges at
approximate quantiles; a window per range looks ahead, and the last row of a range takes the first row of
the next non-empty one, so no task orders all documents.

Edge cases: null text is the empty text (one leafless paragraph, likeness 1 with another leafless text, else
0), null ids come last, repeated rows follow each other, a single document is its own successor, an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import partitions

SKETCH = 64
LEAF = r"(?:[^ ]+ *){1,4}| +"


def _leaves(text):
    """array(section) of array(paragraph) of array(leaf hash)."""
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(
        F.split(s, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x))))


def _join_hash(hashes):
    return F.md5(F.concat_ws("", hashes))


def fingerprints(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """``docs`` with ``{prefix}fingerprint`` (root:sketch) and ``{prefix}sketch`` (array of leaf hashes)."""
    leaves, root, sketch = f"__{prefix}leaves", f"__{prefix}root", f"{prefix}sketch"
    return (docs.withColumn(leaves, _leaves(F.coalesce(F.col(text), F.lit(""))))
            .withColumn(root, _join_hash(F.transform(leaves, lambda s: _join_hash(F.transform(s, _join_hash)))))
            .withColumn(sketch, F.slice(F.array_sort(F.array_distinct(F.transform(
                F.flatten(F.flatten(leaves)), lambda x: F.substring(x, 1, 8)))), 1, SKETCH))
            .withColumn(f"{prefix}fingerprint", F.concat(F.col(root), F.lit(":"), F.concat_ws("", sketch)))
            .drop(leaves, root))


def likeness(a: str, b: str):
    """Bottom-k estimate of the Jaccard similarity of two sketches."""
    merged = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.array_intersect(merged, F.array_intersect(a, b))
    return F.when(F.size(merged) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(merged)).cast("double")


def tree(docs: DataFrame, text: str = "text") -> DataFrame:
    """All nodes: doc_id, level (0 root, 1 section, 2 paragraph, 3 leaf), section, paragraph, leaf, hash, start, n_chars.

    Positions and starts count from 0; starts are code points from the start of the text (leaves only)."""
    t = F.coalesce(F.col(text), F.lit(""))
    s = (docs.select("doc_id", F.posexplode(F.split(t, "\n\n")).alias("section", "s"), F.split(t, "\n\n").alias("all"))
         .withColumn("s_at", F.aggregate(F.slice("all", F.lit(1), F.col("section")), F.lit(0),
                                         lambda a, x: a + F.length(x) + 2)).drop("all"))
    p = (s.select("doc_id", "section", "s_at", F.split("s", "\n").alias("all"))
         .select("*", F.posexplode("all").alias("paragraph", "p"))
         .withColumn("p_at", F.col("s_at") + F.aggregate(F.slice("all", F.lit(1), F.col("paragraph")), F.lit(0),
                                                         lambda a, x: a + F.length(x) + 1))
         .withColumn("pieces", F.regexp_extract_all("p", F.lit(LEAF), F.lit(0))).drop("all"))
    leaves = (p.select("doc_id", "section", "paragraph", "p_at", "pieces",
                       F.posexplode("pieces").alias("leaf", "x"))
              .select("doc_id", F.lit(3).alias("level"), "section", "paragraph", "leaf", F.md5("x").alias("hash"),
                      (F.col("p_at") + F.aggregate(F.slice("pieces", F.lit(1), F.col("leaf")), F.lit(0),
                                                   lambda a, y: a + F.length(y))).alias("start"),
                      F.length("x").alias("n_chars")))
    nul = F.lit(None).cast("int")
    h = docs.select("doc_id", _leaves(t).alias("h"))
    paragraphs = (h.select("doc_id", F.posexplode("h").alias("section", "s"))
                  .select("doc_id", "section", F.posexplode("s").alias("paragraph", "p"))
                  .select("doc_id", F.lit(2).alias("level"), "section", "paragraph", nul.alias("leaf"),
                          _join_hash(F.col("p")).alias("hash"), nul.alias("start"), nul.alias("n_chars")))
    sections = (h.select("doc_id", F.posexplode("h").alias("section", "s"))
                .select("doc_id", F.lit(1).alias("level"), "section", nul.alias("paragraph"), nul.alias("leaf"),
                        _join_hash(F.transform("s", _join_hash)).alias("hash"), nul.alias("start"), nul.alias("n_chars")))
    roots = h.select("doc_id", F.lit(0).alias("level"), nul.alias("section"), nul.alias("paragraph"), nul.alias("leaf"),
                     _join_hash(F.transform("h", lambda s: _join_hash(F.transform(s, _join_hash)))).alias("hash"),
                     nul.alias("start"), nul.alias("n_chars"))
    return roots.unionByName(sections).unionByName(paragraphs).unionByName(leaves)


def edits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves of two trees of the same ids that differ: doc_id, section, paragraph, leaf, start_a, n_a, start_b, n_b.

    Works down the levels: only branches whose hash differs reach the next level."""
    at = {0: [], 1: ["section"], 2: ["section", "paragraph"], 3: ["section", "paragraph", "leaf"]}
    open_ = None
    for level, cols in at.items():
        key = ["doc_id", *cols]
        x = a.where(F.col("level") == level).select(*key, F.col("hash").alias("ha"), F.col("start").alias("start_a"),
                                                    F.col("n_chars").alias("n_a"))
        y = b.where(F.col("level") == level).select(*key, F.col("hash").alias("hb"), F.col("start").alias("start_b"),
                                                    F.col("n_chars").alias("n_b"))
        if open_ is not None:
            up = ["doc_id", *at[level - 1]]
            x, y = x.join(open_, up, "left_semi"), y.join(open_, up, "left_semi")
        found = x.join(y, key, "full").where(~F.col("ha").eqNullSafe(F.col("hb")))
        open_ = found.select(*key)
    return found.select(*key, "start_a", "n_a", "start_b", "n_b")


#: Ranges for every partition, so that hashing them gives no partition much more than its share.
RANGES = 4


def successor(docs: DataFrame, order: str, carry: list[str], derive=lambda frame: frame) -> DataFrame:
    """``derive(docs)`` with ``next_<c>`` for every column of ``carry``: the values of the next row in descending order
    of ``order`` (nulls last; ties by a hash of the row), the last row followed by the first.

    Rows are shuffled once, by range. ``derive`` runs before that shuffle, and on the ranges' first rows."""
    n = RANGES * partitions(docs.sparkSession)
    bounds = docs.select(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = F.lit([int(x) for x in sorted(set(bounds))]).cast("array<bigint>")
    # ranges from the highest ids (0) down; null ids in the last
    rng = F.when(F.col(order).isNull(), F.lit(len(set(bounds)) + 1)).otherwise(
        F.size(F.filter(cuts, lambda b: b > F.col(order))))
    tie = F.xxhash64(*docs.columns)
    ranged = derive(docs.withColumn("__tie", tie)).withColumn("__range", rng)
    seq = Window.partitionBy("__range").orderBy(F.col(order).desc_nulls_last(), "__tie")
    here = F.struct(*[F.col(c) for c in carry])
    ahead = ranged.withColumn("__next", F.lead(here).over(seq))
    # one row per range: the first row of a range follows the last of the range before it
    tops = docs.groupBy(rng.alias("__range")).agg(F.max(order).alias("__top"))
    first = (docs.withColumn("__tie", tie)
             .join(F.broadcast(tops), F.col(order).eqNullSafe(F.col("__top")))  # at most n + 1 rows of two numbers
             .groupBy("__range").agg(F.min_by(F.struct(*docs.columns, "__tie"), "__tie").alias("__row")))
    heads = derive(first.select("__range", "__row.*"))
    ring = Window.orderBy("__range")
    heads = heads.withColumn("__head", here).select(F.col("__range").alias("__r"), F.coalesce(
        F.lead("__head").over(ring),
        F.first("__head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__head"))
    out = ahead.join(heads, ahead["__range"] == heads["__r"], "left").withColumn("__next", F.coalesce("__next", "__head"))
    return out.select(
        *[c for c in ranged.columns if not c.startswith("__")], *[F.col("__next")[c].alias(f"next_{c}") for c in carry])


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by as many (or all)
    from the start of the next document in descending id order."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the successor gives its text and its own sketch
    pair = successor(base, "doc_id", ["text", "sketch"], lambda d: fingerprints(d, "text", ""))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = pair.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "sketch", "next_sketch",
                         F.concat(F.substring(F.col("text"), F.lit(1), n - third),
                                  F.substring(F.col("next_text"), F.lit(1), third)).alias("edited"))
    both = fingerprints(edited, "edited", "edited_")
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", likeness("sketch", "edited_sketch").alias("near_edited"),
                       likeness("sketch", "next_sketch").alias("near_next"))
