"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blockmax, compression, dac, fim, langid, merkle, minhash, mixing, packing, quotes, token_counts, topk, toxicity
from tessera.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine of the cluster."""
    import public_tokenizers
    return public_tokenizers.path(name)


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return deco


def _scored(docs, model, scorer, out):
    scored = scorer.score(docs.select(F.col("doc_id"), F.col("text")), model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op1_nnpu_toxicity")
def op1(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    return _scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), out), toxicity, out)


@query("op7_compression_quality")
def op7(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    return _scored(docs, compression.fit(docs, table(spark, sf_dir, "labels"), out), compression, out)


@query("op2_quotation_linking", r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, i AS line_no, l AS line, coalesce(length(replace(replace(regexp_extract(l, '^([ \t]*>)+'), ' ', ''), chr(9), '')), 0) AS level,
         trim(regexp_replace(lower(regexp_replace(l, '^([ \t]*>)+', '')), '[ \t\r\f]+', ' ', 'g')) AS norm
  FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations)),
own AS (SELECT DISTINCT conv_id, turn, norm FROM lines WHERE level = 0 AND norm <> ''),
near AS (SELECT q.conv_id, q.turn, q.line_no, q.level, q.norm, max(o.turn) AS src
         FROM lines q LEFT JOIN own o ON o.conv_id = q.conv_id AND o.norm = q.norm AND o.turn < q.turn
         WHERE q.level > 0 AND q.norm <> '' GROUP BY ALL),
firsts AS (SELECT norm, min(conv_id) AS fc FROM own GROUP BY norm),
linked AS (SELECT n.conv_id, n.turn, count(*) FILTER (n.src IS NOT NULL OR f.fc <> n.conv_id) AS n
           FROM near n LEFT JOIN firsts f USING (norm) GROUP BY ALL),
low AS (SELECT conv_id, turn, min(level) AS lv FROM near WHERE src IS NOT NULL GROUP BY ALL),
votes AS (SELECT conv_id, turn, src, count(*) AS n FROM near JOIN low USING (conv_id, turn) WHERE level = lv AND src IS NOT NULL GROUP BY ALL),
parent AS (SELECT conv_id, turn, arg_max(src, n * 1000000 + src) AS quoted FROM votes GROUP BY ALL),
up AS (SELECT k.conv_id, k.turn, coalesce(p.quoted, b.turn) AS reply_to
       FROM (SELECT DISTINCT conv_id, turn FROM conversations) k LEFT JOIN parent p USING (conv_id, turn)
       LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) b ON b.conv_id = k.conv_id AND b.turn = k.turn - 1),
chain AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM up WHERE reply_to IS NULL
          UNION ALL SELECT u.conv_id, u.turn, c.thread, c.depth + 1 FROM up u JOIN chain c ON c.conv_id = u.conv_id AND c.turn = u.reply_to),
body AS (SELECT conv_id, turn, role, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (lv = 0), '') AS text,
                count(*) FILTER (lv > 0) AS n_quoted, max(lv) AS max_level
         FROM (SELECT r, conv_id, turn, role, l, i, coalesce(length(replace(replace(regexp_extract(l, '^([ \t]*>)+'), ' ', ''), chr(9), '')), 0) AS lv
               FROM (SELECT row_number() OVER () AS r, conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
                            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations))
         GROUP BY r, conv_id, turn, role)
SELECT b.conv_id, c.thread, b.turn, CAST(c.depth AS BIGINT) AS depth, coalesce(u.reply_to, -1) AS reply_to, b.role, b.text, b.n_quoted,
       coalesce(l.n, 0) AS n_linked, CAST(b.max_level AS BIGINT) AS max_level
FROM body b JOIN chain c USING (conv_id, turn) JOIN up u USING (conv_id, turn) LEFT JOIN linked l USING (conv_id, turn)""")
def op2(spark, sf_dir):
    # reply_to -1: the first message of its thread
    return quotes.conversations(table(spark, sf_dir, "conversations")).fillna(-1, ["reply_to"])


@query("op3_directly_addressable_codes")
def op3(spark, sf_dir):
    files = dac.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "words", end_id=1)
    return dac.read(files).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                                  F.crc32("ids").alias("ids_crc32"))


@query("op4_trie_token_counts")
def op4(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op5_coordinate_minhash", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS r FROM n UNION SELECT u.b, r.r FROM r JOIN u ON u.a = r.v),
c AS (SELECT v, min(r) AS c FROM r GROUP BY v)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN c ON c.v = doc_id""")
def op5(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_merkle_fingerprint", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n_chars,
             coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
      FROM d WINDOW w AS (ORDER BY doc_id DESC)),
e AS (SELECT doc_id, text, n_chars, next_text,
             substr(text, 1, n_chars - n_chars // 3) || substr(next_text, 1, n_chars // 3) AS edited FROM n),
h AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]+ *){1,4}| +'), lambda x: md5(x)))) AS a,
  list_transform(string_split(edited, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]+ *){1,4}| +'), lambda x: md5(x)))) AS b,
  list_transform(string_split(next_text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]+ *){1,4}| +'), lambda x: md5(x)))) AS c FROM e),
k AS (SELECT doc_id, n_chars, edited_sha256,
  md5(list_aggregate(list_transform(a, lambda s: md5(coalesce(list_aggregate(list_transform(s, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))), 'string_agg', ''), ''))), 'string_agg', '')) AS ra,
  md5(list_aggregate(list_transform(b, lambda s: md5(coalesce(list_aggregate(list_transform(s, lambda p: md5(coalesce(list_aggregate(p, 'string_agg', ''), ''))), 'string_agg', ''), ''))), 'string_agg', '')) AS rb,
  list_sort(list_distinct(list_transform(flatten(flatten(a)), lambda x: x[1:8])))[1:64] AS sa,
  list_sort(list_distinct(list_transform(flatten(flatten(b)), lambda x: x[1:8])))[1:64] AS sb,
  list_sort(list_distinct(list_transform(flatten(flatten(c)), lambda x: x[1:8])))[1:64] AS sc FROM h),
m AS (SELECT *, list_sort(list_distinct(list_concat(sa, sb)))[1:64] AS mb, list_sort(list_distinct(list_concat(sa, sc)))[1:64] AS mc FROM k)
SELECT doc_id, n_chars, edited_sha256, ra || ':' || coalesce(list_aggregate(sa, 'string_agg', ''), '') AS fingerprint,
  rb || ':' || coalesce(list_aggregate(sb, 'string_agg', ''), '') AS edited_fingerprint,
  CASE WHEN len(mb) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(mb, list_intersect(sa, sb)))::DOUBLE / len(mb) END AS near_edited,
  CASE WHEN len(mc) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(mc, list_intersect(sa, sc)))::DOUBLE / len(mc) END AS near_next
FROM m""")
def op6(spark, sf_dir):
    return merkle.edited_pairs(table(spark, sf_dir, "documents"))


@query("op8_exact_complement_packing")
def op8(spark, sf_dir):
    made = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "bytes", end_id=2)
    # the ids stay in the written table, only their digest goes on
    digest = made.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.assign(digest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_entropy_mixing")
def op9(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_term_at_a_time_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS t
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.t), len(c.t)) + 1), lambda i: q.t[i] * c.t[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rk <= 20""")
def op10(spark, sf_dir):
    vectors = topk.quantise(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(20)) == 0), 20)


@query("op11_block_max_maxscore", r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
d AS (SELECT r, doc_id, w, len(w) AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
      FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
w AS (SELECT item_id, term, c * CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), s),
m AS (SELECT item_id, p.r, any_value(p.doc_id) AS doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM w JOIN p USING (term), s GROUP BY item_id, p.r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM m WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20""")
def op11(spark, sf_dir):
    return blockmax.search(blockmax.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 20)


@query("op12_repeated_capture_fim", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
             array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
                        ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""")
def op12(spark, sf_dir):
    made = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@query("op13_byte_gru_language")
def op13(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs, out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
