"""The training-data queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylane.catalog import Catalog
from quarrylane.llm import bpe, chat, embedding_dedup, hard_negatives, langid, licenses, lm, merkle, mixing, quality, simhash, tokencount, topk
from quarrylane.session import table

CATALOG = Catalog()


#: Target shares of the mix; the other sources share the rest.
MIX_WEIGHTS = {"src0": 0.2, "src1": 0.1, "src2": 0.1}

OP1_SQL = """
WITH c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, CASE s WHEN 'src0' THEN 0.2::DOUBLE WHEN 'src1' THEN 0.1::DOUBLE WHEN 'src2' THEN 0.1::DOUBLE END AS target FROM c),
z AS (SELECT *, CAST(CASE WHEN target IS NULL THEN round(sqrt(n), 9) ELSE 0 END AS DECIMAL(38, 9)) AS size FROM w),
t AS (SELECT CAST(sum(n) AS DOUBLE) AS all_n, CAST(sum(size) AS DOUBLE) AS all_size FROM z),
r AS (SELECT s, coalesce(target, (1 - (0.2::DOUBLE + 0.1::DOUBLE + 0.1::DOUBLE)) * size::DOUBLE / all_size) * all_n / n AS rate FROM z, t),
k AS (SELECT s, rate, u.k AS k, exp(-rate + u.k * ln(rate) - lgamma(u.k + 1)) AS p FROM r, unnest(range(0, 80)) AS u(k)),
f AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM k),
d AS (SELECT *, CAST('0x' || substr(md5('copies20240|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|1'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM f WHERE f.s = coalesce(d.source, '') AND f.cdf <= d.u) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, c.i AS copy_no, md5('order20240|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || c.i) AS mix_key
FROM m, unnest(range(0, n)) AS c(i)
"""


@CATALOG.query("op1_mixing", OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


@CATALOG.query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e,
         coalesce(len([x FOR x IN CAST(embedding AS DOUBLE[]) IF x IS NULL OR NOT isfinite(x)]) = 0
           AND len([x FOR x IN CAST(embedding AS DOUBLE[]) IF x <> 0]) > 0, false) AS ok
  FROM embeddings),
l AS (SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.rid <> b.rid AND a.ok AND b.ok AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT rid, rid FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON r.b = v.rid GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id IS NOT DISTINCT FROM c.component_id AS kept
FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


@CATALOG.query("op5_embedding_dedup", OP5_SQL)
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def byte_bpe() -> bpe.Vocabulary:
    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@CATALOG.query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), byte_bpe())


@CATALOG.query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


OP8_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos,
         replace(translate(coalesce(role, 'unknown'), chr(13) || chr(10), '  '), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
  UNION ALL SELECT conv_id, NULL FROM t GROUP BY conv_id HAVING bool_and(speaker = 'system')),
r AS (SELECT t.conv_id, perspective, pos // 64 AS segment, pos, coalesce(speaker = perspective, false) AS mine, text,
    '<|im_start|>' || CASE WHEN coalesce(speaker = perspective, false) THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
c AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM r),
a AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM c)
SELECT conv_id, perspective, segment, count(*) AS n_turns, string_agg(piece, '' ORDER BY pos) AS text,
       coalesce(string_agg((begin_at + length(head)) || '-' || (begin_at + length(piece) - 1), ',' ORDER BY pos) FILTER (mine), '') AS mask
FROM a GROUP BY conv_id, perspective, segment
"""


@CATALOG.query("op8_chat_perspectives", OP8_SQL)
def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's rows, with the mask as text."""
    span = lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))
    return chat.perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(F.transform("mask", span), ","))


@CATALOG.query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces are a public vocabulary's; their scores, which it doesn't have, follow Zipf's law in their order."""
    model = tokencount.Unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.token_counts(table(spark, sf_dir, "documents"), model)


@CATALOG.query("op10_simhash_dedup")
def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents),
g AS (SELECT rid, u.i AS i, array_to_string(ws[u.i:u.i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
d AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM d WHERE c > 1),
s AS (SELECT rid, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS n FROM r GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(s.n, 0) AS n_repeat_words
  FROM w LEFT JOIN s USING (rid)),
b AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed
FROM b
"""


@CATALOG.query("op3_lm_scores")
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_passages=True)


@CATALOG.query("op4_quality_rules", OP4_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.CURRENT).alias("kept"),
        "failed",
    )


_MASKS = ", ".join(f"('{p.version}', {p.mask}, '{r.name}', {1 << r.bit})" for p in quality.POLICIES for r in quality.RULES if r.name in p.rules)


@CATALOG.query(
    "quality_ablations",
    f"""SELECT policy, rule, count(*) FILTER (failed & mask & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only, count(*) FILTER (failed & mask <> 0) AS n_rejected
    FROM ({OP4_SQL}) AS ledger, (VALUES {_MASKS}) AS m(policy, mask, rule, bit) GROUP BY policy, rule""",
)
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule adds to each policy."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")))


_INTEGERS = """coalesce(embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0, false)"""

OP11_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CAST([floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS DOUBLE[]) AS e FROM embeddings WHERE {_INTEGERS}),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, b.rid AS other, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@CATALOG.query("op11_topk_search", OP11_SQL)
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, coalesce('s' || source, '-') AS src,
         xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 5 = 0 AS tampered,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
f AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS front FROM d),
l AS (
  SELECT rid, doc_id, source, src, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN tampered THEN sha256(front || coalesce(strlen(low) || ':' || low, '-')) END AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY src) AS size FROM l),
t AS (
  SELECT src, 0 AS level, i, size, leaf AS node FROM p
  UNION ALL
  SELECT src, level + 1, i // 16, (size + 15) // 16, sha256(string_agg(node, '' ORDER BY i)) FROM t WHERE size > 1 GROUP BY src, level, i // 16, size),
s AS (
  SELECT t.src, t.node AS subroot, row_number() OVER (ORDER BY o.source NULLS FIRST) - 1 AS k, count(*) OVER () AS n
  FROM t JOIN (SELECT DISTINCT src, source FROM p) o ON t.src = o.src WHERE t.size = 1),
u AS (
  SELECT 0 AS level, k AS i, n AS size, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, i // 16, (size + 15) // 16, sha256(string_agg(node, '' ORDER BY i)) FROM u WHERE size > 1 GROUP BY level, i // 16, size),
h AS (
  SELECT p.rid, t.level AS level, coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i < p.i // CAST(pow(16, t.level) AS BIGINT)), '') AS a,
         coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i > p.i // CAST(pow(16, t.level) AS BIGINT)), '') AS b
  FROM p JOIN t ON p.src = t.src AND t.size > 1 AND t.i // 16 = p.i // CAST(pow(16, t.level + 1) AS BIGINT) GROUP BY p.rid, t.level
  UNION ALL
  SELECT p.rid, 100 + u.level, coalesce(string_agg(u.node, '' ORDER BY u.i) FILTER (u.i < s.k // CAST(pow(16, u.level) AS BIGINT)), ''),
         coalesce(string_agg(u.node, '' ORDER BY u.i) FILTER (u.i > s.k // CAST(pow(16, u.level) AS BIGINT)), '')
  FROM p JOIN s ON p.src = s.src JOIN u ON u.size > 1 AND u.i // 16 = s.k // CAST(pow(16, u.level + 1) AS BIGINT) GROUP BY p.rid, u.level),
w AS (SELECT rid, list(a || '|' || b ORDER BY level) AS path, string_agg(a || b, '' ORDER BY level) AS siblings FROM h GROUP BY rid),
z AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT node FROM u WHERE size = 1) AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(p.other, p.leaf), coalesce(w.path, [])), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM p JOIN s ON p.src = s.src LEFT JOIN w ON p.rid = w.rid)
SELECT *, folded_root = root AS verified FROM z
"""


@CATALOG.query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         CAST([floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS DOUBLE[]) AS e
  FROM embeddings WHERE label IS NOT NULL AND {_INTEGERS}),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST, other) <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST, s.other) AS rank
  FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


@CATALOG.query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries():
    import corpus_pipeline

    return dict(CATALOG.queries) | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    import corpus_pipeline

    return dict(CATALOG.sql) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
