"""One query per operator, over its whole table, with production parameters; SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulane.llm import (
    byte_bpe,
    chat,
    fingerprint,
    jaccard_join,
    kmeans_tree,
    language,
    mixing,
    prefix_trie,
    quality,
    suffix_dedup,
    token_alignment,
    token_counts,
    toxicity,
)
from tabulane.llm.common import held_out, load
from tabulane.session import cut_lineage

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    profiles = language.learn_profiles(docs.filter(~held_out()))
    found = language.detect_language(docs, profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(load(spark, folder, "documents")).drop("tag")


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans_tree.nearest_neighbours(load(spark, folder, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeat_digests(load(spark, folder, "documents"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, folder, "documents"), VOCABULARY)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    stats = cut_lineage(quality.document_statistics(load(spark, folder, "documents")))
    model = quality.learn_quality(stats, load(spark, folder, "labels"), ~held_out())
    scored = quality.score_statistics(stats, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(load(spark, folder, "documents"))


def op8_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_edits(load(spark, folder, "documents"))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.token_digests(load(spark, folder, "documents"), VOCABULARY, public_tokenizers.PATTERN)


CONTROL = "<|im_end|><|im_start|>assistant ok"


def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text")
    )
    turns = given.unionByName(own).withColumn("parts", chat.text_part(F.col("text")))
    return chat.chat_digests(chat.format_chats(turns))


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    model, _ = toxicity.learn_toxicity(docs, load(spark, folder, "labels"), ~held_out())
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.ACCEPT).cast("int").alias("predicted"))


A_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
B_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.alignment_digests(load(spark, folder, "documents"), A_VOCABULARY, B_VOCABULARY)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(load(spark, folder, "conversations"))


_ESCAPED = "length({0}) + length({0}) - length(replace({0}, chr(92), '')) + length({0}) - length(replace({0}, '<', ''))"

OP10_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + {_ESCAPED.format('role')} + length(role) - length(replace(role, chr(10), ''))
    + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP2_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS source_key,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')), 0) AS BIGINT) AS n_tokens, md5(text) AS tag FROM documents
), src AS (SELECT source_key, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY 1 HAVING sum(n_tokens) > 0),
p AS (SELECT source_key, tokens, tokens / CAST((SELECT sum(tokens) FROM src) AS DOUBLE) AS share FROM src),
ends AS (SELECT ln(CAST(count(*) AS DOUBLE)) AS flat, -sum(share * ln(share)) AS natural_ FROM p),
step(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, mid, ln(z) - mid * s / z <= natural_ + 0.5 * (flat - natural_) AND m / z <= 1.5 AS good FROM (
      SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, sum(pow(share, (lo + hi) / 2)) AS z,
        sum(pow(share, (lo + hi) / 2) * ln(share)) AS s, max(pow(share, (lo + hi) / 2) / share) AS m
      FROM step, p WHERE i < {mixing.STEPS} GROUP BY i
    ), ends
  )
), a AS (SELECT hi FROM step WHERE i = {mixing.STEPS}),
w AS (SELECT source_key, tokens, pow(share, hi) / (SELECT sum(pow(share, hi)) FROM p, a) AS weight FROM p, a),
b AS (SELECT source_key, tokens, CAST(floor(weight * (SELECT sum(tokens) FROM src)) AS BIGINT) AS budget FROM w),
d AS (SELECT source_key, budget // tokens AS whole, budget % tokens AS rest FROM b),
used AS (
  SELECT doc_id, source, source_key, n_tokens, tag, rest, whole, unnest(range(whole + 1)) AS pass FROM rows_ JOIN d USING (source_key)
), keyed AS (SELECT *, md5('mix|' || pass || '|' || source_key || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key FROM used),
cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source_key, pass ORDER BY order_key, doc_id, tag ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, source, CAST(pass AS BIGINT) AS pass, n_tokens, order_key FROM cum WHERE pass < whole OR upto <= rest
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 200) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS p FROM d)),
k AS (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(s) ORDER BY doc_id, p) AS r FROM w),
again AS (SELECT doc_id, p FROM k WHERE r > 1),
runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
    SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
      SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM again))
  GROUP BY doc_id, run
), gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before_ FROM runs),
cut AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, CAST(2 * before_ + 1 AS BIGINT), CAST(2 * (a - before_) AS BIGINT)), '' ORDER BY a) AS kept, max(b) AS ends
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(ends, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
sig AS (SELECT doc_id, md5(string_agg(s, '|' ORDER BY s)) AS sig FROM sh GROUP BY 1),
rep AS (SELECT sig, min(doc_id) AS rep FROM sig GROUP BY 1),
own AS (SELECT * FROM sh WHERE doc_id IN (SELECT rep FROM rep)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 75 * (na.n + nb.n - both_)
  UNION SELECT rep, doc_id FROM sig JOIN rep USING (sig)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(start_, node) AS (SELECT doc_id, doc_id FROM n UNION SELECT start_, b FROM reach JOIN edges ON a = node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT start_ AS doc_id, min(node) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""

OP13_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT conv_id, sha256(role || chr(10) || sha256(text)) AS id, strlen(text) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM t
), crc(conv_id, step, c) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(4294967295 AS BIGINT) FROM k
  UNION ALL
  SELECT conv_id, step + 1, CASE WHEN step % 9 = 0 THEN xor(c, ascii(substr(CAST(conv_id AS VARCHAR), step // 9 + 1, 1))) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM crc WHERE step < 9 * length(CAST(conv_id AS VARCHAR))
), h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE step = 9 * length(CAST(conv_id AS VARCHAR))),
built AS (
  SELECT h.conv_id, b.i, b.id, b.bytes FROM h JOIN k b ON b.conv_id = h.conv_id - h.conv_id % 5 AND b.i <= h.h
  UNION ALL SELECT h.conv_id, o.i, o.id, o.bytes FROM h JOIN k o ON o.conv_id = h.conv_id AND o.i > h.h
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth FROM built),
path(conv_id, depth, key, bytes) AS (
  SELECT conv_id, CAST(0 AS BIGINT), sha256(''), CAST(0 AS BIGINT) FROM h
  UNION ALL
  SELECT p.conv_id, n.depth, sha256(p.key || n.id), n.bytes FROM path p JOIN numbered n ON n.conv_id = p.conv_id AND n.depth = p.depth + 1
), ends AS (SELECT conv_id, max(depth) AS n FROM path GROUP BY 1),
node AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, count(*) FILTER (n = depth) AS n_ends,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM path JOIN ends USING (conv_id) GROUP BY depth, key
), up AS (  -- each node under its own key and each of its ancestors'
  SELECT p.depth, p.key, n.depth AS below, n.n_convs = n.n_ends AS leaf, (n.n_convs - 1) * n.bytes AS saved
  FROM node n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth
), total AS (
  SELECT depth, key, CAST(count(*) FILTER (below = depth + 1) AS BIGINT) AS n_children, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY depth, key
)
SELECT node.conv_id, node.depth, above.conv_id AS parent_conv_id, node.n_convs, n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN total ON total.depth = node.depth AND total.key = node.key LEFT JOIN path p ON p.conv_id = node.conv_id AND p.depth = node.depth - 1
LEFT JOIN node above ON above.depth = p.depth AND above.key = p.key
"""

CHECKS = {
    "op1_language": (op1_language, None),
    "op2_mixing": (op2_mixing, OP2_SQL),
    "op3_neighbours": (op3_neighbours, None),
    "op4_suffix_dedup": (op4_suffix_dedup, OP4_SQL),
    "op5_token_counts": (op5_token_counts, None),
    "op6_quality": (op6_quality, None),
    "op7_jaccard": (op7_jaccard, OP7_SQL),
    "op8_fingerprint": (op8_fingerprint, None),
    "op9_byte_bpe": (op9_byte_bpe, None),
    "op10_chat": (op10_chat, OP10_SQL),
    "op11_toxicity": (op11_toxicity, None),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
