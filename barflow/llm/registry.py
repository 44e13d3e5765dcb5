"""Queries of the training-data operators, each over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embeddings, line_dedup, negatives, ngram_join, quality, repeats, secrets, sentencepiece_viterbi, spelling, token_files, warc
from .common import load


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(load(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


#: The conversation that the contract adds.
ADDED = """SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"""


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(chat.conversations(rows.unionByName(spark.sql(ADDED)))))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.encode(load(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.findings(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(token_files.write(load(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup(load(spark, sf_dir, "documents"))
    return done.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(load(spark, sf_dir, "pages")))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(load(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(load(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(load(spark, sf_dir, "documents"), noise=31)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(load(spark, sf_dir, "documents"))
    kept = (F.col("n_bytes") - F.octet_length("kept")).cast("bigint")
    return done.select("doc_id", "n_bytes", kept.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_secret_scan, op2_quality_classifier, op3_chat_formatting, op4_sentencepiece, op5_decontamination, op6_token_files,
        op7_ngram_join, op8_line_dedup, op9_warc, op10_embedding_near_dedup, op11_hard_negatives, op12_spelling_variants, op13_suffix_dedup, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": CHAT_SQL, "op7_ngram_join": JACCARD_SQL, "op10_embedding_near_dedup": COSINE_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_spelling_variants": VARIANTS_SQL}


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length('<s>[INST]  [/INST]</s>') AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

JACCARD_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, w AS w FROM (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\s+') IF x <> ''] AS w FROM documents)
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM tokens, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE c >= 0.8 * (a.n + b.n - c)
), reach AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT v, r FROM reach JOIN links ON u = node
), least AS (SELECT node, min(r) AS class_id FROM reach GROUP BY 1
), per AS (SELECT u, count(*) AS n_links FROM links GROUP BY 1
), copies AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS copy_id FROM tokens)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, copy_id, class_id = doc_id AS kept
FROM copies JOIN least ON node = doc_id LEFT JOIN per ON u = doc_id
"""

COSINE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (SELECT vec_id AS node, vec_id AS r FROM v UNION SELECT w, r FROM reach JOIN links ON u = node
), per AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM (SELECT node AS vec_id, min(r) AS component_id FROM reach GROUP BY 1) LEFT JOIN per ON u = vec_id
"""

NEGATIVES_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

VARIANTS_SQL = r"""
WITH RECURSIVE bits AS (  -- CRC-32, byte by byte: what eight shifts make of each byte
  SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(b)
), lut AS (SELECT list(c ORDER BY b) AS t FROM bits
), runs AS (
  SELECT doc_id, w, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents
  ) WHERE length(w) >= 7 GROUP BY ALL
), hashed AS (
  SELECT w, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(s)) + 1), lambda i: ('0x' || substr(hex(encode(s)), (2 * i - 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT w, k, doc_id || ':' || w AS s FROM runs), lut
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed
  ) WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), holes AS (  -- each word as it is, and with each of its code points gone: near words meet in one of these
  SELECT word, 0 AS i, word AS s FROM words
  UNION ALL SELECT word, i, left(word, i - 1) || substr(word, i + 1) FROM words, unnest(range(1, length(word) + 1)) AS t(i)
), near AS (
  SELECT DISTINCT a.word AS u, b.word AS v FROM holes a JOIN holes b ON a.s = b.s AND a.word <> b.word
  WHERE a.i = b.i OR (a.i = 0) <> (b.i = 0)
), best AS (
  SELECT u AS word, count(*) AS n_near, min((-n, v)) AS m FROM near JOIN words ON words.word = v GROUP BY u
), known AS (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -m[1] >= 10 * n THEN m[2] END AS form, CASE WHEN -m[1] >= 10 * n THEN -m[1] END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), way AS (
  SELECT word, word AS root, form AS next FROM known UNION ALL SELECT way.word, k.word, k.form FROM way JOIN known k ON k.word = way.next
)
SELECT k.word, n, n_near, form, form_n, root FROM known k JOIN way ON k.word = way.word WHERE way.next IS NULL
"""
