"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, collocations, ctph, hard_negatives, katz, language, mixing, quality, simhash, token_counts, warc
from .common import fold_of, table

Query = Callable[[SparkSession, str], DataFrame]

#: Folds that are held out: number of folds, and the one left out of the fit.
LANGUAGE_FOLD, SCORING_FOLD, QUALITY_FOLD = (5, 0), (5, 1), (4, 2)
#: Scores of this and more count as good quality.
GOOD = 0.7


def vocabulary() -> tuple[str, str]:
    """Rank file and splitting pattern of the public vocabulary the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    folds, left_out = LANGUAGE_FOLD
    held_out = fold_of(F.col("doc_id"), folds) == left_out
    model = language.train(documents.where(~held_out))
    return documents.select(
        "doc_id", held_out.alias("held_out"), language.language_of(documents, model).alias("found")
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op4_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.copies(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Conversation -1, both of whose texts are made of control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    # An empty role and text keep their field: a record without any has no turn.
    record = F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    records = rows.unionByName(added).select("conv_id", "turn", record.alias("record"))
    return chat.read_back(chat.pieces(records, ["conv_id", "turn"]), "conv_id", ["turn"])


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds, left_out = SCORING_FOLD
    training = fold_of(F.col("doc_id"), folds) != left_out
    return katz.score(table(spark, sf_dir, "documents"), training).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.neighbours(table(spark, sf_dir, "documents"))


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    folds, left_out = QUALITY_FOLD
    held_out = fold_of(F.col("doc_id"), folds) == left_out
    model = quality.train(documents, table(spark, sf_dir, "labels").where(~held_out))
    return documents.select(
        "doc_id", held_out.alias("held_out"), quality.quality_of(documents, model).alias("score")
    ).select("*", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh row changes its label first.

    Nulls, ties, repeated rows, empty tables and extra columns: see ``hard_negatives``.
    """
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", relabelled.alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, ties, repeated rows, empty tables and extra columns: see ``collocations``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from a cache that starts empty: a run's work does not depend on
    earlier runs. Nulls, repeated rows, empty tables and extra columns: see ``counted``."""
    import public_tokenizers

    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_warc": op2_warc,
        "op3_language_id": op3_language_id,
        "op4_hilbert_neighbours": op4_hilbert_neighbours,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_mixing": op6_mixing,
        "op7_chat": op7_chat,
        "op8_katz": op8_katz,
        "op9_ctph": op9_ctph,
        "op10_nbsvm_quality": op10_nbsvm_quality,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_collocations": op12_collocations,
        "op13_token_counts": op13_token_counts,
    }


#: Targets by one pass along the sources in order of limit per weight: those at their
#: limit are the first ones, and the next is at its limit if its part of what they leave is above it.
MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sized GROUP BY source
), whole AS (
  SELECT CAST(sum(source_size) AS BIGINT) AS words, CAST(sum(weight) AS BIGINT) AS weights FROM totals
), in_line AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER before, 0) AS BIGINT) AS sizes_before,
         CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weights_before
  FROM totals
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT in_line.*, weight * (3 * words - 4 * sizes_before) > 2 * source_size * 2 * (weights - weights_before) AS at_limit
  FROM in_line, whole
), level AS (
  SELECT 3 * words - 4 * CAST(coalesce(sum(source_size) FILTER (at_limit), 0) AS BIGINT) AS over,
         2 * (weights - CAST(coalesce(sum(weight) FILTER (at_limit), 0) AS BIGINT)) AS under
  FROM judged, whole GROUP BY words, weights
), targets AS (
  SELECT source, source_size,
         CASE WHEN at_limit THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(weight * over AS DOUBLE) / CAST(under AS DOUBLE) END AS target,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift
  FROM judged, level
), placed AS (
  SELECT doc_id, size, source_size, target, shift,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
         row_number() OVER (PARTITION BY sized.source ORDER BY size, doc_id NULLS FIRST) AS place
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(floor(expected * place + shift) - floor(expected * (place - 1) + shift) AS BIGINT) * size AS taken
FROM placed
"""


#: Base 32 of a SHA-1: five hexadecimal digits give four letters.
WARC_SQL = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), latest AS (SELECT digest, max(page_id) AS last FROM hashed GROUP BY digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         ((CAST('0x' || substr(digest, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31) + 1 AS INT), 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM hashed JOIN latest USING (digest)
"""

CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, 12 + length(role) + 1 + 11 + length(regexp_replace(text,
           '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|/INST\]|INST\]|/s>|s>)', '\1\\\2\3', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""


#: Every score by brute force. Shorter vectors end in zeros.
HARD_NEGATIVES_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS codes
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT * FROM usable WHERE id % 100 = 0),
scored AS (
  SELECT a.id AS anchor_id, a.codes AS anchor_codes, a.label AS anchor_label, r.id, r.codes, r.label,
         CAST(coalesce(list_sum(list_transform(range(1, least(len(a.codes), len(r.codes)) + 1), lambda i: a.codes[i] * r.codes[i])), 0) AS BIGINT) AS score
  FROM anchors a, usable r
), positives AS (
  SELECT * FROM scored WHERE label = anchor_label AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_codes, anchor_label ORDER BY score DESC, id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, n.id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.anchor_codes, p.anchor_label, p.id, p.codes ORDER BY n.score DESC, n.id) AS rank
  FROM positives p JOIN scored n
    ON n.anchor_id = p.anchor_id AND n.anchor_codes = p.anchor_codes AND n.anchor_label = p.anchor_label
   AND n.label <> p.anchor_label AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 10
"""

#: Every phrase of up to four words at every place; all products are 128 bits wide.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(list_transform(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS words
        FROM documents) AS cut
), placed AS (
  SELECT lang, w AS w1, lead(w) OVER following AS w2, lead(w, 2) OVER following AS w3, lead(w, 3) OVER following AS w4
  FROM (SELECT piece, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces) AS tokens
  WINDOW following AS (PARTITION BY piece ORDER BY i)
), grams AS (
  SELECT lang, [w1] AS gram, 1 AS m FROM placed
  UNION ALL SELECT lang, [w1, w2], 2 FROM placed WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3], 3 FROM placed WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w1, w2, w3, w4], 4 FROM placed WHERE w4 IS NOT NULL
), f AS (
  SELECT lang, gram, m, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY lang, gram, m
), sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, gram, m, f AS a FROM f WHERE m >= 2 AND f >= 30),
cuts AS (SELECT lang, gram, m, a, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.gram, c.a, l.f AS l, r.f AS r, (2000000 * c.a) // (l.f + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.gram = c.gram[1:c.k] JOIN f r ON r.lang = c.lang AND r.gram = c.gram[c.k + 1:c.m]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.gram ORDER BY score, c.k) = 1
), parts AS (
  SELECT lang, gram[i:i + s - 1] AS gram, max(a) AS longer
  FROM (SELECT lang, gram, a, m, unnest(range(1, m)) AS i FROM candidates) AS starts, (VALUES (2), (3)) AS lengths(s)
  WHERE s < m AND i + s - 1 <= m GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM parts p WHERE p.lang = s.lang AND p.gram = s.gram AND 100 * p.longer >= 80 * s.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(gram, ' ')) AS rank,
       array_to_string(gram, ' ') AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM kept JOIN sizes USING (lang)
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": WARC_SQL, "op6_mixing": MIXING_SQL, "op7_chat": CHAT_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_collocations": COLLOCATIONS_SQL}
