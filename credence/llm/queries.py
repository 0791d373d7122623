"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, divergence, id_files, jaccard, language, line_dedup, media, merkle, mixing, sharding, token_counts, warc
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=16)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    digest = [F.octet_length("clean_text").cast("long").alias("clean_bytes"), F.crc32("clean_text").alias("clean_crc32")]
    return out.select("doc_id", "n_lines", "n_removed", *digest)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.id_files(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_with_tampering(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), q AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM q
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM m
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(md5(text), '') AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place FROM s
), w AS (
  SELECT *, ([5, 2, 1])[((place - 1) % 3) + 1]::BIGINT AS weight, source_size * 3 AS cap FROM n
), r AS (
  SELECT *, cap / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - (sum(cap) OVER (ORDER BY ratio, place ROWS UNBOUNDED PRECEDING) - cap))::DOUBLE
    / (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r
), f AS (
  SELECT *, (SELECT min_by(level, (ratio, place)) FROM l WHERE level <= ratio) AS lv FROM l
), t AS (
  SELECT source, source_size, CASE WHEN ratio <= lv THEN cap::DOUBLE ELSE weight * lv END AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS sure FROM t
), o AS (
  SELECT *, target - sure * source_size AS owed FROM p
), g AS (
  SELECT source, length(bin(size))::DOUBLE AS odds, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL
), h AS (
  SELECT g.source, odds, (o.owed - (sum(words) OVER (PARTITION BY g.source ORDER BY odds DESC ROWS UNBOUNDED PRECEDING) - words)::DOUBLE)
    / sum(words * odds) OVER (PARTITION BY g.source ORDER BY odds ROWS UNBOUNDED PRECEDING) AS factor
  FROM g JOIN o ON g.source IS NOT DISTINCT FROM o.source
), x AS (
  SELECT source, max_by(factor, odds) AS factor FROM h WHERE factor * odds <= 1 GROUP BY source
), u AS (
  SELECT d.*, o.source_size, o.target, o.sure, o.owed,
    CASE WHEN size > 0 THEN least(1.0::DOUBLE, coalesce(x.factor, 0) * length(bin(size))::DOUBLE) ELSE 0 END AS p,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || digest || '|mix'), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
), k AS (
  SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / ((u * (1 - p)) + (p * (1 - u))) ELSE 1 END AS ord FROM u
), c AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p > 0 DESC, ord, doc_id, size, u ROWS UNBOUNDED PRECEDING)::BIGINT AS reached FROM k
), e AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE sure + CASE WHEN p > 0 AND (reached <= owed OR (owed - (reached - size) > 0 AND reached - owed <= owed - (reached - size))) THEN 1 ELSE 0 END END AS copies FROM c
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM e
"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_media": op5_media,
    "op6_language": op6_language,
    "op7_id_files": op7_id_files,
    "op8_warc": op8_warc,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_decontamination": op10_decontamination,
    "op11_divergence": op11_divergence,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle": op13_merkle,
    "pipeline": pipeline,
}
ORACLES = {"op4_mixing": OP4_SQL, "op8_warc": OP8_SQL, "op11_divergence": divergence.SQL, "op13_merkle": merkle.manifest_sql()}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
