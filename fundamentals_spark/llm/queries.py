"""The registered queries of the operators and of the pipeline, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from fundamentals_spark.llm import bpe, collocations, license_scan, mixing, neardup, privacy, quality, repeats, secret_scan, spelling, sql, topk, toxicity, url_filter
from fundamentals_spark.llm.common import read


VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(documents, toxicity.train_toxicity(documents, read(spark, sf_dir, "labels")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans and all spans as text."""
    base = "filter(spans, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in kinds))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(privacy.find_personal_data(read(spark, sf_dir, "documents")), privacy.BASE)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return _digest(secret_scan.scan_secrets(documents, secret_scan.train_secrets(documents)), secret_scan.KINDS)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents"))
    spans = F.expr("array_join(transform(spans, s -> concat_ws(':', s.label, s.start, s.end)), ',')")
    return found.withColumn("n_spans", F.size("spans").cast("long")).withColumn("spans", spans)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(read(spark, sf_dir, "documents")))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read(spark, sf_dir, "pages"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_repeats": op6_repeats,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_jaccard": op9_jaccard,
    "op10_licenses": op10_licenses,
    "op11_spelling": op11_spelling,
    "op12_urls": op12_urls,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL: dict[str, str] = {
    "op4_pii": sql.PII,
    "op6_repeats": sql.REPEATS,
    "op9_jaccard": sql.JACCARD,
    "op8_quality": sql.QUALITY,
    "op11_spelling": sql.SPELLING,
    "op13_phrases": sql.PHRASES,
    "op5_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
""",
}
