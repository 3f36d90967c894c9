"""From raw documents to tokens: quality rules, near duplicates, personal data, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next. All
but the last return the columns of ``documents``. Empty tables pass through; nulls are handled as each operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fundamentals_spark.llm import bpe, mixing, neardup, privacy, quality
from fundamentals_spark.llm.common import discard, fresh, materialize, read


def _repeated_ids(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    out, verdict = quality.with_quality(docs)
    return out.filter(F.col(f"{verdict}.kept")).drop(verdict)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, a repeated row once; a null id stays only without another in its class."""
    classes = neardup.near_duplicates(docs)
    gone = classes.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("gone_id")).distinct()
    name = fresh(docs, "gone_id")
    gone = gone.withColumnRenamed("gone_id", name)
    kept = docs.join(gone, docs["doc_id"].eqNullSafe(gone[name]), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if _repeated_ids(docs) else kept


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data in a text gives way to its kind in angle brackets; n_chars follows."""
    out, spans = privacy.with_spans(docs)
    out = out.withColumn("text", privacy.redacted("text", spans)).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in whole copies that meet the words its source takes to its longest document."""
    taken = mixing.apply_mix(docs, rounding="even").select("doc_id", "size", "copies").hint("merge")  # a row for each document: one plan at every size
    names = {k: fresh(docs, f"mix_{k}") for k in ("id", "size", "copies", "row", "own_row", "own_size", "copy")}
    taken = taken.select(F.col("doc_id").alias(names["id"]), F.col("size").alias(names["size"]), F.col("copies").alias(names["copies"]))
    left, on = docs, docs["doc_id"].eqNullSafe(taken[names["id"]])
    if _repeated_ids(docs):  # rows of one id and size take its copies one by one
        left = docs.withColumn(names["own_size"], F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long"))
        left = left.withColumn(names["own_row"], F.row_number().over(W.partitionBy("doc_id", names["own_size"]).orderBy("source", F.xxhash64("text"))))
        taken = taken.withColumn(names["row"], F.row_number().over(W.partitionBy(names["id"], names["size"]).orderBy(names["copies"])))
        on = left["doc_id"].eqNullSafe(taken[names["id"]]) & (left[names["own_size"]] == taken[names["size"]]) & (left[names["own_row"]] == taken[names["row"]])
    joined = left.join(taken, on).filter(F.col(names["copies"]) > 0)
    return joined.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("n_tokens", "ids"))


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", near_duplicate_stage), ("personal data", privacy_stage), ("mixing sources", mixing_stage), ("byte-level BPE", token_stage)]

#: SQL has neither the tokenizer nor the mix's permutations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not docs and hasattr(before, "scratch_path"):
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
