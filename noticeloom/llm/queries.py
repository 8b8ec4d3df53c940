"""The training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, compaction, image_copies, language_id, lm_scoring, mixing, packing, quality, resampling, shingle_join, token_store, toxicity, vector_dedup
from .shared import crc32_of_id, shared_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, its rows dealt to all cores where its files make fewer tasks than there are cores."""
    read, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return read if read.rdd.getNumPartitions() >= cores else read.repartition(cores)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_store.read_store(token_store.write_store(docs, WORD_BPE))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # A row without an id has no remainder: it trains like the others.
    scored = lm_scoring.score_texts(docs, F.coalesce(crc32_of_id(F.col("doc_id")) % 5 != 1, F.lit(True)))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = crc32_of_id(F.col("doc_id")) % 4 == 2
    model = language_id.train(docs.where(~held))
    return language_id.predict(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(crc32_of_id(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as small shards, are compacted, and are read back by the manifest."""
    root = f"{shared_dir(spark)}/noticeloom/{uuid.uuid4().hex}/sharded"
    compaction.append(spark.read.parquet(f"{sf_dir}/documents.parquet"), root)
    compaction.compact(spark, root)
    rows = compaction.read(spark, root)
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source", "n_chars")


OP5_SQL = "SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents"


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.join(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no media column; every vector is drawn as a picture first."""
    return image_copies.copies(image_copies.pictures(_table(spark, sf_dir, "embeddings")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(crc32_of_id(F.col("doc_id")) % 5 != 0))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs, labels.select("doc_id", mixing.domain_of(labels).alias("domain")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(crc32_of_id(F.col("doc_id")) % 5 != 0))
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out")
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", held, "score", "predicted")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing, "op2_lm_scoring": op2_lm_scoring, "op3_language_id": op3_language_id, "op4_token_store": op4_token_store, "op5_sharding": op5_sharding, "op6_shingle_join": op6_shingle_join, "op7_vector_dedup": op7_vector_dedup, "op8_image_copies": op8_image_copies, "op9_toxicity": op9_toxicity, "op10_source_mixing": op10_source_mixing, "op11_token_alignment": op11_token_alignment, "op12_quality": op12_quality, "op13_importance_resampling": op13_importance_resampling}
ORACLES: dict[str, str] = {"op5_sharding": OP5_SQL, "op13_importance_resampling": resampling.SQL}
