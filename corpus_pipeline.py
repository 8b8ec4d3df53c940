"""The corpus pipeline: toxicity, language, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last
return the columns of documents.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm import language_id, mixing, packing, shingle_join, toxicity
from noticeloom.llm.queries import WORD_BPE
from noticeloom.llm.shared import staged

#: Least score of the predicted language; `und` is rejected whatever its score.
LANGUAGE_SCORE = 0.4
#: Shares of tokens by labelled quality among documents that are not toxic.
QUALITY_TARGETS = {"q1": 0.95, "q0": 0.05}

#: From this on, what the mixing misses of a target is told in the log.
TOLD = 0.01
#: Names of a stage's own columns, which no table has.
OWN = ("_noticeloom_first_", "_noticeloom_second_")

# No SQL has the models' decisions; tests hold the stages against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar, learned from all labels, predicts as toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, names=OWN).where(F.col(OWN[1]) == 0).select(*_columns(docs))


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a likely language, go."""
    model = language_id.train(docs)
    found = language_id.predict(docs, model, names=OWN)
    return found.where((F.col(OWN[0]) != language_id.UNDETERMINED) & (F.col(OWN[1]) >= LANGUAGE_SCORE)).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 the document with the smallest id stays.

    Of rows that repeat an id and a text one stays; rows without an id stay.
    """
    found = shingle_join.join(docs, by_text=True)
    gone = staged(found.where("not stays").select("doc_id", F.col("text_key").alias("noticeloom_text")).distinct(), "near-duplicates")
    repeated = staged(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    kept = docs.withColumn("noticeloom_text", F.xxhash64("text")).join(gone, ["doc_id", "noticeloom_text"], "left_anti")
    if repeated.limit(1).count():
        again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(again)
    return kept.select(*_columns(docs))


def mix_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, repeat or go so that labelled-quality token shares meet their targets."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0")
    domains = labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("int")).alias("domain"))
    mixed = mixing.mix(docs, domains, QUALITY_TARGETS)
    told = mixed.select("missed_by").first()
    if told and told["missed_by"] > TOLD:
        logging.getLogger("noticeloom").warning("mixing misses a target by %.3f of all tokens", told["missed_by"])
    rates = mixed.where("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("noticeloom_copies"))
    counted = docs.join(rates, "doc_id", "left").withColumn("noticeloom_copies", F.coalesce("noticeloom_copies", F.lit(1)))
    many = counted.where("noticeloom_copies > 0").withColumn("noticeloom_copy", F.explode(F.sequence(F.lit(1), "noticeloom_copies")))
    return many.select(*_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_languages),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_quality),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k + 1}")
    return docs
