"""A training corpus in five stages: quality classifier, language ID, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkspark.llm import bpe, gru_langid, kn_quality, minhash_dedup, mixing
from talkspark.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least mean probability of a language; clean text has 0.9 and more.
LEAST_SCORE = 0.4
ORACLE_SQL = None


def row_key() -> list[Column]:
    """A row's own key, never null: its id and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id_key"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key")]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = kn_quality.quality(docs.select("doc_id", "lang", "text", *row_key()), labels)
    rejected = verdicts.where(~F.col("kept")).select("id_key", "text_key").distinct()
    return docs.select(*COLUMNS, *row_key()).join(rejected, ["id_key", "text_key"], "left_anti").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a language, by at least LEAST_SCORE."""
    network = gru_langid.train(docs.select("doc_id", "text", "lang"))
    found = gru_langid.predict(docs.select(*COLUMNS), network)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id, once."""
    kept = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).where("kept")
    id_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id_key")
    kept = kept.select(id_key, F.coalesce("text_key", F.lit(0)).alias("text_key")).distinct()
    rows = docs.select(*COLUMNS, *row_key()).join(kept, ["id_key", "text_key"], "left_semi")
    once = Window.partitionBy("id_key", "text_key").orderBy("source", "lang")
    return rows.withColumn("copy", F.row_number().over(once)).where("copy = 1").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text decoded from them."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.round_trip(docs.select("doc_id", "text"), vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it return is kept in the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
