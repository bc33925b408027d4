"""From documents to training sequences: language, quality, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.llm import langid, minhash, packing, queries, robust_outliers
from scrubjay.llm.shared import scratch, small_batches, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what is in a known language. The model is fitted on the documents given, held-out ones aside."""
    small_batches(spark)
    model = langid.train(docs.where(~queries.held_out(F.col("doc_id"))))
    # Whole rows travel through the prediction, so no row is joined or shuffled.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    found = langid.predict(rows, model, id_col="row", inside=True, judge=True)
    return found.where("known").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and is no outlier of its language and source."""
    return robust_outliers.keep(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, one of its smallest id. Rows are told apart by their own numbers, whatever their ids."""
    small_batches(spark)
    return minhash.unique(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    small_batches(spark)
    pieces = packing.pack(docs, packing.Settings(queries.tokenizer_path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", identify_language), ("quality", quality_rules), ("near_duplicates", near_duplicates), ("packing", pack_sequences)]

#: Models, outlier estimates and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
