"""A training-corpus pipeline of five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.llm import decontaminate, langid, minhash, packing, pii
from pitloom.llm.scratch import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told; those without letters go."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    told = langid.identify(docs, model, keep=COLUMNS)
    return told.where(F.col("lang_pred") != "und").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates, once: texts are linked if their shingles of five words
    have a Jaccard similarity of 0.8 or more. Null ids can't be told apart and stay; of rows with one id the least stays."""
    found = minhash.near_duplicates(docs.where("doc_id is not null"), size=5, similarity=0.8)
    first = found.where("doc_id = component_id").select("doc_id")
    rest = [c for c in COLUMNS if c != "doc_id"]
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return kept.unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark. A hash of the text stands for the document, so that null ids are judged too."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.withColumn("text_hash", F.xxhash64("text"))
    found = decontaminate.overlaps(named.select("text_hash", "text"), benchmark, id_col="text_hash")
    dirty = materialize(found.select(F.col("doc_id").alias("text_hash")).distinct())
    return named.join(dirty, "text_hash", "left_anti").select(*COLUMNS)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it replaced; n_chars is the new length."""
    return pii.sanitize(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", remove_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language model nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over `documents`; each one's result is written as Parquet and read as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
