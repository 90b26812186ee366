"""From raw documents to packed training sequences, in stages that each apply one operator.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
``documents``.  Nulls, empty texts and empty tables pass through as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyweave.llm import langid, mixing, packing, pii, simhash
from plyweave.llm._shared import cut, settled

#: Up to so many ids (16 MB) are broadcast.
BROADCAST_IDS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, no letter, or no language that is likelier than all others together.

    The model is learned from the labelled documents; a missing label is filled with the prediction.
    """
    told = langid.identify(docs.select(*COLUMNS), langid.train(docs))
    kept = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates, by five-word shingles at a similarity of 0.8.

    Of rows with one id, one stays.  Documents without an id cannot be told apart and all stay.
    """
    groups = settled(spark, "groups", lambda: simhash.near_duplicates(docs))
    known = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n"))
    dropped, repeated = known.agg(F.count_if(~F.col("first")), F.count_if(F.col("n") > 1)).first()
    later = known.filter(~F.col("first")).select("doc_id")
    if dropped <= BROADCAST_IDS:  # the texts then stay where they are
        later = F.broadcast(later)
    out = docs.select(*COLUMNS).join(later, "doc_id", "left_anti").select(*COLUMNS)
    if not repeated:
        return out
    return out.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(out.filter("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its kind."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics come nearer to each other; nine tenths of the words stay."""
    counted = docs.select(*COLUMNS).withColumn("__topic", mixing.topic("text")).withColumn("__words", mixing.words("text"))
    mixed = mixing.mix(counted, "__words", ["source", "lang", "__topic"], keep=0.9)
    return mixed.filter("kept").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids, and their places in sequences of as many."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, with_ids=True)


STAGES = [("language", language), ("near-duplicates", near_duplicates), ("personal-data", personal_data), ("mixture", mixture), ("packing", packed)]

#: None: hashing, language models and packing cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
