"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.minhash import near_duplicates
from plinth.llm.packing import pack
from plinth.llm.pii import surrogate_documents
from plinth.llm.quality_gam import filter_quality
from plinth.llm.queries import _byte_bpe
from plinth.llm.storage import drop, materialised
from plinth.llm.substring import cut_repeats

#: Similarity, in per cent, from which two documents are near copies.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies."""
    groups = near_duplicates(docs, percent=NEAR_PERCENT)
    kept = groups.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    docs = docs.hint("merge")
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]), "left_semi")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere too."""
    return cut_repeats(docs, size=35)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    return surrogate_documents(docs).drop("n_entities")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs, _byte_bpe()[0], size=1024)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pii", pii), ("packing", packing)]

#: A fitted model, signatures and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
