"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def _byte_bpe() -> tuple[str, str]:
    """Path and splitting pattern of the vocabulary the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _byte_bpe()[0], size=1024)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import surrogate_documents

    out = surrogate_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_chars", "n_entities")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), size=35)


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import line_rules

    return line_rules(_table(spark, sf_dir, "documents"))


def op8_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(_table(spark, sf_dir, "documents"), *_byte_bpe())


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_digests

    return dedup_digests(_table(spark, sf_dir, "documents"), documents=10, least=1)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import hard_negatives

    vectors = _table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), anchor=F.col("vec_id") % 100 == 0)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(_table(spark, sf_dir, "documents"), _byte_bpe()[0], public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_minhash": op2_minhash,
        "op3_packing": op3_packing,
        "op4_pii": op4_pii,
        "op5_substring": op5_substring,
        "op6_quality_gam": op6_quality_gam,
        "op7_line_rules": op7_line_rules,
        "op8_naive_bayes": op8_naive_bayes,
        "op9_bpe": op9_bpe,
        "op10_multi_index": op10_multi_index,
        "op11_lines": op11_lines,
        "op12_negatives": op12_negatives,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()
