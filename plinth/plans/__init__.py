"""Query plans over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classification, details, model, payloads, sessions  # noqa: F401
from .registry import ORACLES, QUERIES

#: The query whose plan uses the most operators.
FLAGSHIP = "p33_review_queue"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[FLAGSHIP](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
