"""Reports and payloads out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest(pages: DataFrame) -> DataFrame:
    """The manifest as rows (part, key, body as JSON): a summary, each file, each page.

    ``pages``: pdf, page_index, page_hash.  No row holds another's list, so the
    manifest may be of any length; ``write_lines`` stores it.
    """
    files = pages.groupBy("pdf").agg(F.count("*").alias("n_pages"))
    totals = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("n_pages"), F.lit(0)).alias("page_count"))
    parts = [
        totals.select(F.lit("summary").alias("part"), F.lit("").alias("key"), F.to_json(F.struct("file_count", "page_count")).alias("body")),
        files.select(F.lit("file"), F.col("pdf"), F.to_json(F.struct("pdf", "n_pages"))),
        pages.select(F.lit("page"), F.concat_ws("#", "pdf", "page_index"), F.to_json(F.struct("pdf", "page_index", "page_hash"))),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def report(items: DataFrame, summary: dict[str, Column], key: str) -> DataFrame:
    """A stage's report as rows (part, key, body as JSON): the summary's aggregates, and each item."""
    head = items.agg(*[c.alias(k) for k, c in summary.items()])
    return head.select(F.lit("summary").alias("part"), F.lit("").alias("key"), F.to_json(F.struct(*summary)).alias("body")).union(
        items.select(F.lit("item"), F.col(key).cast("string"), F.to_json(F.struct(*items.columns)))
    )


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows of (part, key, body) as JSON lines, a folder for each part; a rerun replaces what is there."""
    rows.write.mode("overwrite").partitionBy("part").json(path)


def write_payloads(rows: DataFrame, path: str, by: str) -> None:
    """Nested rows as JSON, one folder a storey or sheet; a rerun replaces what is there."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def build_warnings(replies: DataFrame, header: str) -> DataFrame:
    """Warnings of a build's reply header: a list of texts, or of objects with a text and ids."""
    plain = F.from_json(header, "array<string>")
    rich = F.from_json(header, "array<struct<text string, element_ids array<int>>>")
    texts = F.transform(rich, lambda w: w["text"])
    second = F.exists(texts, lambda t: t.isNotNull())
    return replies.withColumn("warnings", F.when(F.coalesce(second, F.lit(False)), texts).otherwise(F.coalesce(plain, F.array().cast("array<string>"))))


def is_model_file(content: Column) -> Column:
    """Whether bytes start like a compound document."""
    return F.hex(F.substring(content, 1, 4)) == "D0CF11E0"
