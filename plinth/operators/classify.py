"""Drawing classes: tiers of rules, the first to decide counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLASSES, DEFAULT
from ..functions import text as T


def line_ratios(segments: DataFrame, key: str, share: float = DEFAULT.long_line_share) -> DataFrame:
    """Share of horizontal lines that span most of the page's width, 0 without any."""
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    flat = (dx != 0) & (dy / F.greatest(dx, F.lit(1.0)) <= 0.05)
    long = flat & (dx >= share * F.col("width"))
    total = F.count_if(flat)
    return segments.groupBy(key).agg(total.alias("n_lines"), F.count_if(long).alias("n_long"), F.when(total > 0, F.count_if(long) / total).otherwise(0.0).alias("ratio"))


def tier(cls: Column, name: str, confidence: Column | float) -> Column:
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.when(cls.isNotNull(), F.struct(cls.alias("class"), F.lit(name).alias("tier"), confidence.cast("double").alias("confidence")))


def cascade(pages: DataFrame, stem: str, title: str, body: str, ratio: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """class, tier and confidence by file name, title block, then content; else unresolved.

    Later tiers are expressions of the same row, so Spark evaluates them only
    where the earlier ones give null.  A model's verdict joins by
    :func:`with_verdicts`, for the rows that stay unresolved.
    """
    content = F.when(T.is_cut_line(F.col(body)), "SECTION")
    lines = F.when(F.col(ratio) >= DEFAULT.long_line_ratio, "ELEVATION")
    decided = F.coalesce(
        tier(T.first_match(F.col(stem), T.rules_from_config(rules, CLASSES)), "filename", 1.0),
        tier(T.title_class(F.col(title)), "title_block", 0.85),
        tier(content, "content", 0.8),
        tier(lines, "content", 0.7),
        F.struct(F.lit("UNKNOWN").alias("class"), F.lit("unresolved").alias("tier"), F.lit(0.0).alias("confidence")),
    )
    return pages.withColumn("_d", decided).select("*", "_d.class", "_d.tier", "_d.confidence").drop("_d")


def unresolved(pages: DataFrame, cache: DataFrame, key: str = "page_hash") -> DataFrame:
    """The undecided pages that no cached judgment answers: what a model is asked."""
    return pages.where("tier = 'unresolved'").join(cache.select(key).distinct(), key, "left_anti")


def first_reply(replies: DataFrame, keys: list[str], attempt: str, raw: str) -> DataFrame:
    """The first attempt of each page that parses."""
    parsed = replies.withColumn("_p", T.judge_reply(F.col(raw), CLASSES)).where("_p is not null")
    best = parsed.groupBy(*keys).agg(F.min(F.struct(attempt, "_p")).alias("b"))
    return best.select(*keys, f"b.{attempt}", "b._p.class", "b._p.confidence", "b._p.reason")


def combine(primary: DataFrame, checker: DataFrame, key: str, least: float = DEFAULT.judge_confidence) -> DataFrame:
    """One verdict of two models' (class, confidence, reason), null rows being failures.

    Both agree: the larger confidence and the first's reason.  They differ, or
    only the checker answers: unresolved.  Only the first answers: taken from
    ``least`` confidence on.
    """
    a = primary.select(key, F.col("class").alias("a_class"), F.coalesce("confidence", F.lit(0.0)).alias("a_conf"), F.col("reason").alias("a_reason"))
    b = checker.select(key, F.col("class").alias("b_class"), F.coalesce("confidence", F.lit(0.0)).alias("b_conf"))
    both = a.join(b, key, "full_outer")
    agree = F.col("a_class") == F.col("b_class")
    alone = F.col("a_class").isNotNull() & F.col("b_class").isNull()
    taken = agree | (alone & (F.col("a_conf") >= least))
    confidence = (
        F.when(agree, F.greatest("a_conf", "b_conf"))
        .when(alone, F.col("a_conf"))
        .when(F.col("a_class").isNull(), F.col("b_conf"))
        .otherwise(0.0)
    )
    decided = F.coalesce(taken, F.lit(False))
    return both.where("a_class is not null or b_class is not null").select(
        key,
        F.when(decided, F.col("a_class")).otherwise("UNKNOWN").alias("class"),
        F.when(decided, "llm").otherwise("unresolved").alias("tier"),
        confidence.alias("confidence"),
        F.when(decided, F.col("a_reason")).alias("reason"),
    )


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace: the latest row of each key."""
    from .ordered import last_wins

    return last_wins(cache.unionByName(fresh), keys, [order])


def counts(items: DataFrame) -> DataFrame:
    """Rows by class, by tier and in total, in one pass."""
    sets = items.groupingSets([[F.col("class")], [F.col("tier")], []], "class", "tier").agg(F.count("*").alias("n"))
    return sets.select("class", "tier", "n")


def cache_stats(judgments: DataFrame) -> DataFrame:
    """How many judgments a cache holds, by model."""
    return judgments.groupBy("model").agg(F.count("*").alias("n"))
