"""All stages in a row: sheets in, a checked model and a review queue out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import classify, emit, levels, reconcile, resolve
from .sources.files import Config

Save = Callable[[str, DataFrame], DataFrame]
Progress = Callable[[str, dict], None]


@dataclass
class Inputs:
    """What the edges deliver.

    pages: page, stem, title, body, ratio.  axes: storey_id, page_id (null for the
    overall sheet), axis, ord, label, mm.  canonical: storey_id, canonical_idx, x, y.
    enlarged: storey_id, page_id, enlarged_id, px, py in page millimetres, and the
    label columns.  marks: pdf, name, rl_mm.  inventory: see ``starter_inventory``.
    """

    pages: DataFrame
    axes: DataFrame
    canonical: DataFrame
    enlarged: DataFrame
    marks: DataFrame
    inventory: DataFrame


def saved_in(folder: str) -> Save:
    """Write each stage's table below ``folder`` and read on from there; a rerun replaces it."""

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return save


def run(inputs: Inputs, config: Config | None = None, save: Save | None = None, progress: Progress | None = None) -> dict[str, DataFrame]:
    """Tables by stage: classified, offsets, columns, levels, storeys, typed, inventory, placed, gates, verdicts, recipes, review.

    Without ``save`` all of it is one lazy plan.  With it a stage runs once
    however many later ones read it.  ``progress`` gets an event as each stage
    starts and completes.
    """
    config = config or Config()
    if not config.detect:
        inputs = replace(inputs, canonical=inputs.canonical.limit(0), enlarged=inputs.enlarged.limit(0))
    out: dict[str, DataFrame] = {}

    def stage(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        began = time.time()
        if progress:
            progress("stage_started", {"stage": name})
        table = build()
        out[name] = save(name, table) if save else table
        if progress:
            progress("stage_completed", {"stage": name, "seconds": time.time() - began})
        return out[name]

    stage("classified", lambda: classify.cascade(inputs.pages, "stem", "title", "body", "ratio", config.rules or None).select("page", "class", "tier", "confidence"))
    overall = inputs.axes.where("page_id is null").drop("page_id")
    offsets = stage("offsets", lambda: reconcile.page_offsets(overall, inputs.axes.where("page_id is not null")))

    def match() -> DataFrame:
        placed = inputs.enlarged.join(offsets.drop("notes"), ["storey_id", "page_id"])
        # a page that shares no axis with its overall sheet has null offsets and drops out
        placed = placed.withColumns({"ex": F.col("px") + F.col("x_offset_mm"), "ey": F.col("py") + F.col("y_offset_mm")}).where("ex is not null and ey is not null")
        return reconcile.infer_labels(reconcile.match(inputs.canonical, placed))

    columns = stage("columns", match)

    def project_levels() -> DataFrame:
        merged = levels.merge_project_levels(inputs.marks, config.aliases)
        if not config.levels:
            return merged.select("name", "rl_mm", F.lit("elevation").alias("source"), F.lit(False).alias("diverges"))
        return levels.override_levels(merged, config.level_table(merged.sparkSession))

    stack = stage("levels", project_levels)
    ids = inputs.canonical.select("storey_id").distinct()
    storeys = stage("storeys", lambda: emit.slab_zones(levels.storey_levels(ids, stack.withColumn("level_id", F.lit(0))), config.slab_zones, config.slab_mm))
    typed = stage("typed", lambda: resolve.resolve(columns, inputs.inventory, ["storey_id", "canonical_idx"]))
    # what the next run starts with
    stage("inventory", lambda: resolve.grown_inventory(inputs.inventory, typed, ["storey_id", "canonical_idx"]))
    placed = stage("placed", lambda: resolve.placements(typed))

    def check() -> DataFrame:
        totals = reconcile.storey_summary(columns).select("storey_id", "total", "missing")
        short = emit.missing_shapes(placed, inputs.inventory).groupBy("storey_id").agg(F.count("*").alias("short"))
        grid = overall.select("storey_id").distinct().withColumn("has_grid", F.lit(True))
        facts = storeys.join(totals, "storey_id", "left").join(short, "storey_id", "left").join(grid, "storey_id", "left")
        known = {"has_grid": F.coalesce("has_grid", F.lit(False)), "n_missing_shapes": F.coalesce("short", F.lit(0)), "has_overall": F.lit(True), "residual_px": F.lit(None).cast("double")}
        return emit.gates(facts.withColumns(known))

    gates = stage("gates", check)
    verdicts = stage("verdicts", lambda: emit.gate_verdicts(gates))
    passed = storeys.join(verdicts.where("all_passed").select("storey_id"), "storey_id", "left_semi")
    stage("recipes", lambda: emit.recipe_rows(emit.recipe_columns(placed), passed, stack))
    stage("review", lambda: emit.review_items(out["classified"], columns, typed, gates))
    return out
