"""Gates, recipes, mesh extents and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT


def _gate(name: str, passed: Column, severity: str | Column = "hard") -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), severity.alias("severity"))


def gates(storeys: DataFrame) -> DataFrame:
    """One row a storey and gate.

    ``storeys``: storey_id, has_overall, residual_px, has_grid, total and missing
    columns (null without a reconcile), base_rl, top_rl, slab_mm, n_missing_shapes
    (null without typing).  Columns without a label only warn.
    """
    hard_coverage = F.coalesce(F.col("total"), F.lit(0)) == 0
    usable = (F.coalesce(F.col("residual_px"), F.lit(0.0)) != 0) | F.col("has_grid")
    checks = F.array(
        _gate("overall_present", F.col("has_overall") & usable),
        _gate("enlarged_coverage", ~hard_coverage & (F.col("missing") == 0), F.when(~hard_coverage & (F.col("missing") > 0), "warn").otherwise("hard")),
        _gate("base_level_present", F.col("base_rl").isNotNull()),
        _gate("top_level_present", F.col("top_rl").isNotNull()),
        _gate("slab_thickness_present", F.col("slab_mm") > 0),
        _gate("starter_family_for_each_shape", F.col("n_missing_shapes") == 0),
    )
    return storeys.select("storey_id", F.explode(checks).alias("g")).select("storey_id", "g.gate", "g.passed", "g.severity")


def gate_verdicts(rows: DataFrame) -> DataFrame:
    """Whether a storey passes all hard gates, and which gates failed."""
    failed = lambda kind: F.array_sort(F.collect_list(F.when(~F.col("passed") & (F.col("severity") == kind), F.col("gate"))))
    return rows.groupBy("storey_id").agg(
        F.bool_and(F.col("passed") | (F.col("severity") != "hard")).alias("all_passed"), failed("hard").alias("hard_failures"), failed("warn").alias("warnings")
    )


def missing_shapes(placed: DataFrame, inventory: DataFrame) -> DataFrame:
    """Shapes placed in a storey that no family has."""
    return distinct_shapes(placed, ["storey_id"]).join(distinct_shapes(inventory), "shape", "left_anti")


def recipe_columns(placed: DataFrame) -> DataFrame:
    """width, depth, material and shape of each column that has its sizes; a size of 0 is none."""
    dims = F.col("source_dims")
    round_ = F.col("shape") == "round"
    width = F.when(round_, F.try_element_at(dims, F.lit("d"))).otherwise(F.try_element_at(dims, F.lit("x")))
    depth = F.when(round_, F.try_element_at(dims, F.lit("d"))).otherwise(F.try_element_at(dims, F.lit("y")))
    out = placed.select(
        "storey_id", "canonical_idx", "x", "y", F.coalesce("family_name", F.lit("Concrete-Rectangular-Column")).alias("family"), F.coalesce("type_name", F.lit("STARTER")).alias("symbol"),
        F.when(round_, "circular").otherwise("rectangular").alias("form"), F.when(F.col("is_steel"), "steel").otherwise("concrete").alias("material"),
        F.bround(width.cast("double"), 1).alias("width"), F.bround(depth.cast("double"), 1).alias("depth"),
    )
    return out.where("width <> 0 and depth <> 0")


def slabs(columns: DataFrame, margin: float = DEFAULT.slab_margin_mm) -> DataFrame:
    """The rectangle round a storey's columns."""
    return columns.groupBy("storey_id").agg(
        (F.min("x") - margin).alias("x0"), (F.min("y") - margin).alias("y0"), (F.max("x") + margin).alias("x1"), (F.max("y") + margin).alias("y1"), F.count("*").alias("n_columns")
    )


def scene_slabs(placed: DataFrame, storeys: DataFrame, margin: float = 1.0) -> DataFrame:
    """The slab on top of each storey that has columns, in metres: a metre beyond the outermost placements.

    Unlike the recipe's, which lies at the base, in millimetres.  ``storeys``: storey_id, top_rl, slab_mm.
    """
    box = placed.where("x is not null and y is not null").groupBy("storey_id").agg(
        *[(f(c) * 0.001 + sign * margin).alias(n) for c, f, sign, n in (("x", F.min, -1, "x0"), ("y", F.min, -1, "y0"), ("x", F.max, 1, "x1"), ("y", F.max, 1, "y1"))]
    )
    top = F.col("top_rl") * 0.001
    return box.join(storeys.select("storey_id", "top_rl", "slab_mm"), "storey_id").select("storey_id", "x0", "y0", "x1", "y1", top.alias("z0"), (top + F.col("slab_mm") * 0.001).alias("z1"))


def slab_zones(storeys: DataFrame, zones: dict[str, float], default: float = DEFAULT.slab_default_mm) -> DataFrame:
    """``storeys`` with slab_mm: its zone's thickness, by name in any case, else the default."""
    known = F.create_map(*[F.lit(x) for name, mm in zones.items() for x in (name.upper(), float(mm))]) if zones else F.create_map().cast("map<string,double>")
    return storeys.withColumn("slab_mm", F.coalesce(F.try_element_at(known, F.upper("storey_id")), F.lit(float(default))))


def scene_lines(storeys: DataFrame, placed: DataFrame, meshes: DataFrame) -> DataFrame:
    """Scene documents as rows (file, part, at, body): head with counts and bounds, then a node a column.

    A storey without columns gets the document of an empty scene.
    """
    file = F.concat("storey_id", F.lit(".gltf.json")).alias("file")
    facts = storeys.select("storey_id").join(scene(placed, meshes), "storey_id", "left")
    n = F.coalesce("column_count", F.lit(0))
    bounds = F.when(n > 0, F.struct("min_x", "min_y", "min_z", "max_x", "max_y", "max_z"))
    head = F.struct(F.struct(F.lit("2.0").alias("version")).alias("asset"), F.lit(0).alias("scene"), n.alias("column_count"), F.coalesce("skipped", F.lit(0)).alias("skipped"), bounds.alias("bounds"))
    middle = F.array(*[(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"])
    named = meshes.join(placed.select("storey_id", "canonical_idx", "type_name"), ["storey_id", "canonical_idx"])
    node = F.struct(F.coalesce("type_name", F.concat(F.lit("col_"), F.col("canonical_idx").cast("string"))).alias("name"), middle.alias("translation"))
    heads = facts.select(file, F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.to_json(head).alias("body"))
    return heads.union(named.select(file, F.lit(1), F.col("canonical_idx").cast("long"), F.to_json(node)))


def outcomes(verdicts: DataFrame, artefacts: DataFrame) -> DataFrame:
    """Whether a storey succeeded, and why it was skipped.

    It succeeds if all hard gates pass and both artefacts were written; if a
    gate fails, nothing is written and the reason names the gates.
    ``verdicts`` as :func:`gate_verdicts`; ``artefacts``: storey_id, has_scene, has_recipe.
    """
    written = F.coalesce(F.col("has_scene") & F.col("has_recipe"), F.lit(False))
    names = F.concat(F.lit("["), F.array_join(F.transform("hard_failures", lambda g: F.concat(F.lit("'"), g, F.lit("'"))), ", "), F.lit("]"))
    reason = F.when(~F.col("all_passed"), F.concat("storey_id", F.lit(": hard gates failed → "), names))
    return verdicts.join(artefacts, "storey_id", "left").select("storey_id", (F.col("all_passed") & written).alias("succeeded"), reason.alias("skipped_reason"))


def distinct_shapes(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The shapes in use, in all or for each of ``keys``; refused rows, where there is a tier, don't count."""
    used = rows.where("tier <> 'REJECTED'") if "tier" in rows.columns else rows
    return used.where("shape is not null").select(*(keys or []), "shape").distinct()


def recipe_rows(columns: DataFrame, storeys: DataFrame, levels: DataFrame) -> DataFrame:
    """The recipes as rows (storey_id, part, key, body as JSON): levels of all storeys, then slabs and columns of each."""
    level = levels.select(F.lit("").alias("storey_id"), F.lit("level").alias("part"), F.col("name").alias("key"), F.to_json(F.struct(F.col("rl_mm").alias("elevation"), "name")).alias("body"))
    inside = storeys.select("storey_id", "slab_mm").join(slabs(columns), "storey_id")
    slab = inside.select("storey_id", F.lit("slab"), F.lit(""), F.to_json(F.struct("x0", "y0", "x1", "y1", F.col("slab_mm").alias("thickness"))))
    body = F.to_json(F.struct("canonical_idx", "family", "symbol", "form", "material", "width", "depth", "x", "y"))
    column = columns.join(storeys.select("storey_id"), "storey_id", "left_semi").select("storey_id", F.lit("structural_column"), F.col("canonical_idx").cast("string"), body)
    return level.union(slab).union(column)


def recipe(columns: DataFrame, storeys: DataFrame, levels: DataFrame) -> DataFrame:
    """One JSON recipe a storey: levels by height, columns by index, one slab.

    A recipe is one document, so a storey's columns must fit a row;
    ``recipe_rows`` has no such bound.  The levels are joined as one row a storey.
    """
    stack = levels.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("rl_mm").alias("elevation"), "name"))).alias("levels"))
    packed = columns.groupBy("storey_id").agg(F.sort_array(F.collect_list(F.struct("canonical_idx", "family", "symbol", "form", "material", "width", "depth", "x", "y"))).alias("columns"))
    out = storeys.join(packed, "storey_id", "left").join(slabs(columns), "storey_id", "left").crossJoin(stack)
    slab = F.when(F.col("x0").isNotNull(), F.struct("x0", "y0", "x1", "y1", F.col("slab_mm").alias("thickness")))
    body = F.struct(F.col("levels"), F.coalesce("columns", F.array()).alias("structural_columns"), slab.alias("slab"), F.array().cast("array<string>").alias("structural_framing"))
    return out.select("storey_id", F.to_json(body).alias("recipe"))


def mesh_extents(columns: DataFrame, storeys: DataFrame, sections: int = 24) -> DataFrame:
    """Box of each column in metres; heights of less than a millimetre count as one.

    Where there is a ``rotation_deg``, columns are turned about their upright
    axis: a footprint takes the box round it, a cylinder stays.
    """
    turned = F.radians(F.coalesce(F.col("rotation_deg").cast("double"), F.lit(0.0))) if "rotation_deg" in columns.columns else None
    across, along = F.col("width"), F.col("depth")
    if turned is not None:
        c, s, stays = F.abs(F.cos(turned)), F.abs(F.sin(turned)), F.col("form") == "circular"
        across, along = (F.when(stays, own).otherwise(own * c + other * s) for own, other in ((across, along), (along, across)))
    height = F.greatest(F.lit(1.0), (F.col("top_rl") - F.col("base_rl")).cast("double")) * 0.001
    middle = (F.col("base_rl") * 0.001 + F.col("top_rl") * 0.001) / 2
    out = columns.join(storeys.select("storey_id", "base_rl", "top_rl"), "storey_id")
    return out.select(
        "storey_id", "canonical_idx", "form", F.when(F.col("form") == "circular", sections).otherwise(4).alias("sections"),
        (F.col("x") * 0.001 - across * 0.0005).alias("min_x"), (F.col("x") * 0.001 + across * 0.0005).alias("max_x"),
        (F.col("y") * 0.001 - along * 0.0005).alias("min_y"), (F.col("y") * 0.001 + along * 0.0005).alias("max_y"),
        (middle - height / 2).alias("min_z"), (middle + height / 2).alias("max_z"),
    )


def scene(placed: DataFrame, meshes: DataFrame) -> DataFrame:
    """Bounds and counts of a storey's scene; placements without a mesh are skipped."""
    box = meshes.groupBy("storey_id").agg(F.count("*").alias("column_count"), *[f(c).alias(c) for c, f in (("min_x", F.min), ("max_x", F.max), ("min_y", F.min), ("max_y", F.max), ("min_z", F.min), ("max_z", F.max))])
    all_ = placed.groupBy("storey_id").agg(F.count("*").alias("n"))
    return all_.join(box, "storey_id", "left").withColumn("column_count", F.coalesce("column_count", F.lit(0))).withColumn("skipped", F.col("n") - F.col("column_count")).drop("n")


def review_items(pages: DataFrame, columns: DataFrame, typed: DataFrame, gate_rows: DataFrame) -> DataFrame:
    """The review queue: what a person has to look at, from every stage.

    section, kind, key (page, or storey and column), detail.
    """
    item = lambda section, kind, key, detail: [F.lit(section).alias("section"), F.lit(kind).alias("kind"), key.alias("key"), F.coalesce(detail, F.lit("")).alias("detail")]
    at = F.concat_ws("/", "storey_id", F.col("canonical_idx").cast("string"))
    page = F.col("page").cast("string")
    parts = [
        pages.where("class = 'DISCARD'").select(*item("classification", "discarded", page, F.col("tier"))),
        pages.where("tier = 'unresolved' or class = 'UNKNOWN'").select(*item("classification", "unresolved", page, F.col("tier"))),
        columns.where("flag like 'label_conflict%'").select(*item("reconcile", "conflict", at, F.col("flag"))),
        columns.where("flag = 'label_missing'").select(*item("reconcile", "missing", at, F.lit(""))),
        typed.where("tier = 'REJECTED'").select(*item("resolve", "rejected", at, F.col("reason"))),
        gate_rows.where("not passed and severity = 'hard'").select(*item("emit", "hard_failure", F.col("storey_id"), F.col("gate"))),
        gate_rows.where("not passed and severity = 'warn'").select(*item("emit", "warning", F.col("storey_id"), F.col("gate"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def review_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("section", "kind").agg(F.count("*").alias("n"))
