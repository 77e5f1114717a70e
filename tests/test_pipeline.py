"""The stages together, lazily and with saved tables."""

import json
from dataclasses import replace

from plinth.operators.resolve import starter_inventory
from plinth.pipeline import Inputs, run, saved_in
from plinth.sources.files import Config


def inputs(spark):
    pages = [(1, "PRJ-S-200-L3-00", "", "", 0.0), (2, "x", "PERSPECTIVE", "", 0.0), (3, "y", "", "", 0.0)]
    axes = [("L3", None, "x", 0, "1", 0.0), ("L3", None, "x", 1, "2", 8400.0), ("L3", None, "y", 0, "A", 0.0), ("L3", 1, "x", 0, "2", 0.0), ("L3", 1, "y", 0, "a", 100.0), ("L3", 2, "x", 0, "9", 0.0)]
    canonical = [("L3", 0, 8400.0, 0.0), ("L3", 1, 0.0, 0.0)]
    enlarged = [("L3", 1, 5, 30.0, 120.0, "C9", "rectangular", 1150, 800, None, False), ("L3", 2, 6, 0.0, 0.0, "C2", "square", 800, 800, None, False)]
    marks = [("e", "3RD STOREY", 8100), ("e", "4TH STOREY", 12600)]
    return Inputs(
        spark.createDataFrame(pages, "page int, stem string, title string, body string, ratio double"),
        spark.createDataFrame(axes, "storey_id string, page_id int, axis string, ord int, label string, mm double"),
        spark.createDataFrame(canonical, "storey_id string, canonical_idx long, x double, y double"),
        spark.createDataFrame(enlarged, "storey_id string, page_id int, enlarged_id long, px double, py double, label string, shape string, dim_x int, dim_y int, diameter int, is_steel boolean"),
        spark.createDataFrame(marks, "pdf string, name string, rl_mm int"),
        starter_inventory(spark),
    )


def check(out):
    assert {r["page"]: r["class"] for r in out["classified"].collect()} == {1: "STRUCT_PLAN_OVERALL", 2: "DISCARD", 3: "UNKNOWN"}
    assert {r["canonical_idx"]: (r["tier"], r["type_name"]) for r in out["typed"].collect()} == {0: ("CREATED", "C9_R_1150x800"), 1: ("REJECTED", None)}
    grown = {r["type_name"]: (r["shape"], r["type_ord"], r["is_synthetic"]) for r in out["inventory"].collect()}
    assert len(grown) == 5 and grown["C9_R_1150x800"] == ("rectangular", 1, True)
    verdict = out["verdicts"].first()
    assert verdict["all_passed"] and verdict["warnings"] == ["enlarged_coverage"]
    recipe = [(r["part"], json.loads(r["body"])) for r in out["recipes"].collect()]
    assert [c["symbol"] for p, c in recipe if p == "structural_column"] == ["C9_R_1150x800"] and sorted(x["elevation"] for p, x in recipe if p == "level") == [8100, 12600]
    kinds = sorted((r["kind"], r["key"]) for r in out["review"].collect())
    assert kinds == [("discarded", "2"), ("missing", "L3/1"), ("rejected", "L3/1"), ("unresolved", "3"), ("warning", "L3")]


def test_one_lazy_plan(spark):
    check(run(inputs(spark)))


def test_saved_stages_events_and_overrides(spark, tmp_path):
    events = []
    out = run(inputs(spark), save=saved_in(str(tmp_path)), progress=lambda kind, payload: events.append((kind, payload["stage"])))
    check(out)
    assert events[:2] == [("stage_started", "classified"), ("stage_completed", "classified")] and len(events) == 24
    config = Config.from_dict({"levels": {"L3": {"rl_mm": 8000}}, "slabs": {"default_thickness_mm": 0}})
    moved = run(inputs(spark), config)
    assert {r["name"]: r["rl_mm"] for r in moved["levels"].collect()} == {"L3": 8000, "L4": 12600}
    assert moved["verdicts"].first()["hard_failures"] == ["slab_thickness_present"] and moved["recipes"].where("part <> 'level'").count() == 0


def test_without_detections_there_are_no_columns(spark):
    out = run(inputs(spark), Config.from_dict({"detect": False}))
    assert out["columns"].count() == out["placed"].count() == 0 and out["classified"].count() == 3


def test_the_next_run_starts_with_the_types_of_the_last(spark):
    first = run(inputs(spark))
    again = run(replace(inputs(spark), inventory=first["inventory"]))
    assert {r["tier"] for r in again["typed"].collect()} == {"MATCHED_EXACT", "REJECTED"}
