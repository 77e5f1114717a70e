"""Joins of tables that grow send nothing whole through the driver, whatever their files' sizes say."""

import pickle
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth import plans
from plinth.operators import associate as A
from plinth.operators import greedy as GD
from plinth.operators import grid as GR
from plinth.operators import ranges as RG
from plinth.operators import reconcile as R
from plinth.operators import resolve as S
from plinth.operators.spatial import radii_join
from plinth.plans import model
from plinth.plans.views import view
from plinth.sources import payloads as SP
from plinth.storage import materialised


@pytest.fixture
def no_broadcast(spark):
    """A broadcast of any table is an error."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_boxes_are_suppressed_without_broadcasts(spark, no_broadcast):
    boxes = spark.range(40).selectExpr("id % 2 as page", "id as det_id", "id / 100D as confidence", "1D * (id div 4) as x0", "0D as y0", "(id div 4) + 4D as x1", "4D as y1")
    kept = GD.suppress(boxes, ["page"], "det_id")
    assert 0 < kept.count() < 40


def test_types_are_found_without_broadcasts(spark, no_broadcast):
    columns = spark.range(60).selectExpr("'L1' as storey_id", "id as canonical_idx", "'C1' as label", "'square' as shape", "cast(700 + id % 20 * 3 as int) as dim_x", "cast(700 + id % 20 * 3 as int) as dim_y", "cast(null as int) as diameter")
    good = S.sizes_that_count(columns.withColumn("new_name", F.concat(F.lit("T"), F.col("dim_x").cast("string"))))
    found = GD.find_or_create(good, "shape", S.SIZES, ["storey_id", "canonical_idx"], S.starter_inventory(spark), 5)
    assert found.count() == 20 and found.where("created").count() > 1


def test_labels_are_matched_without_broadcasts(spark, no_broadcast):
    canonical = spark.range(50).selectExpr("concat('L', id % 2) as storey_id", "id as canonical_idx", "id * 600D as x", "0D as y")
    enlarged = spark.range(100).selectExpr("concat('L', id % 2) as storey_id", "id as enlarged_id", "1 as page_id", "id * 600D + 10 as ex", "0D as ey", "if(id % 5 = 0, null, 'C2') as label", "'square' as shape", "800 as dim_x", "800 as dim_y", "cast(null as int) as diameter", "false as is_steel")
    canonical, enlarged = materialised(canonical), materialised(enlarged)
    assert R.label_candidates(canonical, enlarged).count() == 40
    near = radii_join(canonical, enlarged.select("storey_id", "ex", "ey"), ["storey_id"], ("x", "y"), ("ex", "ey"), F.lit(20.0))
    assert "SortMergeJoin [storey_id" in near._jdf.queryExecution().executedPlan().toString()


def test_notes_meet_gaps_without_broadcasts(spark, no_broadcast):
    points = materialised(spark.range(50).selectExpr("id % 3 as page", "id as p", "id * 1D as at"))
    intervals = materialised(spark.range(10).selectExpr("id % 3 as page", "id as i", "id * 5D as low", "id * 5D + 6 as high"))
    plan = RG.interval_join(points, intervals, ["page"], "at", "low", "high")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [page" in plan and "_level" in plan.split("SortMergeJoin")[1]


def test_an_interval_is_cut_into_blocks_that_hold_each_of_its_integers_once(spark):
    ends = [(0, 0), (5, 5), (-40, 300), (16, 31), (15, 32), (0, 255), (1, 4096), (-5000, -17), (7, 3)]
    got = spark.createDataFrame(ends, "low long, high long").select("low", "high", RG.blocks(F.col("low"), F.col("high")).alias("b")).collect()
    for r in got:
        held = sorted(i for level, number in r["b"] for i in range(number << level, (number + 1) << level))
        assert held == list(range(r["low"], r["high"] + 1)), r
        assert all(level % 4 == 0 for level, _ in r["b"])


def test_rows_are_typed_without_broadcasting_them(spark):
    columns = materialised(spark.range(60).selectExpr("'L1' as storey_id", "id as canonical_idx", "'C1' as label", "'square' as shape", "cast(700 + id % 20 * 3 as int) as dim_x", "cast(700 + id % 20 * 3 as int) as dim_y", "cast(null as int) as diameter"))
    typed = S.resolve(columns, S.starter_inventory(spark), ["storey_id", "canonical_idx"])
    assert "Join LeftOuter" in typed._jdf.queryExecution().optimizedPlan().toString()
    assert typed.count() == 60 and typed.where("type_name is null").count() == 0


def test_a_task_reports_its_folder_and_no_names(spark, tmp_path):
    n = 2000
    batch = pa.RecordBatch.from_pydict({"file": [f"{i:06d}.json" for i in range(n)], "part": [0] * n, "at": [0] * n, "body": ['{"id": 1}'] * n})
    path = f"file://{tmp_path}/out"
    writer = SP.PayloadWriter(path, [])
    done = writer.write(iter([batch]))
    assert len(pickle.dumps(done)) < 1000
    writer.commit([done])
    docs = SP.load_payloads(spark, path, "id long", "00*[05].json")
    assert "FileScan" not in docs._jdf.queryExecution().executedPlan().toString()
    assert docs.count() == 400 and docs.where("id = 1 and error is null").count() == 400
    with pytest.raises(ValueError, match="not in order"):
        writer.write(iter([batch.slice(5, 1), batch.slice(4, 1)]))


def test_labels_are_inferred_without_broadcasts(spark, no_broadcast):
    columns = spark.range(60).selectExpr("'L1' as storey_id", "id as canonical_idx", "id * 600D as x", "0D as y", "0.5D as confidence")
    enlarged = spark.range(60).where("id % 10 <> 3").selectExpr("'L1' as storey_id", "id as enlarged_id", "1 as page_id", "id * 600D + 10 as ex", "0D as ey", "'C2' as label", "'square' as shape", "800 as dim_x", "800 as dim_y", "cast(null as int) as diameter", "false as is_steel")
    found = R.infer_labels(R.match(materialised(columns), materialised(enlarged)))
    assert found.where("label = 'C2'").count() == 60 and found.where("flag like 'label_inferred%'").count() == 6
    labelled = R.match(materialised(columns), materialised(enlarged)).where("label is not null")
    assert labelled.count() == 54


def test_detections_meet_their_parts_without_broadcasts(spark, no_broadcast):
    plan = view(spark, "/root/testdata/sf0.001", "v_enlarged")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [l_partkey" in plan


def test_labels_are_read_once_for_size_notes(spark):
    dets = materialised(spark.range(30).selectExpr("id div 10 as page", "id as det_id", "id * 100D as cx", "50D as cy", "30D as dx", "30D as dy"))
    spans = materialised(spark.range(60).selectExpr("id div 20 as page", "id as span_id", "if(id % 2 = 0, 'C1', '400x400') as text", "(id div 2) * 100D as x", "50D as y"))
    found = A.associate(dets, spans)
    assert found.where("label = 'C1' and dim_x = 400").count() == 30
    assert len(re.findall(r"Relation \[[^\]]*\btext#", found._jdf.queryExecution().optimizedPlan().toString())) == 1


@pytest.mark.parametrize("name", ["a19_a27_tier_counts", "a26_review_totals"])
def test_typing_and_review_broadcast_no_parts_columns_or_sheets(spark, monkeypatch, name):
    planned = []

    def recorded(df):
        planned.append(df._jdf.queryExecution().executedPlan().toString())
        return materialised(df)

    for module in (GD, R, S, model):
        monkeypatch.setattr(module, "materialised", recorded, raising=False)
    out = plans.queries()[name](spark, "/root/testdata/sf0.001")
    planned.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin [l_partkey" in p for p in planned)
    assert not any(re.search(r"BroadcastHashJoin \[(l_partkey|file_id|storey_id#\d+, canonical_idx)", p) for p in planned)
    assert out.count() > 1
