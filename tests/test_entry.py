"""The driver's contract, and every oracle on the smallest tables."""

import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry
from plinth import plans
from plinth.plans.views import view

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (datetime.datetime, str, bool)):
        return value
    return round(float(value), 6)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.queries()) <= set(entry.queries())


@needs_tables
def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(5).count() == 5


@needs_tables
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    cursor = db.execute(plans.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted([tuple(map(plain, r)) for r in cursor.fetchall()], key=repr)
    df = plans.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted([tuple(map(plain, r)) for r in df.select(*columns).collect()], key=repr) == want


def test_every_query_has_an_oracle():
    assert set(plans.queries()) == set(plans.oracle_sql())


@needs_tables
def test_whole_tables_are_read(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    run = plans.queries()
    assert run["u1_u2_all_pages"](spark, SMALL).count() == lines
    assert run["p43_all_levels"](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/part.parquet").count() > 2
    assert view(spark, SMALL, "v_all_dims").count() == lines == view(spark, SMALL, "v_dims").count()
    assert run["u1_u2_pooled_pages"](spark, SMALL).count() == lines
    assert run["p43_default_levels"](spark, SMALL).where("name like 'Level%'").count() > 0 < run["p43_default_levels"](spark, SMALL).where("name like 'level%'").count()
