"""Queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from plinth.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    cursor = db.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    df = Q.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(columns)
    assert sorted([tuple(r) for r in df.select(*columns).collect()], key=repr) == want


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in Q.queries())
    assert numbers == list(range(1, 14))
