import glob
import os

import duckdb
import pytest

from stratakv.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    d = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        d.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return d


def tidy(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_its_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name in catalog.ORACLES:
        rel = db.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == columns
        assert tidy(got) == tidy(rel.select(*columns).fetchall())
    else:
        assert got
