"""Every query against its SQL twin in DuckDB, on whole small tables."""
import glob
import os

import duckdb
import pytest

from bindings import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "null" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(shown, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())
