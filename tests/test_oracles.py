"""Every registered query against its SQL in DuckDB, where the training-data subpackage is not needed."""

import duckdb
import pytest

from tideline.oracles import ORACLES
from tideline.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        want = sorted((tuple(rounded(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        assert sorted(names) == columns and got == want
