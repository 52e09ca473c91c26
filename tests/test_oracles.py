"""Every registered query of the evidence engine against its SQL, over whole small tables."""

import decimal
import math

import duckdb
import pytest

from strandlake.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.5f}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want
