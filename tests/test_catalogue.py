"""Every catalogue query with an oracle against DuckDB at sf0.001; the others run."""

import duckdb
import pytest

from tidewave import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


def normal(v):
    return "null" if v is None else f"{v + 0.0:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, D)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = db.sql(sql)
    cols, want = r.columns, r.fetchall()
    assert sorted(df.columns) == sorted(cols)
    keys = sorted(cols)
    assert sorted(tuple(normal(x[k]) for k in keys) for x in rows) == sorted(tuple(normal(x[cols.index(k)]) for k in keys) for x in want)
