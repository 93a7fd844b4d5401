"""All engine queries against their SQL on the smallest tables, and the driver's contract."""

from collections import Counter
from decimal import Decimal

import duckdb

import __spark_entry__ as driver
from quernal import boundary_queries as boundaries
from quernal import queries as engine

SF = "/root/testdata/sf0.001"


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return int(v) if isinstance(v, Decimal) else v


def test_contract(spark):
    assert set(engine.QUERIES) | set(boundaries.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("part", "customer", "lineitem", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wrong = []
    sqls = driver.oracle_sql()
    for name, query in (engine.QUERIES | boundaries.QUERIES).items():
        df, sql = query(spark, SF), con.sql(sqls[name])
        cols = sorted(df.columns)
        assert cols == sorted(sql.columns), name
        at = [sql.columns.index(c) for c in cols]
        want = Counter(tuple(normal(r[i]) for i in at) for r in sql.fetchall())
        if Counter(tuple(normal(r[c]) for c in cols) for r in df.collect()) != want:
            wrong.append(name)
    assert not wrong
