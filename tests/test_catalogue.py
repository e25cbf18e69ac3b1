"""Every query against its SQL, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tests.conftest import DATA
from tideline.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    v = float(v) if isinstance(v, decimal.Decimal) else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.11g}"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    names = sorted(ours.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in ours.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
    assert got == want


def test_every_company_is_flattened(spark):
    from tideline.sources import bridge

    companies = {r["cik"] for r in bridge.observations(spark, DATA).select("cik").distinct().collect()}
    assert {r["cik"] for r in QUERIES["json_flatten_whole"](spark, DATA).select("cik").distinct().collect()} == companies and max(companies) >= 20


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
