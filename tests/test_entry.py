"""Every query with an oracle, held against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pagemill.plans import layout_queries  # noqa: F401 registers its queries
from pagemill.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_oracle(spark, sf, duck, name):
    got = own.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = duck.execute(own.ORACLES[name])
    assert sorted(d[0] for d in want.description) == names
    order = [d[0] for d in want.description]
    rows = sorted(tuple(value(r[order.index(c)]) for c in names) for r in want.fetchall())
    assert sorted(tuple(value(r[c]) for c in names) for r in got.collect()) == rows


# Lines of two orders whose small pages have, behind a table's first gutter, another one.
TWO_GUTTERS = """
1040554 12310 1993 4 34 A F, 1040554 31618 848 3 2 N O, 1040554 44457 764 3 38 R F, 1040554 60753 669 2 34 N F, 1040554 61323 1405 3 18 N F,
1040554 62142 4388 3 35 N F, 1040554 62932 913 3 16 N F, 1040554 72680 3040 6 44 R O, 1040554 94760 3634 4 40 N F, 1040554 103603 170 1 47 N F,
677590 15858 2540 4 35 R F, 677590 26362 3864 2 29 R O, 677590 26483 2720 5 18 R F, 677590 34842 246 5 39 N F, 677590 66295 2473 2 18 R F,
677590 88706 5918 5 20 N O, 677590 94221 2147 2 24 N O, 677590 96708 1231 7 6 A O, 677590 97955 654 1 23 R F, 677590 110011 4569 6 33 N O"""


@pytest.mark.parametrize("name", ["rendered_small_pages", "notes"])
def test_two_gutters(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_shipdate TIMESTAMP)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?, ?, 1, 0, 0, '1996-01-01')", [r.split() for r in TWO_GUTTERS.split(",")])
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = own.QUERIES[name](spark, str(tmp_path))
    want = con.execute(own.ORACLES[name] + " ORDER BY page_id")
    names = [d[0] for d in want.description]
    assert [tuple(r[c] for c in names) for r in got.orderBy("page_id").collect()] == want.fetchall()


def test_rows_only(spark, sf):
    for name in set(own.QUERIES) - set(own.ORACLES):
        assert own.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
