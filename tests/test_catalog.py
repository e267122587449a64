"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from laurel.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([shown(x) for x in value])
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, spark, sf, con):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.SQL:
        return
    found = con.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [list(found.columns).index(c) for c in columns]
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())


def test_token_pairs_of_all_parts(spark, sf, con):
    parts = con.sql("SELECT p_partkey, p_size, p_name, p_type FROM part").fetchall()
    words = [(k, size, set(name.split()), kind) for k, size, name, kind in parts]
    pairs = {(min(x[0], y[0]), max(x[0], y[0])): x[3] == y[3] for i, x in enumerate(words) for y in words[:i] if x[1] == y[1] and x[2] & y[2]}
    assert {(r.a, r.b) for r in catalog.QUERIES["token_pairs_jaccard_all"](spark, sf).collect()} == set(pairs)
    assert not all(pairs.values())


def test_medal_order_is_whole(spark, sf, con):
    rows = catalog.QUERIES["sort_by_medal_whole_order"](spark, sf).collect()
    assert len(rows) == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert {r.medal for r in rows} == {"Gold", "Silver", "Bronze", None} and any(r.position is None for r in rows)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
