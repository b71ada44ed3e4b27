"""Every registered query of the engine against its SQL, over the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from lorekeeper.plans import queries_graph, queries_ingestion, queries_maintenance, queries_more, queries_search, queries_store, queries_surface, registry  # noqa: F401

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = df.select(*want.columns).collect()
    assert sorted(repr(plain(r)) for r in map(list, rows)) == sorted(repr(plain(r)) for r in want.fetchall())


def test_all_queries_have_sql_or_a_test():
    assert set(registry.QUERIES) - set(registry.SQL) == {"d16_fuzzy_matches", "v1_index_probed"}
