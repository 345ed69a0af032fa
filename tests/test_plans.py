"""Every registered query of the engine against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from folioscope.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def rows(table):
    """Sorted rows with columns by name; numbers by value."""
    names = sorted(table.column_names)
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DATA).toArrow()
    assert got.num_columns
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows
    else:
        assert rows(got) == rows(con.sql(sql).to_arrow_table())
