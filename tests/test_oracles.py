"""Every registered query of the panel library against its DuckDB statement."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from tidemark.jobs import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Suppliers are too few there for cells of eight, but all other paths run.
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v.isoformat()[:10] if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = [tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
    other = [tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()]
    assert sorted(rows, key=repr) == sorted(other, key=repr)


def test_rows_only(spark):
    for name in ("composite", "score_ridge"):
        assert registry.queries()[name](spark, SF).count() > 0
