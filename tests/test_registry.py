"""Every registered query of the engine against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from rangeloom import registry

DATA = os.environ.get("RANGELOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df, cols):
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name not in registry.oracle_sql():
        assert len(got)
        return
    want = con.execute(registry.oracle_sql()[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
