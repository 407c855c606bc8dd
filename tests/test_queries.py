"""Every query of the core runs on the smallest tables and equals its SQL there."""

import math
from pathlib import Path

import duckdb
import pytest

from granthvahi.plans import QUERIES, SQL
from tests.conftest import DATA


def norm(v):
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return tuple(sorted((k, norm(x)) for k, x in v.items())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    if name in SQL:
        assert sorted(con.sql(SQL[name]).columns) == cols
        assert rows == sorted((tuple(map(norm, r)) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()), key=repr)


def test_entry_runs_without_the_llm_folder(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
