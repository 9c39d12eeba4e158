"""Every query with SQL against DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import registry


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v) -> str:
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, sf, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0
