"""Draws far ahead, whose years have five digits or whose dates are past the fixed day, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from tallyforge.plans import registry

from test_oracles import canonical

#: Added to the order keys: draws begin in the year 11226 and end past the fixed day of S17 by an odd number of days.
FAR = 16_000_000


@pytest.fixture(scope="module")
def far(tmp_path_factory, sf) -> str:
    folder = tmp_path_factory.mktemp("far")
    duckdb.connect().sql(f"COPY (SELECT * REPLACE (l_orderkey + {FAR - 2_000_000} AS l_orderkey) FROM '{sf}/lineitem.parquet' UNION ALL SELECT * FROM '{sf}/lineitem.parquet') TO '{folder}/lineitem.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["D1_calendar", "S17_status", "S3_parse_record", "S5_summary", "S7_versions", "S0_draw_table", "S11_parse_issue"])
def test_far_dates(spark, far, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{Path(far) / 'lineitem.parquet'}'")
    ours, theirs = canonical(registry.QUERIES[name](spark, far).toPandas()), canonical(duck.sql(registry.SQL[name]).df())
    wrong = sum(a != b for a, b in zip(ours, theirs))
    assert len(ours) == len(theirs) and not wrong, f"{wrong} of {len(theirs)} rows differ"
