"""Every query that has an oracle gives the rows that DuckDB gives for it on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from casebraid.plans.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    """A value that both engines' results can be ordered and compared by."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, dict):
        return str(sorted((str(k), plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_each_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert all(isinstance(sql, str) for sql in ORACLES.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_the_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = sorted(tuple(plain(row[c]) for c in columns) for row in frame.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert len(ours) == len(theirs)
    differing = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not differing, differing[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_an_oracle_run(spark, name):
    frame = QUERIES[name](spark, SF_DIR)
    assert frame.columns
    frame.collect()
