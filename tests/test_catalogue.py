import math
from pathlib import Path

import duckdb
import pytest

from shardloom.plans import catalogue, catalogue_engine

DATA = Path("/root/testdata/sf0.001")
NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ == catalogue_engine.__name__]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return (round(v, 6) if math.isfinite(v) else str(v)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_engine_query_equals_its_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    found = duck.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr([plain(v) for v in r]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want
