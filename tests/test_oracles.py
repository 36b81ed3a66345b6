"""Every query that SQL can express against DuckDB, and that the others run."""

from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from tidewater.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 5) if isinstance(v, float) else float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, sf, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    types = dict(zip(want.columns, map(str, want.types)))
    assert all(KINDS[t] == types[c] for c, t in df.dtypes)
    rows = want.select(*[f'"{c}"' for c in cols]).fetchall()
    assert Counter(tuple(map(plain, r)) for r in df.select(*cols).collect()) == Counter(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
