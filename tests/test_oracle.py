"""Every registered query with SQL gives the same rows in both engines."""

import math

import duckdb
import pytest

from tests.conftest import SF_DIR
from tidemark import catalog

catalog.load_all()
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def clean(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else value


def rows_of(rows, order):
    return sorted((tuple(str(clean(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    result = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    ours = rows_of(df.select(*cols).collect(), range(len(cols)))
    theirs = rows_of(result.fetchall(), [names.index(c) for c in cols])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_with_stable_schema(spark, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    assert df.schema == catalog.QUERIES[name](spark, SF_DIR).schema
    df.collect()
