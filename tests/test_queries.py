"""Every registered query of the library runs on the smallest tables, and gives the rows of its SQL where it has any."""

import duckdb
import pytest

from sheetdelta import catalogue
from sheetdelta.plans import queries as plan_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def compared_once():
    """The queries over changes share one comparison here."""
    original, known = plan_queries._compared, {}

    def once(spark, sf_dir):
        if sf_dir not in known:
            known[sf_dir] = original(spark, sf_dir)
        return known[sf_dir]

    plan_queries._compared = once
    yield
    plan_queries._compared = original


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, data, name):
    df = catalogue.queries()[name](spark, data)
    names = sorted(df.columns)
    rows = plain(df.select(*names).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == names
        assert rows == plain(want.project(", ".join(f'"{c}"' for c in names)).fetchall())
    else:
        assert rows


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 7
