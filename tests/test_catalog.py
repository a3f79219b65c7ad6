"""Every registered query of the engine itself against its SQL, over the whole smallest tables."""

import os

import duckdb
import pytest

from sparkloom import catalog

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for name in os.listdir(FOLDER):
        found.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return found


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    sql = con.sql(catalog.oracle_sql()[name])
    assert sorted(sql.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, df.select(*columns).collect())) == plain(con.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_every_query_without_sql_returns_rows(spark):
    for name in set(catalog.queries()) - set(NAMES):
        assert catalog.queries()[name](spark, FOLDER).count() > 0
