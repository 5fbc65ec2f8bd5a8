from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from loomline.queries import QUERIES, SQL

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in SMALL.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    yield con
    con.close()


def comparable(rows):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not SMALL.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, tables, name):
    got = QUERIES[name](spark, str(SMALL))
    want = tables.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert comparable(got.select(*columns).collect()) == comparable(want.fetchall())
