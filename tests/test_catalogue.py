"""Every catalogue query runs, and agrees with its DuckDB SQL value by value."""

from __future__ import annotations

import duckdb
import pytest

from skein.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(rows, key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_epoch_ms_iso_of_ids_of_a_large_table(spark, duck, tmp_path):
    """Ids from 2932897 on give years beyond 9999."""
    ids = [0, 2932896, 2932897, 5999999, 106751970, None]
    spark.createDataFrame([(i,) for i in ids], "event_id bigint").write.parquet(str(tmp_path / "events.parquet"))
    want = duck.sql(SQL["epoch_ms_iso"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    rows = [(r.event_id, r.iso) for r in QUERIES["epoch_ms_iso"](spark, str(tmp_path)).collect()]
    assert len(want) == len(ids) and sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
