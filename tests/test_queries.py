import duckdb
import pytest

from timberline import queries as Q
from timberline.operators import ordered

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_oracle(spark, sf, duck, name):
    got = Q.queries()[name](spark, sf)
    if name not in Q.oracle_sql():
        assert got.count() > 0
        return
    want = duck.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r) for r in got.select(*want.columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want.fetchall()))
    assert rows or name in ("alert_multi", "burst_detect", "alert_threshold", "alert_writer", "stream_alerts", "dedupe_windowed")


@pytest.mark.parametrize("range_rows", [400_000, 100])
@pytest.mark.parametrize("name", ["burst_rate", "burst_detect", "alert_threshold", "alert_multi", "alert_writer"])
def test_windows_hold_all_rows_of_equal_time(spark, sf, tmp_path, monkeypatch, name, range_rows):
    """30 events a time, as in a table that is repeated with shifted keys."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", range_rows)
    tied = duckdb.connect()
    tied.execute(f"COPY (SELECT e.* REPLACE (event_id * 30 + i AS event_id) FROM '{sf}/events.parquet' e, range(30) t(i)) TO '{tmp_path}/events.parquet'")
    tied.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = tied.sql(Q.oracle_sql()[name])
    got = [tuple(r) for r in Q.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()]
    assert got and sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
