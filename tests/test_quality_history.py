"""quality_history against its SQL where events share times, lack them or lie in other years, and where means end in a half."""

import duckdb

from scholia.plans import QUERIES, SQL

EVENTS = """select event_id + k.k * 100000 as event_id, case when event_id % 97 = 3 then null else ts + interval 1 day * (k.k // 3 * 200) end as ts,
 case when event_id % 89 = 5 then null else event_type end as event_type, case when event_id % 83 > 0 then value end as value from '/root/testdata/sf0.001/events.parquet', range(9) k(k)"""
#: 32 scores of one time; their mean is 64.0121875, a million times which is short of a half in doubles.
HALVES = "select 10000000 + 4 * i + 1 as event_id, timestamp '2030-01-01' as ts, 'half' as event_type, case when i = 0 then 64.39::double else 64::double end as value from range(32) t(i)"


def compare(spark, made, path):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"copy ({made}) to '{path}/events.parquet'")
    con.sql(f"create view events as select * from '{path}/events.parquet'")
    want = con.sql(SQL["quality_history"])
    got = QUERIES["quality_history"](spark, str(path)).select(*want.columns)
    key = lambda r: (r[0], str(r))
    return sorted((tuple(r) for r in got.collect()), key=key), sorted(want.fetchall(), key=key)


def test_events_that_share_times(spark, tmp_path):
    got, want = compare(spark, EVENTS, tmp_path)
    assert got == want and len(got) == 9 * 1000
    assert any(r[1] > 9 for r in got) and len({r[1:] for r in got}) < len(got) / 2


def test_means_that_end_in_a_half(spark, tmp_path):
    got, want = compare(spark, HALVES, tmp_path)
    assert got == want and len(got) == 32
