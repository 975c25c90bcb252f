"""Every registered query against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    frame = registry.QUERIES[name](spark, sf)
    rows = frame.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = c.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(plain(r[names.index(k)]) for k in sorted(names)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in sorted(names)) for r in rows), key=repr) == want


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_session_activity_at_the_gap(spark, tmp_path):
    """Events exactly an hour apart are of two sessions; null times and null users stay."""
    at = ["2024-01-01 00:00:00", "2024-01-01 01:00:00.9", "2024-01-01 02:00:00", "2024-01-01 03:00:00", "2024-01-01 03:00:00", "2024-01-01 03:59:59", None]
    rows = [(u * 10 + k, t, u or None) for u in (0, 1) for k, t in enumerate(at)] + [(30, None, 2), (31, None, 2)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = c.execute(registry.ORACLES["session_activity"]).fetchall()
    got = registry.QUERIES["session_activity"](spark, str(tmp_path)).select("user_id", "session_start", "session_end", "n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and sorted(n for *_, n in want) == [1] * 6 + [2, 4, 4]
