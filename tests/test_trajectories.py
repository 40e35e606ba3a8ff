"""Trajectory metrics of event tables that start at 0 or lack values: the rows of their SQL twin."""

import math

import duckdb

from tessera.plans import ORACLE_SQL, QUERIES

ROWS = [
    (1, 7, 0.0), (2, 7, 5.0),  # starts at 0
    (3, 8, 0.0), (4, 8, 0.0),  # never above 0
    (5, 9, None), (6, 9, 400.0), (7, 9, 2.0), (8, 9, 90.0), (9, 9, None),  # no value first and last
    (10, 10, 100.0), (11, 10, 0.5), (12, 10, 20.0),
    (13, 11, None),
    (14, 12, -5.0), (15, 12, 3.0),
]


def plain(rows):
    def value(v):
        return None if v is None else "nan" if isinstance(v, float) and math.isnan(v) else v if isinstance(v, bool) else round(float(v), 6)

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


def test_zero_start_and_missing_values(spark, tmp_path):
    e = spark.createDataFrame(ROWS, "event_id long, user_id long, value double").selectExpr("event_id", "user_id", "value", "timestamp_seconds(event_id) AS ts")
    e.write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    names = ("user_id", "start", "nadir", "end", "log10_drop", "rebound")
    got = plain(QUERIES["j09_trajectory_metrics"](spark, str(tmp_path)).select(*names).collect())
    want = c.execute(f'SELECT user_id, start, nadir, "end", log10_drop, rebound FROM ({ORACLE_SQL["j09_trajectory_metrics"]}) x').fetchall()
    assert got == plain(want)
    assert dict((r[0], r[4]) for r in got)[7.0] == -math.inf
