"""A stream gives the rows of the batch plan for every window that its watermark has closed."""

from pyspark.sql import functions as F

from tessera.session import table
from tessera.streaming import events as E


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    t = table(spark, sf_dir, "events")
    t.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 250).parquet(str(tmp_path / "in"))
    s = E.windowed(E.read_stream(spark, str(tmp_path / "in"), t.schema), "1 day", late="400 days")
    assert s.isStreaming
    s = E.windowed(E.read_stream(spark, str(tmp_path / "in"), t.schema, 1), "1 day", late="1 day")
    for _ in range(2):  # the second run finds nothing new
        E.drain(s, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in E.windowed(t, "1 day").collect()}
    closed = t.agg(F.max("ts")).first()[0]
    assert got and all(want[k] == n for k, n in got.items())
    assert len(got) >= sum((closed - k[0]).days > 3 for k in want)
