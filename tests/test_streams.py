"""The event pipeline run as streams gives what it gives on tables."""

import datetime as dt

from lodeplane.streaming import events as E


def rows(spark):
    t0 = dt.datetime(2025, 1, 1)
    data = [("u", i, "click", t0 + dt.timedelta(minutes=m)) for i, m in enumerate((0, 10, 35, 70, 100))] + [("v", 9, "error", t0), ("w", 10, "view", t0 + dt.timedelta(days=3))]
    return spark.createDataFrame(data, "user_id string, event_id int, event_type string, ts timestamp")


def test_sessions_in_batch_and_stream(spark, tmp_path):
    df = rows(spark)
    batch = {(r.user_id, r.events, r.event_id) for r in E.sessions(df, ["user_id"], "ts", "30 minutes").collect()}
    assert batch == {("u", 3, 2), ("u", 2, 4), ("v", 1, 9), ("w", 1, 10)}
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.where("user_id <> 'w'").coalesce(1).write.parquet(src)
    s = E.sessions(E.read_files(spark, src, df.schema), ["user_id"], "ts", "30 minutes", late="1 hour")
    E.run_once(s, out, str(tmp_path / "c"))
    df.where("user_id = 'w'").coalesce(1).write.mode("append").parquet(src)  # moves the watermark past the sessions
    E.run_once(s, out, str(tmp_path / "c"))
    got = {(r.user_id, r.events, r.event_id) for r in spark.read.parquet(out).collect()}
    assert got == batch - {("w", 1, 10)}


def test_latest_per_key(spark, tmp_path):
    df = rows(spark)
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    df.where("event_id < 3").coalesce(1).write.parquet(src)
    s = E.read_files(spark, src, df.schema, 1)
    E.keep_latest(s, ["user_id"], "ts", state, str(tmp_path / "c"))
    df.where("event_id >= 3").coalesce(1).write.mode("append").parquet(src)
    E.keep_latest(s, ["user_id"], "ts", state, str(tmp_path / "c"))
    assert {(r.user_id, r.event_id) for r in E.latest_version(spark, state).collect()} == {("u", 4), ("v", 9), ("w", 10)}
    assert E.latest_version(spark, str(tmp_path / "none")) is None


def test_stale_and_windows(spark):
    c = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1")], "k string, seen string")
    now = spark.createDataFrame([("a", "h1"), ("b", "h2")], "k string, cur string")
    assert {r.k for r in E.stale(c, now, ["k"], "seen", "cur").collect()} == {"b", "c"}
    assert sum(r.events for r in E.windows(rows(spark), "event_type", "ts", "1 day").collect()) == 7
