"""Queries: the rules of the event pipeline (t), on the table of events; tests run the same functions as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeplane.plans.common import collect
from lodeplane.sources.tables import table
from lodeplane.streaming import events

SQL: dict[str, str] = {}


def t1_sessions(spark, d):
    """Sessions of each user with a gap of 30 minutes: number of events and the last one."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return events.sessions(e, ["user_id"], "ts", "30 minutes").select("user_id", "events", "event_id", "event_type")


SQL["t1_sessions"] = """WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, count(*) AS events, max(struct_pack(t := ts, i := event_id, e := event_type)).i AS event_id, max(struct_pack(t := ts, i := event_id, e := event_type)).e AS event_type FROM s GROUP BY user_id, sid"""


def t4_coalesced(spark, d):
    """Per user and day the value before the first event and the one after the last: what a coalesced push says."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    return e.groupBy("user_id", "day").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("events"))


SQL["t4_coalesced"] = "SELECT user_id, CAST(ts AS DATE) AS day, min(struct_pack(t := ts, i := event_id, e := event_type)).e AS first_type, max(struct_pack(t := ts, i := event_id, e := event_type)).e AS last_type, count(*) AS events FROM events GROUP BY 1, 2"


def t5_stale(spark, d):
    """Events whose value is not the latest of their user and type."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    latest = e.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))
    return events.stale(e, latest, ["user_id", "event_type"], "value", "latest").groupBy("event_type").agg(F.count("*").alias("n"))


SQL["t5_stale"] = "WITH k AS (SELECT *, first_value(value) OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS latest FROM events) SELECT event_type, count(*) AS n FROM k WHERE latest IS NULL OR value <> latest GROUP BY 1"


def t_tumbling(spark, d):
    return events.windows(table(spark, d, "events"), "event_type", "ts", "1 day").select("event_type", F.date_format("started", "yyyy-MM-dd").alias("day"), "events")


SQL["t_tumbling"] = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1, 2"

QUERIES, ORACLE = collect(globals(), SQL)
