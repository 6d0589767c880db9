"""Queries of the streaming extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import lens
from ..streaming import events as S
from .registry import query

_DAYS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _plain(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("X1_windowed_events", _DAYS)
def windowed(s, d):
    return _plain(S.windowed(lens.load(s, d, "events"))).withColumn("total", F.round("total", 4))


@query("X2_streamed_windows", _DAYS)
def streamed(s, d):
    """The same counts from a stream of the events' files, complete at its end."""
    schema = lens.load(s, d, "events").schema
    return _plain(S.drained(S.windowed(S.files(s, d, schema, "events.parquet")), "complete")).withColumn("total", F.round("total", 4))


@query("X3_streamed_distinct", "SELECT DISTINCT event_id, event_type FROM events")
def distinct(s, d):
    schema = lens.load(s, d, "events").schema
    return S.drained(S.first_seen(S.files(s, d, schema, "events.parquet"))).select("event_id", "event_type")


@query(
    "X4_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k""",
)
def sessions(s, d):
    return _plain(S.sessions(lens.load(s, d, "events")))
