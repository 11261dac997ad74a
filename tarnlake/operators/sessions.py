"""Sessions by gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import micros
from .runs import number_runs

GAP_SECONDS = 1800


def sessionize(events: DataFrame, gap_seconds: int = GAP_SECONDS, slice_seconds: int | None = None, hot: list | None = None) -> DataFrame:
    """Adds previous_event_time, user_session_seq and session_id.

    A gap of more than ``gap_seconds`` starts a session; exactly that gap does not. ``slice_seconds``
    splits the work of users with very many events by time, with ``hot`` that of these users alone; the
    result is the same.
    """
    apart = lambda before, now: micros(now["event_time"]) - micros(before["event_time"]) > gap_seconds * 1_000_000
    out = number_runs(events, "user_id", ["event_time", "event_key"], ["event_time"], apart, "user_session_seq", slice_seconds, hot)
    session = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("user_session_seq").cast("string"))
    return out.select(*events.columns, F.col("_previous.event_time").alias("previous_event_time"), "user_session_seq", session.alias("session_id"))


def session_summary(sessions: DataFrame) -> DataFrame:
    """A row for each user: sessions, events, purchases and the longest session in seconds."""
    one = sessions.groupBy("user_id", "session_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("p"), ((F.max(micros(F.col("event_time"))) - F.min(micros(F.col("event_time")))) / 1e6).alias("s"))
    return one.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.sum("p").alias("purchases"), F.round(F.max("s"), 3).alias("longest_seconds"))


def gap_violations(sessions: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Neighbouring events of one session that lie further apart than the gap; none if sessions are right."""
    own = Window.partitionBy("session_id").orderBy("event_time", "event_key")
    gap = (micros(F.col("event_time")) - micros(F.lag("event_time").over(own))) / 1e6
    return sessions.withColumn("gap_seconds", gap).filter(F.col("gap_seconds") > gap_seconds).select("session_id", "event_key", "gap_seconds")
