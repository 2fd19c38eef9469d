"""Keyed sessions: bounded histories, lookups and the session state machine, as windows over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError, is_session_fatal

MAX_CAPACITY = 256


def check_capacity(capacity: int) -> int:
    if not 1 <= capacity <= MAX_CAPACITY:
        raise EngineError("invalid_arguments", f"history capacity must be 1 to {MAX_CAPACITY}, got {capacity}")
    return capacity


def validate_create(capacity: Column, width: Column) -> Column:
    """The status of a session's arguments: the capacity is checked before the region."""
    return F.when(~capacity.between(1, MAX_CAPACITY), "invalid_arguments").when(width == 0, "invalid_region").otherwise("ok")


def retained_window(frames: DataFrame, capacity: int) -> DataFrame:
    """The newest ``capacity`` frames of each session: newest id less capacity, without sorting a session."""
    check_capacity(capacity)
    newest = frames.groupBy("session_id").agg(F.max("frame_id").alias("newest"))
    return frames.join(newest, "session_id").filter(F.col("frame_id") > F.col("newest") - capacity).drop("newest")


def evicted_frames(frames: DataFrame, retained: DataFrame) -> DataFrame:
    return frames.select("session_id", "frame_id").join(retained, ["session_id", "frame_id"], "left_anti")


def history_summary(frames: DataFrame, capacity: int) -> DataFrame:
    """Capacity, retained frames, oldest and newest id, all captured, retained bytes of each session."""
    check_capacity(capacity)
    s = frames.groupBy("session_id").agg(
        F.max("frame_id").alias("newest"), F.count("*").alias("captured_total"), F.first("bytes").alias("bytes")
    )
    kept = F.least(F.col("captured_total"), F.lit(capacity))
    return s.select(
        "session_id",
        F.lit(capacity).alias("capacity"),
        kept.cast("long").alias("retained"),
        (F.col("newest") - kept + 1).alias("oldest_id"),
        F.col("newest").alias("newest_id"),
        "captured_total",
        (kept * F.col("bytes")).cast("long").alias("retained_bytes"),
    )


def frame_lookup(requests: DataFrame, summary: DataFrame) -> DataFrame:
    """request_id, status of each request (session_id, frame_id): ok, evicted, not captured yet, or no session."""
    j = requests.join(summary.select("session_id", "oldest_id", "newest_id"), "session_id", "left")
    status = (
        F.when(F.col("newest_id").isNull(), "session_not_found")
        .when(F.col("frame_id") > F.col("newest_id"), "frame_not_available (future)")
        .when(F.col("frame_id") < F.col("oldest_id"), "frame_not_available (evicted)")
        .otherwise("ok")
    )
    return j.select("request_id", status.alias("status"))


def latest_frame(frames: DataFrame) -> DataFrame:
    """Newest frame of each session."""
    return frames.groupBy("session_id").agg(F.max_by("event_id", "frame_id").alias("event_id"), F.max("frame_id").alias("frame_id"))


def state_machine(log: DataFrame) -> DataFrame:
    """session_id, seq, status, state after each event (begin, end, capture, close, fail).

    begin while observing and close while observing are refused (session_busy); a closed or failed session refuses
    all. Observing is whether the latest begin or end was a begin, so no event needs more than its session's prefix.
    """
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    toggle = F.when(F.col("event").isin("begin", "end"), F.col("event"))
    rows = log.withColumn("observing", F.coalesce(F.last(toggle, ignorenulls=True).over(before) == "begin", F.lit(False)))
    ends = F.when((F.col("event") == "close") & ~F.col("observing"), "closed").when(F.col("event") == "fail", "failed")
    rows = rows.withColumn("ends", ends).withColumn("over", F.first("ends", ignorenulls=True).over(before))
    status = (
        F.when(F.col("over") == "closed", "session_closed")
        .when(F.col("over") == "failed", "session_closed (failed)")
        .when(F.col("event").isin("begin", "close") & F.col("observing"), "session_busy")
        .otherwise("ok")
    )
    now = F.when(F.col("event") == "begin", "observing").when(F.col("event") == "end", "ready").otherwise(
        F.when(F.col("observing"), "observing").otherwise("ready")
    )
    state = F.coalesce("over", "ends", now)
    return rows.select("session_id", "seq", "event", status.alias("status"), state.alias("state"))


def exclusive(state: Column) -> Column:
    """Status of a request that needs the session to itself."""
    return F.when(state == "observing", "session_busy").when(state.isin("closed", "failed"), "session_closed").otherwise("ok")


def window_lost(code: Column, created: Column) -> Column:
    """A window missing after its session's creation is a lost target."""
    return F.when((code == "window_not_found") & created, "target_lost").otherwise(code)


def state_after(code: Column) -> Column:
    """State of a session after an error of this code."""
    return F.when(is_session_fatal(code), "failed").otherwise("ready")


def list_sessions(summary: DataFrame) -> DataFrame:
    """Sessions by id, as text."""
    return summary.withColumn("session", F.concat(F.lit("s-"), F.col("session_id").cast("string"))).orderBy("session")


def wall_clock(now_wall: Column, now_steady: Column, steady: Column) -> Column:
    """Wall time of a moment of the steady clock, by one reading of both clocks."""
    return now_wall - (now_steady - steady)
