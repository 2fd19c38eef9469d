"""Temporal observation of sampled sessions: wait for a change, for stability, or for a change that settles.

Sample i is taken at i * interval; samples after the first exist while that is below the timeout. The operators
are windows over the comparisons of the samples, so a session is one ordered partition and nothing loops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError


@dataclass(frozen=True)
class Schedule:
    interval_ms: int = 100
    timeout_ms: int = 5000
    stable_for_ms: int = 300

    def __post_init__(self):
        for name in ("interval_ms", "timeout_ms", "stable_for_ms"):
            if getattr(self, name) <= 0:
                raise EngineError("invalid_duration", f"{name} must be greater than zero")

    @property
    def samples(self) -> int:
        """Samples before the timeout."""
        return -(-self.timeout_ms // self.interval_ms)


def validate_temporal(interval: Column, timeout: Column, stable: Column, area: Column) -> Column:
    """The status of an observation's arguments: durations are above zero, the area threshold is 0 to 1."""
    return (
        F.when((interval <= 0) | (timeout <= 0) | (stable <= 0), "invalid_duration")
        .when(~area.between(0.0, 1.0), "invalid_arguments")
        .otherwise("ok")
    )


#: Most frames of a stack.
MAX_STACK = 8


def validate_realtime(frames: Column, timeout: Column, interval: Column) -> Column:
    """The status of a stack's arguments: 1 to MAX_STACK frames, a timeout, and an interval where there are several frames."""
    return (
        F.when(~frames.between(1, MAX_STACK), "invalid_arguments")
        .when((timeout <= 0) | ((frames > 1) & (interval <= 0)), "invalid_duration")
        .otherwise("ok")
    )


def ideal_offset(index: Column, interval: Column) -> Column:
    """When a stack's frame is due, after the first one."""
    return index * interval


def same_geometry(geometry: Column) -> Column:
    """An aggregate: whether all frames of a stack have one geometry, of any fields."""
    return F.when(F.min(geometry) == F.max(geometry), "ok").otherwise("geometry_changed")


def stack_status(frames: Column) -> Column:
    """A stack without frames is a failed observation."""
    return F.when(frames == 0, "observation_failed").otherwise("ok")


def sampled(samples: DataFrame, comparisons: DataFrame) -> DataFrame:
    """session_id, i, frame_id with the comparison of the sample's frame; a frame played again compares as unchanged.

    comparisons: session_id, frame_id, changed, changed_pixels of the frame against whatever precedes it.
    """
    previous = F.lag("frame_id").over(Window.partitionBy("session_id").orderBy("i"))
    s = samples.withColumn("again", F.coalesce(previous == F.col("frame_id"), F.lit(False)))
    c = comparisons.select("session_id", "frame_id", "changed", "changed_pixels")
    j = s.join(c, ["session_id", "frame_id"], "left")
    return j.select(
        "session_id",
        "i",
        "frame_id",
        "again",
        F.coalesce("changed", F.lit(False)).alias("changed"),
        F.coalesce("changed_pixels", F.lit(0)).alias("changed_pixels"),
    )


def _result(r: DataFrame, s: Schedule, samples: DataFrame) -> DataFrame:
    """Columns of an outcome: the sample it came at, its frame and comparison, and the ledger."""
    at = samples.select("session_id", F.col("i").alias("final_i"), F.col("frame_id").alias("final_frame_id"), "changed_pixels")
    return r.join(at, ["session_id", "final_i"])


def wait_change(baseline: DataFrame, s: Schedule) -> DataFrame:
    """First sample that changed from the baseline: changed, or timeout with the latest. baseline: see sampled."""
    hit = F.min(F.when(F.col("changed"), F.col("i")))
    r = baseline.groupBy("session_id").agg(hit.alias("k"), F.max("i").alias("last"))
    r = r.select(
        "session_id",
        F.when(F.col("k").isNotNull(), "changed").otherwise("timeout").alias("outcome"),
        F.coalesce("k", "last").alias("final_i"),
        F.when(F.col("k").isNotNull(), F.col("k") * s.interval_ms).otherwise(s.timeout_ms).alias("elapsed_ms"),
    )
    r = _result(r, s, baseline)
    return r.select(
        "session_id",
        "outcome",
        "final_frame_id",
        "changed_pixels",
        (F.col("final_i") + 1).alias("captures"),
        F.col("final_i").alias("comparisons"),
        "elapsed_ms",
    )


def _last_change(time: Column, changed: Column, start: Column) -> Column:
    """Running time of the latest change, start before any."""
    order = Window.partitionBy("session_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(changed, time)).over(order), start)


def wait_stable(consecutive: DataFrame, s: Schedule) -> DataFrame:
    """First unchanged sample at least stable_for after the latest change, counted from the start at first."""
    t = F.col("i") * s.interval_ms
    changed = F.col("changed") & ~F.col("again") & (F.col("i") > 0)
    c = consecutive.select("*", t.alias("t"), changed.alias("moved")).withColumn(
        "last_change", _last_change(F.col("t"), F.col("moved"), F.lit(0).cast("long"))
    )
    good = (F.col("i") > 0) & ~F.col("moved") & (F.col("t") - F.col("last_change") >= s.stable_for_ms)
    r = c.groupBy("session_id").agg(
        F.min(F.when(good, F.struct("i", "t", "last_change"))).alias("k"),
        F.max(F.struct("i", "t", "last_change")).alias("last"),
    )
    found = F.col("k").isNotNull()
    r = r.select(
        "session_id",
        F.when(found, "stable").otherwise("timeout").alias("outcome"),
        F.coalesce("k.i", "last.i").alias("final_i"),
        F.when(found, F.col("k.t") - F.col("k.last_change"))
        .otherwise(s.timeout_ms - F.col("last.last_change"))
        .alias("stable_ms"),
    )
    at = consecutive.select("session_id", F.col("i").alias("final_i"), F.col("frame_id").alias("final_frame_id"))
    return r.join(at, ["session_id", "final_i"]).select(
        "session_id",
        "outcome",
        "final_frame_id",
        "stable_ms",
        (F.col("final_i") + 1).alias("captures"),
        F.col("final_i").alias("comparisons"),
    )


def observe(baseline: DataFrame, consecutive: DataFrame, s: Schedule) -> DataFrame:
    """A change from the baseline, then stability. The phase never goes back; the changing sample never completes."""
    first = baseline.groupBy("session_id").agg(F.min(F.when(F.col("changed") & (F.col("i") > 0), F.col("i"))).alias("c"))
    t = F.col("i") * s.interval_ms
    rows = consecutive.join(first, "session_id").withColumn("t", t)
    late = F.col("i") > F.col("c")
    moved = F.coalesce(late & F.col("changed") & ~F.col("again"), F.lit(False))
    rows = rows.withColumn("moved", moved).withColumn(
        "last_change", _last_change(F.col("t"), F.col("moved"), F.col("c") * s.interval_ms)
    )
    good = late & ~F.col("moved") & (F.col("t") - F.col("last_change") >= s.stable_for_ms)
    r = rows.groupBy("session_id").agg(
        F.first("c").alias("c"), F.min(F.when(good, F.struct("i", "t", "last_change"))).alias("k"), F.max("i").alias("last")
    )
    final = F.coalesce("k.i", "last")
    at = consecutive.select("session_id", F.col("i").alias("final_i"), F.col("frame_id").alias("final_frame_id"))
    change = baseline.select("session_id", F.col("i").alias("c"), F.col("frame_id").alias("first_change_frame_id"))
    r = r.withColumn("final_i", final).join(at, ["session_id", "final_i"]).join(change, ["session_id", "c"], "left")
    return r.select(
        "session_id",
        F.when(F.col("k").isNotNull(), "observed").otherwise("timeout").alias("outcome"),
        (F.col("c") * s.interval_ms).alias("change_detected_ms"),
        "first_change_frame_id",
        "final_frame_id",
        (F.col("final_i") + 1).alias("captures"),
        F.col("final_i").alias("comparisons"),
        (F.col("k.t") - F.col("k.last_change")).alias("stable_ms"),
    )


def ledger(captures: DataFrame) -> DataFrame:
    """session_id, captures, comparisons, capture_us, elapsed_us, sleep_us from captures (session_id, at_us, duration_us)."""
    end = F.col("at_us") + F.col("duration_us")
    r = captures.groupBy("session_id").agg(
        F.count("*").alias("captures"),
        (F.count("*") - 1).alias("comparisons"),
        F.sum("duration_us").alias("capture_us"),
        (F.max(end) - F.min("at_us")).alias("elapsed_us"),
    )
    return r.withColumn("sleep_us", F.greatest(F.lit(0), F.col("elapsed_us") - F.col("capture_us")))


def next_deadline(due: Column, now: Column, interval: Column) -> Column:
    """The deadline itself, or the next slot after ``now`` once it has passed."""
    behind = F.floor((now - due) / interval)
    return F.when(now <= due, due).otherwise(due + interval * (behind + 1))


def sample_stack(durations: DataFrame, frames: int, interval: int, timeout: int, keys: list[str] | None = None) -> DataFrame:
    """Up to ``frames`` samples at slots of a fixed origin, for each row of durations (keys, d: array).

    Missed slots are skipped and counted, never replayed; the timeout gates only starts; sample i takes d[i], and
    samples end where d does. Returns keys (session_id unless named), offsets (each capture's end), skipped and the outcome.
    """
    if not 1 <= frames <= 8 or timeout <= 0 or frames > 1 and interval <= 0:
        raise EngineError("invalid_arguments", "1 to 8 frames, a positive timeout, and a positive interval for more than one")
    state = "named_struct('now', 0L, 'skipped', 0L, 'offsets', cast(array() as array<bigint>), 'open', true)"
    ready = f"s.now < {timeout} and greatest(s.now, slot) < {timeout}"
    step = f"""transform(array(greatest(i * {interval}L, (s.now + {interval - 1}L) div {interval}L * {interval}L)), slot ->
        named_struct(
            'now', if({ready}, greatest(s.now, slot) + d[i], greatest(s.now, slot)),
            'skipped', s.skipped + (slot - i * {interval}L) div {interval}L,
            'offsets', if({ready}, array_append(s.offsets, greatest(s.now, slot) + d[i]), s.offsets),
            'open', {ready}))[0]"""
    fold = F.expr(f"aggregate(sequence(0, {frames} - 1), {state}, (s, i) -> if(s.open and i < size(d), {step}, s))")
    r = durations.withColumn("r", fold)
    return r.select(
        *(keys or ["session_id"]),
        F.col("r.offsets").alias("offsets"),
        F.size("r.offsets").alias("captured"),
        F.col("r.skipped").alias("skipped"),
        F.when(F.size("r.offsets") >= frames, "complete").otherwise("partial").alias("outcome"),
    )
