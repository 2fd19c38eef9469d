"""Streaming observation: a state machine for each session, fed by comparisons as they arrive.

State is a few numbers a session, whatever its length: no frame is kept. The batch operators of
operators.temporal give the same outcomes over a finished log.

Where samples carry the time they were taken at and the stream has a watermark on it, a timer of event time ends a session
that falls silent, as its total timeout asks: with the latest sample it has seen, once the watermark passes the session's
first sample and the timeout. A finished session's state goes at that time, too.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.temporal import Schedule

#: A session's state: values that all machines keep, then the machine's own.
_KEPT = "next_i long, frame_id long, began_ms long, done boolean"


def _machine(samples: DataFrame, schedule: Schedule, at: str | None, out: str, own: str, begin: tuple, step: Callable, ended: Callable) -> DataFrame:
    """Outcomes of a state machine for each session of a stream of samples (session_id, i, frame_id, ...).

    step: (row, own values) to (own values, a finished outcome or None). ended: (own values, i, frame_id) to the outcome
    of the total timeout. Rows of a micro-batch may come in any order of i; samples before the next expected one are
    dropped as late (a missed slot is never replayed), and rows after the outcome are ignored. at: the column of time.
    """
    last = schedule.samples - 1
    names = [c.split()[0] for c in out.split(", ")]

    def made(key, outcome):
        return pd.DataFrame([[key[0], *outcome]], columns=names).astype({n: "Int64" for n in names if n != "outcome"})

    def run(key, batches, state: GroupState):
        next_i, frame_id, began, done, *values = state.get if state.exists else (0, 0, -1, False, *begin)
        if state.hasTimedOut:
            state.remove()
            if not done and next_i > 0:
                yield made(key, ended(values, next_i - 1, frame_id))
            return
        rows = pd.concat(list(batches)).sort_values("i", kind="stable")
        outcome = None
        for r in rows.itertuples(index=False):
            if done or r.i < next_i or r.i > last:
                continue
            if at and began < 0:
                began = int(getattr(r, at).timestamp() * 1000) - r.i * schedule.interval_ms
            next_i, frame_id = r.i + 1, r.frame_id
            values, outcome = step(r, values)
            if outcome is None and r.i == last:
                outcome = ended(values, r.i, r.frame_id)
            done = outcome is not None
        end = began + schedule.timeout_ms
        if at and began >= 0 and end <= state.getCurrentWatermarkMs():  # the time is over already
            if not done:
                outcome, done = ended(values, next_i - 1, frame_id), True
            end = state.getCurrentWatermarkMs() + 1
        state.update((int(next_i), int(frame_id), int(began), bool(done), *values))
        if at and began >= 0:
            state.setTimeoutTimestamp(int(end))
        if outcome is not None:
            yield made(key, outcome)

    timer = GroupStateTimeout.EventTimeTimeout if at else GroupStateTimeout.NoTimeout
    return samples.groupBy("session_id").applyInPandasWithState(run, out, f"{_KEPT}, {own}", "append", timer)


def stream_wait_stable(samples: DataFrame, schedule: Schedule, at: str | None = None) -> DataFrame:
    """Outcome of wait_stable for each session of a stream of samples (session_id, i, frame_id, changed)."""
    interval, stable = schedule.interval_ms, schedule.stable_for_ms

    def step(r, values):
        [last_change] = values
        if r.i > 0 and r.changed:
            return [int(r.i * interval)], None
        still = r.i * interval - last_change
        return values, ("stable", r.i, r.frame_id, still) if r.i > 0 and still >= stable else None

    ended = lambda values, i, frame_id: ("timeout", i, frame_id, schedule.timeout_ms - values[0])
    out = "session_id long, outcome string, final_i long, final_frame_id long, stable_ms long"
    return _machine(samples, schedule, at, out, "last_change long", (0,), step, ended)


def stream_wait_change(samples: DataFrame, schedule: Schedule, at: str | None = None) -> DataFrame:
    """Outcome of wait_change for each session of a stream of samples compared to their baseline."""

    def step(r, values):
        return values, ("changed", r.i, r.frame_id) if r.changed else None

    ended = lambda values, i, frame_id: ("timeout", i, frame_id)
    out = "session_id long, outcome string, final_i long, final_frame_id long"
    return _machine(samples, schedule, at, out, "none boolean", (False,), step, ended)


def stream_observe(samples: DataFrame, schedule: Schedule, at: str | None = None) -> DataFrame:
    """Outcome of observe: a change from the baseline, then stability. Samples have from_baseline and changed (from the
    frame before). The phase never goes back; the changing sample never completes."""
    interval, stable = schedule.interval_ms, schedule.stable_for_ms

    def step(r, values):
        began, first, last_change = values
        if began < 0:
            return ([int(r.i), int(r.frame_id), int(r.i * interval)] if r.i > 0 and r.from_baseline else values), None
        if r.changed:
            return [began, first, int(r.i * interval)], None
        still = r.i * interval - last_change
        return values, ("observed", began * interval, first, r.i, r.frame_id, still) if still >= stable else None

    def ended(values, i, frame_id):
        began, first, _ = values
        return ("timeout", began * interval if began >= 0 else None, first if began >= 0 else None, i, frame_id, None)

    out = "session_id long, outcome string, change_detected_ms long, first_change_frame_id long, final_i long, final_frame_id long, stable_ms long"
    return _machine(samples, schedule, at, out, "began long, first_frame long, last_change long", (-1, -1, 0), step, ended)


def stream_history(frames: DataFrame, capacity: int) -> DataFrame:
    """Running history of each session of a stream of frames (session_id, event_id): ids are assigned in order of
    arrival, and the newest ``capacity`` are kept in state. Emits the summary after each micro-batch."""
    kind = "session_id long, captured_total long, oldest_id long, newest_id long, retained array<long>"

    def step(key, batches, state: GroupState):
        total, kept = state.get if state.exists else (0, [])
        for b in batches:
            for event_id in b.sort_values("event_id").event_id.tolist():
                total, kept = total + 1, [*kept, event_id][-capacity:]
        state.update((total, kept))
        yield pd.DataFrame({"session_id": [key[0]], "captured_total": [total], "oldest_id": [total - len(kept) + 1], "newest_id": [total], "retained": [kept]})

    return frames.groupBy("session_id").applyInPandasWithState(step, kind, "total long, kept array<long>", "update", GroupStateTimeout.NoTimeout)
