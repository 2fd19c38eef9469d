"""The engine's entry point for programs: sessions over a table of frames, under the names of its operations."""

from __future__ import annotations

import contextlib
import os
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import FATAL, EngineError
from .operators import compare as C
from .operators import sessions as O
from .operators import temporal as T
from .operators.crop import crop_scanlines
from .sources.frames import scripted_samples

PROTOCOL_VERSION = 1


@dataclass
class Session:
    """One session's frames (layout L with frame_id), replayed."""

    session_id: str
    frames: DataFrame
    capacity: int = 8
    state: str = "ready"
    target: str = "desktop"

    def usable(self) -> None:
        if self.state in ("closed", "failed"):
            raise EngineError("session_closed", self.session_id)


@dataclass
class Engine:
    """ping, create_session, list_sessions, session_info, capture, latest, frame, diff, diff_with_changed_region, realtime,
    wait_change, wait_stable, observe, close_session, shutdown.

    Calls that observe a session hold it until their result is there; meanwhile it is busy for others like them.
    """

    spark: SparkSession
    sessions: dict[str, Session] = field(default_factory=dict)
    seed: int = field(default_factory=lambda: time.time_ns() ^ (os.getpid() << 32))
    serial: int = 0
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def generate_session_id(self) -> str:
        """s-seed-serial, of the next serial that no session has."""
        with self._lock:
            while True:
                self.serial += 1
                if (made := f"s-{self.seed}-{self.serial}") not in self.sessions:
                    return made

    @contextlib.contextmanager
    def _observing(self, session_id: str):
        session = self._get(session_id)
        with self._lock:
            if session.state == "observing":
                raise EngineError("session_busy", session_id)
            session.state = "observing"
        try:
            yield session
        except EngineError as e:
            if e.code in FATAL:
                session.state = "failed"
            raise
        finally:
            with self._lock:
                if session.state == "observing":  # not closed or failed meanwhile
                    session.state = "ready"

    def _done(self, result: DataFrame) -> DataFrame:
        """A result of a row a session, computed now."""
        return self.spark.createDataFrame(result.collect(), result.schema)

    def ping(self) -> dict:
        return {"protocol_version": PROTOCOL_VERSION, "sessions": len(self.sessions)}

    def create_session(self, frames: DataFrame, capacity: int = 8, target: str = "desktop") -> str:
        """Registers the frames of one session (frame_id, y, r, g, b); the capacity is checked first."""
        O.check_capacity(capacity)
        session = Session(self.generate_session_id(), frames, capacity, target=target)
        self.sessions[session.session_id] = session
        return session.session_id

    def _get(self, session_id: str) -> Session:
        if session_id not in self.sessions:
            raise EngineError("session_not_found", session_id)
        session = self.sessions[session_id]
        session.usable()
        return session

    def list_sessions(self) -> list[str]:
        return sorted(self.sessions)

    def session_info(self, session_id: str) -> dict:
        s = self._get(session_id)
        newest = s.frames.agg(F.max("frame_id")).first()[0] or 0
        kept = min(newest, s.capacity)
        return {"session_id": session_id, "state": s.state, "target": s.target, "captured_total": newest, "oldest_id": newest - kept + 1, "newest_id": newest}

    def frame(self, session_id: str, frame_id: int) -> DataFrame:
        info = self.session_info(session_id)
        if not info["newest_id"]:
            raise EngineError("no_frame_available", session_id)
        if not info["oldest_id"] <= frame_id <= info["newest_id"]:
            raise EngineError("frame_not_available", f"{frame_id} of {session_id}")
        return self._get(session_id).frames.filter(F.col("frame_id") == frame_id)

    def latest(self, session_id: str) -> DataFrame:
        return self.frame(session_id, self.session_info(session_id)["newest_id"])

    def diff(self, session_id: str, before_id: int, after_id: int, options: C.CompareOptions = C.CompareOptions()) -> DataFrame:
        before, after = (self.frame(session_id, i).withColumn("session_id", F.lit(session_id)) for i in (before_id, after_id))
        return C.compare_scanlines(before, after, ["session_id"], options)

    def capture(self, session_id: str) -> DataFrame:
        """The newest frame, taken while nothing else observes the session."""
        with self._observing(session_id):
            return self.latest(session_id)

    def diff_with_changed_region(
        self, session_id: str, before_id: int, after_id: int, options: C.CompareOptions = C.CompareOptions()
    ) -> tuple[DataFrame, DataFrame | None]:
        """The comparison, and the later frame's lines inside the changed box; None if nothing changed."""
        compared = self._done(self.diff(session_id, before_id, after_id, options))
        box = compared.first()
        if box.bbox_x is None:
            return compared, None
        return compared, crop_scanlines(self.frame(session_id, after_id), box.bbox_x, box.bbox_y, box.bbox_w, box.bbox_h)

    def realtime(self, session_id: str, frames: int = 3) -> DataFrame:
        """The newest ``frames`` frames, 1 to 8, as far as the session holds so many."""
        if not 1 <= frames <= T.MAX_STACK:
            raise EngineError("invalid_arguments", f"a stack has 1 to {T.MAX_STACK} frames, got {frames}")
        with self._observing(session_id):
            info = self.session_info(session_id)
            if not info["newest_id"]:
                raise EngineError("observation_failed", f"no frame of {session_id}")
            low = max(info["oldest_id"], info["newest_id"] - frames + 1)
            return self._get(session_id).frames.filter(F.col("frame_id").between(low, info["newest_id"]))

    def shutdown(self) -> None:
        """Closes every session, busy or not."""
        for session in self.sessions.values():
            session.state = "closed"
        self.sessions.clear()

    def _samples(self, session_id: str, schedule: T.Schedule, options: C.CompareOptions) -> tuple[DataFrame, DataFrame]:
        frames = self._get(session_id).frames.withColumn("session_id", F.lit(session_id))
        samples = scripted_samples(frames, schedule.samples)
        return (
            T.sampled(samples, C.compare_to_baseline(frames, options, "lines")),
            T.sampled(samples, C.compare_consecutive(frames, options, "lines")),
        )

    def wait_change(self, session_id: str, schedule: T.Schedule = T.Schedule(), options: C.CompareOptions = C.TEMPORAL) -> DataFrame:
        with self._observing(session_id):
            return self._done(T.wait_change(self._samples(session_id, schedule, options)[0], schedule))

    def wait_stable(self, session_id: str, schedule: T.Schedule = T.Schedule(), options: C.CompareOptions = C.TEMPORAL) -> DataFrame:
        with self._observing(session_id):
            return self._done(T.wait_stable(self._samples(session_id, schedule, options)[1], schedule))

    def observe(self, session_id: str, schedule: T.Schedule = T.Schedule(), options: C.CompareOptions = C.TEMPORAL) -> DataFrame:
        with self._observing(session_id):
            baseline, consecutive = self._samples(session_id, schedule, options)
            return self._done(T.observe(baseline, consecutive, schedule))

    def close_session(self, session_id: str) -> None:
        session = self._get(session_id)
        if session.state == "observing":
            raise EngineError("session_busy", session_id)
        del self.sessions[session_id]
