import threading

import pytest

from stillwater.api import Engine
from stillwater.clock import ManualClock, StageTimer, Stopwatch
from stillwater.errors import EngineError
from stillwater.operators import temporal as T


def frames(spark, n=6):
    """8 x 4 frames, of which the fourth on has a pixel changed."""
    rows = [(f, y, *[[200 if c == "r" and f >= 4 and (y, x) == (2, 5) else x + y for x in range(8)] for c in "rgb"]) for f in range(1, n + 1) for y in range(4)]
    return spark.createDataFrame(rows, "frame_id long, y int, r array<int>, g array<int>, b array<int>")


def test_sessions(spark):
    engine = Engine(spark, seed=7)
    one, two = engine.create_session(frames(spark)), engine.create_session(frames(spark), capacity=2)
    assert (one, two) == ("s-7-1", "s-7-2") and engine.list_sessions() == [one, two]
    assert engine.capture(one).select("frame_id").distinct().collect()[0][0] == 6
    assert {r[0] for r in engine.realtime(one, 3).select("frame_id").collect()} == {4, 5, 6}
    assert {r[0] for r in engine.realtime(two, 3).select("frame_id").collect()} == {5, 6}
    compared, crop = engine.diff_with_changed_region(one, 3, 4)
    assert compared.first().changed_pixels == 1 and crop.count() == 1
    assert engine.diff_with_changed_region(one, 1, 2)[1] is None
    with pytest.raises(EngineError, match="frame not available"):
        engine.frame(two, 3)
    for bad in (0, 9):
        with pytest.raises(EngineError, match="invalid arguments"):
            engine.realtime(one, bad)
    engine.shutdown()
    assert engine.list_sessions() == []
    with pytest.raises(EngineError, match="session not found"):
        engine.latest(one)


def test_a_session_is_busy_while_it_is_observed(spark, monkeypatch):
    engine = Engine(spark)
    name = engine.create_session(frames(spark))
    inside, leave = threading.Event(), threading.Event()
    real = T.wait_change

    def slow(*args):
        inside.set()
        leave.wait(20)
        return real(*args)

    monkeypatch.setattr(T, "wait_change", slow)
    got = []
    thread = threading.Thread(target=lambda: got.append(engine.wait_change(name).first()))
    thread.start()
    inside.wait(20)
    for call in (lambda: engine.observe(name), lambda: engine.capture(name), lambda: engine.close_session(name)):
        with pytest.raises(EngineError, match="session busy"):
            call()
    leave.set()
    thread.join()
    assert got[0].final_frame_id == 4
    engine.close_session(name)
    assert engine.list_sessions() == []


def test_clocks():
    clock = ManualClock()
    watch = Stopwatch(clock)
    clock.sleep_until(50)
    clock.sleep_until(20)  # past
    assert (clock.now(), clock.slept, clock.deadlines) == (50, 50, [50, 20])
    assert watch.stop() == 50
    clock.advance(5)
    assert watch.stop() == watch.elapsed == 50  # the first stop counts
    timer = StageTimer(clock)
    for by in (3, 4):
        with timer.stage("encode"):
            clock.advance(by)
    clock.advance(1)
    assert timer.finish() == {"encode": 7, "total": 8}
