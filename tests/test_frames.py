import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.api import Engine
from stillwater.errors import STATUS, EngineError
from stillwater.functions import codec, codec_math, geometry, parsing
from stillwater.operators import compare as C
from stillwater.operators import crop, resample
from stillwater.operators import temporal as T
from stillwater.sources import frames as S


def grid(spark, width, height, changed, base=(0, 0, 0), other=(255, 255, 255)):
    rows = [(1, x, y, *(other if (x, y) in changed else base)) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "k int, x int, y int, r int, g int, b int")


def compared(spark, width, height, changed, options=C.CompareOptions(), **colours):
    before, after = grid(spark, width, height, set()), grid(spark, width, height, changed, **colours)
    if colours:
        before = grid(spark, width, height, set(), base=colours["base"])
    row = C.compare_pixels(before, after, ["k"], options).first()
    lines = C.compare_scanlines(S.to_scanlines(before, ["k"]), S.to_scanlines(after, ["k"]), ["k"], options).first()
    assert row == lines
    return row


def test_single_pixel(spark):
    r = compared(spark, 10, 10, {(3, 7)})
    assert (r.changed_fraction, r.bbox_x, r.bbox_y, r.bbox_w, r.bbox_h) == (0.01, 3, 7, 1, 1)


def test_corners_and_nothing(spark):
    r = compared(spark, 20, 10, {(2, 1), (17, 1), (2, 8), (17, 8)})
    assert (r.changed_pixels, r.bbox_x, r.bbox_y, r.bbox_w, r.bbox_h) == (4, 2, 1, 16, 8)
    none = compared(spark, 4, 4, set())
    assert not none.changed and none.bbox_x is None and none.total_pixels == 16


@pytest.mark.parametrize("threshold, expected", [(9, 16), (10, 0), (11, 0)])
def test_pixel_threshold_is_strict(spark, threshold, expected):
    everywhere = {(x, y) for x in range(4) for y in range(4)}
    r = compared(spark, 4, 4, everywhere, C.CompareOptions("rgb", threshold), base=(100, 100, 100), other=(110, 100, 100))
    assert r.changed_pixels == expected


@pytest.mark.parametrize("area, changed", [(0.05, True), (0.0500001, False)])
def test_area_threshold_is_inclusive(spark, area, changed):
    assert compared(spark, 10, 10, {(x, 0) for x in range(5)}, C.CompareOptions(area_threshold=area)).changed is changed


def test_options_are_checked():
    for bad in (("other", 0, 0.0), ("rgb", 256, 0.0), ("rgb", 0, 1.5)):
        with pytest.raises(EngineError) as e:
            C.CompareOptions(*bad)
        assert e.value.code == "invalid_arguments" and e.value.exit_status == 2
    assert C.CompareOptions("exact", 12).effective_threshold == 0
    with pytest.raises(EngineError) as e:
        T.Schedule(interval_ms=0)
    assert e.value.code == "invalid_duration"
    assert [s for _, s, _ in STATUS] == list(range(1, 27))


def test_geometry_goldens(spark):
    r = geometry.rect(*[F.lit(v) for v in (640, 200, 640, 480)])
    t = geometry.transform(r, F.lit(320), F.lit(240))
    row = spark.range(1).select(
        geometry.right(r).alias("right"), geometry.bottom(r).alias("bottom"), geometry.area(r).alias("area"),
        geometry.image_to_source(t, F.lit(100), F.lit(50)).alias("s"), geometry.source_to_image(t, F.lit(840), F.lit(300)).alias("i"),
        geometry.dims_for_width(F.lit(1001), F.lit(777), F.lit(500)).alias("w"), geometry.dims_for_scale(F.lit(1001), F.lit(777), F.lit(0.0001)).alias("z"),
        parsing.mask_info(F.lit(0xFF0000)).alias("m"), parsing.mask_info(F.lit(0b1010)).alias("gap"),
        T.next_deadline(F.lit(300), F.lit(355), F.lit(100)).alias("d1"), T.next_deadline(F.lit(100), F.lit(1000), F.lit(100)).alias("d2"),
    ).first()
    assert (row.right, row.bottom, row.area) == (1280, 680, 307200)
    assert (row.s.x, row.s.y, row.i.x, row.i.y) == (840, 300, 100, 50)
    assert (row.w.height, row.z.width, row.z.height) == (388, 1, 1)
    assert (row.m.shift, row.m.bits, row.gap) == (16, 8, None)
    assert (row.d1, row.d2) == (400, 1100)


@pytest.mark.parametrize(
    "duration, frames, timeout, offsets, skipped",
    [(0, 3, 500, [0, 50, 100], 0), (80, 2, 500, [80, 180], 1), (130, 2, 1000, [130, 280], 2)],
)
def test_sampling_schedule(spark, duration, frames, timeout, offsets, skipped):
    d = spark.createDataFrame([(1, [duration] * frames)], "session_id long, d array<long>")
    r = T.sample_stack(d, frames, 50, timeout).first()
    assert (r.offsets, r.skipped, r.outcome) == (offsets, skipped, "complete")


def script(spark, steps):
    """Sessions of 10 x 10 cells, one pixel a cell: listed cells are white."""
    rows = [
        (1, f + 1, y, *[[255 if y * 10 + x in cells else 0 for x in range(10)]] * 3)
        for f, cells in enumerate(steps)
        for y in range(10)
    ]
    return spark.createDataFrame(rows, "session_id long, frame_id long, y int, r array<int>, g array<int>, b array<int>")


def outcomes(spark, steps, options, schedule):
    frames = script(spark, steps)
    samples = S.scripted_samples(frames, schedule.samples)
    return (
        T.sampled(samples, C.compare_to_baseline(frames, options, "lines")),
        T.sampled(samples, C.compare_consecutive(frames, options, "lines")),
    )


def test_gradual_drift(spark):
    steps = [[], [0], [0, 1], [0, 1, 2], [0, 1, 2, 3], [0, 1, 2, 3, 4]]
    schedule = T.Schedule(100, 10_000)
    r = T.wait_change(outcomes(spark, steps, C.CompareOptions("rgb", 12, 0.05), schedule)[0], schedule).first()
    assert (r.outcome, r.changed_pixels, r.captures, r.comparisons) == ("changed", 5, 6, 5)


@pytest.mark.parametrize("steps", [[[], [0]] + [[0, 1]] * 4, [[], [0], [0]] + [[0, 1]] * 4])
def test_settles_on_the_last_frame(spark, steps):
    schedule = T.Schedule(100, 10_000)
    c = outcomes(spark, steps, C.CompareOptions(), schedule)[1]
    r = T.wait_stable(c, schedule).first()
    assert (r.outcome, r.stable_ms) == ("stable", 300) and r.final_frame_id == min(len(steps), r.captures)


def test_observe_never_goes_back(spark):
    six, many = list(range(6)), list(range(12))
    schedule = T.Schedule(100, 10_000)
    b, c = outcomes(spark, [[], [], six, list(range(7))] + [many] * 4, C.CompareOptions("rgb", 12, 0.05), schedule)
    r = T.observe(b, c, schedule).first()
    assert (r.outcome, r.change_detected_ms, r.first_change_frame_id) == ("observed", 200, 3)
    still = outcomes(spark, [[], []], C.CompareOptions(), T.Schedule(100, 500))
    assert T.observe(*still, T.Schedule(100, 500)).first().outcome == "timeout"


def test_crop_and_resize(spark):
    frames = S.texture(spark, 16, 16, [0])
    with pytest.raises(EngineError):
        crop.crop_pixels(frames, 10, 10, 8, 8, 16, 16)
    lines = S.to_scanlines(frames, ["session_id", "frame_id"])
    assert resample.resize_box(lines, ["session_id", "frame_id"], 16, 16, 16, 16) is lines
    out = resample.to_pixels(resample.resize_box(lines, ["session_id", "frame_id"], 16, 16, 7, 5), ["session_id", "frame_id"]).collect()
    raw = {(r.x, r.y): r.r for r in frames.collect()}

    def span(i, s, t):
        start = min(int(i * (s / t)), s - 1)
        return start, min(max(int(np.ceil((i + 1) * (s / t))), start + 1), s)

    for r in out:
        (a, b), (c, d) = span(r.x, 16, 7), span(r.y, 16, 5)
        total = np.float32(0)
        for y in range(c, d):
            total = np.float32(total + np.float32(np.float32(sum(raw[x, y] for x in range(a, b))) / np.float32(b - a)))
        assert r.r == int(np.floor(np.float32(total / np.float32(d - c)) + 0.5))
    assert len(out) == 35


def test_codecs_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (13, 21, 3), dtype=np.uint8)
    for effort in codec.EFFORTS:
        assert (codec.decode_png(codec.encode_png(rgb, effort)) == rgb).all()
    smooth = np.repeat(np.arange(64, dtype=np.uint8)[None, :, None] * 3, 48, 0).repeat(3, 2)
    (tmp_path / "a.jpg").write_bytes(codec.encode_jpeg(smooth, 95))
    (tmp_path / "b.bin").write_bytes(codec.encode_png(rgb))
    (tmp_path / "c.png").write_bytes(b"GIF89a")
    from stillwater.sources.images import image_pixels, scan_images

    images = scan_images(spark, str(tmp_path)).cache()
    got = {r.path.rsplit("/", 1)[1]: r for r in images.collect()}
    assert (got["c.png"].status, got["a.jpg"].format, got["b.bin"].format) == ("image_load_failed", "jpeg", "png")
    assert bytes(got["b.bin"].data) == rgb.tobytes()
    decoded = np.frombuffer(bytes(got["a.jpg"].data), np.uint8).reshape(48, 64, 3).astype(int)
    assert abs(decoded - smooth).max() <= 6
    assert image_pixels(images).filter("path like '%b.bin' and x = 20 and y = 12").first().g == rgb[12, 20, 1]
    with pytest.raises(EngineError):
        codec.encode_jpeg(rgb, 0)


def test_ycbcr_goldens(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 128, 255)], "v int").select(codec_math.ycbcr(F.col("v"), F.col("v"), F.col("v")).alias("c")).collect()
    assert [(r.c.y, r.c.cb, r.c.cr) for r in rows] == [(0, 128, 128), (128, 128, 128), (255, 128, 128)]


def test_engine(spark):
    engine = Engine(spark)
    with pytest.raises(EngineError) as e:
        engine.create_session(script(spark, [[]]), capacity=257)
    assert e.value.code == "invalid_arguments"
    s = engine.create_session(script(spark, [[], [0], [0, 1]]).drop("session_id"), capacity=2)
    assert engine.ping()["sessions"] == 1 and engine.list_sessions() == [s]
    assert engine.session_info(s)["oldest_id"] == 2
    assert engine.diff(s, 2, 3).first().changed_pixels == 1
    with pytest.raises(EngineError) as e:
        engine.frame(s, 1)
    assert e.value.code == "frame_not_available"
    assert engine.latest(s).count() == 10
    assert engine.wait_stable(s, T.Schedule(100, 1000), C.CompareOptions()).first().outcome == "stable"
    engine.close_session(s)
    with pytest.raises(EngineError) as e:
        engine.latest(s)
    assert e.value.code == "session_not_found"
