"""Frames as bytes: comparison and resampling agree with the other layouts and with plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.functions import kernels as K
from stillwater.operators import compare as C
from stillwater.operators import strips as B
from stillwater.operators.resample import resize_box
from stillwater.sources import frames as S
from stillwater.sources import strips as T


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [C.CompareOptions(), C.CompareOptions("rgb", 40, 0.1), C.CompareOptions("rgb", 0, 0.0)])
def test_same_as_lines(spark, sf_dir, options):
    lines = S.embedding_scanlines(spark, sf_dir)
    strips = T.to_strips(lines)
    assert rows(B.compare_consecutive(strips, options)) == rows(C.compare_consecutive(lines, options, "lines"))
    assert rows(B.compare_to_baseline(strips, options)) == rows(C.compare_to_baseline(lines, options, "lines"))


def test_strips_of_many_lines(spark, monkeypatch):
    """A sparse block and a checkerboard on a texture, at strips of several lines, against whole arrays."""
    monkeypatch.setattr(T, "STRIP_BYTES", 2_000)
    kinds = ["none", "none", "sparse", "widespread", "none"]
    frames = spark.createDataFrame([(1, i + 1, 40, k) for i, k in enumerate(kinds)], "session_id long, frame_id long, seed int, change string")
    strips = T.texture_strips(frames, 120, 80, F.col("change"))
    assert strips.filter("frame_id = 1").count() == 16
    whole = {r.frame_id: K.pixels(r.data, r.width) for r in B.whole_frames(strips, ["frame_id"]).collect()}
    assert (whole[1] == K.texture(120, 80, 40)).all()
    for options in (C.CompareOptions(), C.CompareOptions("rgb", 12, 0.02)):
        got = {r.frame_id: r for r in B.compare_consecutive(strips, options).collect()}
        for i in range(2, 6):
            far = np.abs(whole[i].astype(int) - whole[i - 1]).max(2) > options.effective_threshold
            y, x = np.nonzero(far)
            r = got[i]
            assert (r.changed_pixels, r.total_pixels) == (len(x), 9_600)
            box = (None,) * 4 if not len(x) else (x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1)
            assert (r.bbox_x, r.bbox_y, r.bbox_w, r.bbox_h) == box
            assert r.changed == (len(x) > 0 and len(x) / 9_600 >= options.area_threshold)


def test_equal_strips_are_never_opened(spark):
    """Equal pairs reach the kernel as nulls: it isn't even shown their bytes."""
    frames = spark.createDataFrame([(1, i, 7) for i in (1, 2, 3)], "session_id long, frame_id long, seed int")
    plan = B.compare_consecutive(T.texture_strips(frames, 64, 48), C.CompareOptions())
    assert [r.changed_pixels for r in plan.collect()] == [0, 0]
    pairs = spark.createDataFrame([(1, 0, 2, b"123456", b"123456"), (2, 0, 2, b"123456", b"123")], "id int, y int, width int, before binary, after binary")
    assert B.compare_pairs(pairs.filter("id = 1"), ["id"], C.CompareOptions()).first().total_pixels == 2
    with pytest.raises(Exception, match="other sizes"):
        B.compare_pairs(pairs, ["id"], C.CompareOptions()).collect()


@pytest.mark.parametrize("size", [(5, 5), (8, 3), (3, 8), (13, 11), (1, 1)])
def test_resize_is_the_box_mean(spark, sf_dir, size):
    lines = S.embedding_scanlines(spark, sf_dir).filter("frame_id <= 6")
    expected = {}
    for r in resize_box(lines, ["session_id", "frame_id"], 8, 8, *size).collect():
        expected.setdefault((r.session_id, r.frame_id), {})[r.y] = np.stack([r.r, r.g, r.b], 1)
    f = B.whole_frames(T.to_strips(lines), ["session_id", "frame_id"]).withColumns({"to_width": F.lit(size[0]), "to_height": F.lit(size[1])})
    for r in B.resize_frames(f, ["session_id", "frame_id"]).collect():
        want = np.stack([expected[r.session_id, r.frame_id][y] for y in range(size[1])])
        assert (K.pixels(r.data, r.width) == want).all()


def test_each_row_its_size(spark, sf_dir):
    f = B.whole_frames(T.to_strips(S.embedding_scanlines(spark, sf_dir)), ["session_id", "frame_id"])
    sized = f.withColumns({"to_width": (F.col("frame_id") % 7 + 2).cast("int"), "to_height": F.lit(4)})
    got = B.resize_frames(sized, ["session_id", "frame_id"]).collect()
    assert all(r.width == r.frame_id % 7 + 2 and len(r.data) == 3 * r.width * 4 for r in got)
    with pytest.raises(Exception, match="empty size"):
        B.resize_frames(f.withColumns({"to_width": F.lit(0), "to_height": F.lit(4)}), ["frame_id"]).collect()


def test_large_images_are_read(spark, tmp_path):
    """A PNG of 640 x 480 and its pixels, in time in proportion to them."""
    import time

    from stillwater.functions import codec
    from stillwater.sources.images import image_pixels, scan_images

    rgb = K.texture(640, 480, 77)
    (tmp_path / "one.png").write_bytes(codec.encode_png(rgb))
    (tmp_path / "two.bin").write_bytes(b"no image")
    began = time.time()
    images = scan_images(spark, str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.collect()}
    assert (K.pixels(rows["one.png"].data, 640) == rgb).all() and rows["two.bin"].status == "image_load_failed"
    assert image_pixels(images).agg(F.sum("r"), F.sum("x"), F.count("*")).first()[:] == (int(rgb[..., 0].sum(dtype=int)), 480 * 639 * 320, 307_200)
    assert time.time() - began < 60
