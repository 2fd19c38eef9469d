"""Queries of scans, whole responses and session results."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import codec, parsing
from ..functions import geometry as G
from ..operators import compare as C
from ..operators import presentation as P
from ..operators import resample as R
from ..operators import sessions as O
from ..operators import temporal as T
from ..operators.crop import crop_scanlines
from ..operators.prepare import prepare_image
from ..sources import frames as S
from ..sources.images import image_pixels, scan_images
from ..sources.tables import shared_folder
from ..sources.versioned import read_version, write_version
from . import frame_sql as Q
from .registry import ORACLE_SQL, query, scalar
from .session_queries import _NEWEST, _frames
from .temporal_queries import _SCHEDULE, _comparisons  # registers the SQL that session results build on

_KEYS = ["session_id", "frame_id"]
_LINES = S.embedding_scanlines
_DIGEST = ["format", "bytes", "offset_x", "offset_y", "scale_x", "scale_y"]


def _image_folder(spark) -> str:
    """A few files of either format in the shared folder, written through Hadoop's file systems."""
    path = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    fs = spark._jvm.org.apache.hadoop.fs
    for i in range(4):
        y, x = np.mgrid[0:12, 0:16]
        n = ((7 * x + 13 * y) % 256) ^ (40 * i)
        rgb = np.stack([n, n * 3 % 256, (n + 91) % 256], 2).astype(np.uint8)
        data = codec.encode_png(rgb) if i % 2 == 0 else codec.encode_jpeg(rgb, 90)
        target = fs.Path(f"{path}/frame{i}.img")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(data))
        out.close()
    return path


@query("scan_image_file", """SELECT 'frame' || i || '.img' AS file, CASE WHEN i % 2 = 0 THEN 'png' ELSE 'jpeg' END AS format, 16 AS width, 12 AS height, 3 AS channels, 'ok' AS status
FROM (SELECT unnest(range(4)) AS i)""")
def scan_image_file(spark, sf_dir):
    """Width, height, format by content and status of written images."""
    i = scan_images(spark, _image_folder(spark))
    return i.select(F.element_at(F.split("path", "/"), -1).alias("file"), "format", "width", "height", "channels", "status")


@query("decode_jpeg")
def decode_jpeg(spark, sf_dir):
    p = image_pixels(scan_images(spark, _image_folder(spark)).filter("format = 'jpeg'"))
    return p.groupBy(F.element_at(F.split("path", "/"), -1).alias("file")).agg(F.count("*").alias("pixels"), F.max("r").alias("most_red"))


@query("capture_desktop", f"WITH {Q.EMB} SELECT session_id, frame_id, count(*) AS pixels, sum(r)::BIGINT AS total FROM emb GROUP BY session_id, frame_id")
def capture_desktop(spark, sf_dir):
    return S.embedding_pixels(spark, sf_dir).groupBy(*_KEYS).agg(F.count("*").alias("pixels"), F.sum("r").alias("total"))


@query("baseline_frame", f"WITH {Q.EMB} SELECT session_id, x, y, r FROM emb WHERE frame_id = 1")
def baseline_frame(spark, sf_dir):
    return S.embedding_pixels(spark, sf_dir).filter("frame_id = 1").select("session_id", "x", "y", "r")


@query("write_file_atomic", f"WITH {Q.EMB} SELECT session_id, frame_id, x, y, r FROM emb")
def write_file_atomic(spark, sf_dir):
    """Two versions of a table, each published by one rename; the second is read back."""
    path = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    frames = S.embedding_pixels(spark, sf_dir).select("session_id", "frame_id", "x", "y", "r")
    write_version(frames.withColumn("r", F.lit(0)), path)
    write_version(frames, path, keep=0)
    return read_version(spark, path)


@query("prepare_image")
def prepare_image_query(spark, sf_dir):
    return prepare_image(_LINES(spark, sf_dir), _KEYS, (8, 8), resize=(5, 5)).select(*_KEYS, *_DIGEST)


@query("encode_view")
def encode_view(spark, sf_dir):
    out = prepare_image(_LINES(spark, sf_dir), _KEYS, (8, 8), (2, 1, 6, 4), None, "jpeg", 75, origin=(10, 20))
    return out.select(*_KEYS, *_DIGEST)


@query("capture")
def capture(spark, sf_dir):
    """Capture, prepare, route: bytes go to a file, metadata to stdout."""
    out = prepare_image(_LINES(spark, sf_dir), _KEYS, (8, 8))
    r = parsing.route_output(F.lit(True), F.lit(False), F.lit(False))
    return out.select(*_KEYS, "bytes", r["write_image_bytes"].alias("write_image_bytes"), r["metadata"].alias("metadata"))


@query("session_document")
def session_document(spark, sf_dir):
    """A document a session: images with sizes, and totals."""
    out = prepare_image(_LINES(spark, sf_dir), _KEYS, (8, 8), resize=(4, 4)).drop("data")
    view = F.struct("frame_id", "format", "bytes", F.length("base64").alias("base64_chars"))
    g = out.groupBy("session_id").agg(F.array_sort(F.collect_list(view)).alias("frames"), F.sum("bytes").alias("bytes"))
    return g.select("session_id", F.to_json(F.struct("frames", "bytes")).alias("document"))


@query("stage_totals")
def stage_totals(spark, sf_dir):
    """Bytes that pass each stage: pixels cropped, resized, encoded, as text."""
    lines = _LINES(spark, sf_dir)
    cropped = crop_scanlines(lines, 0, 0, 6, 6)
    resized = R.resize_box(cropped, _KEYS, 6, 6, 3, 3)
    pixels = lambda d, name: d.agg((F.sum(F.size("r")) * 3).alias(name))  # noqa: E731  three bytes a pixel
    out = prepare_image(lines, _KEYS, (8, 8), (0, 0, 6, 6), (3, 3)).agg(F.sum("bytes").alias("encoded"), F.sum(F.length("base64")).alias("text"))
    parts = [pixels(cropped, "cropped"), pixels(resized, "resized"), out]
    one = [p.withColumn("one", F.lit(1)) for p in parts]  # a row each
    return one[0].join(one[1], "one").join(one[2], "one").drop("one")


_BOX = f"WITH {Q.EMB}, c AS ({Q.emb_consecutive('rgb', 40, 0.1)})"


@query("changed_crop_file", f"""{_BOX} SELECT c.session_id, c.frame_id, count(*) AS pixels, sum(r)::BIGINT AS total FROM c JOIN emb ON emb.session_id = c.session_id AND emb.frame_id = c.frame_id
  AND x >= bbox_x AND x < bbox_x + bbox_w AND y >= bbox_y AND y < bbox_y + bbox_h GROUP BY c.session_id, c.frame_id""")  # fmt: skip
def changed_crop_file(spark, sf_dir):
    """Pixels of the changed box of the later frame; nothing without a box."""
    c = C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), C.CompareOptions("rgb", 40, 0.1), "lines")
    j = S.embedding_pixels(spark, sf_dir).join(c.filter("bbox_x is not null").select(*_KEYS, "bbox_x", "bbox_y", "bbox_w", "bbox_h"), _KEYS)
    inside = F.expr("x >= bbox_x AND x < bbox_x + bbox_w AND y >= bbox_y AND y < bbox_y + bbox_h")
    return j.filter(inside).groupBy(*_KEYS).agg(F.count("*").alias("pixels"), F.sum("r").alias("total"))


_VIEW = """CASE WHEN bbox_x IS NULL THEN 'none' WHEN bbox_w * bbox_h / total_pixels::DOUBLE > 0.6 THEN 'overview' ELSE 'changed_region' END"""


@query("present_changed", f"""{_BOX} SELECT session_id, frame_id, {_VIEW} AS "view" FROM c""")
def present_changed(spark, sf_dir):
    """The view of a change: its box, or the whole frame where the box is too large a part, or none."""
    c = C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), C.CompareOptions("rgb", 40, 0.1), "lines")
    back = P.changed_region(c, _KEYS, 1, 0.6, G.rect(F.lit(0), F.lit(0), F.lit(S.SIDE), F.lit(S.SIDE)))
    shown = F.when(F.col("fell_back"), "overview").when(F.col("returned_x").isNotNull(), "changed_region").otherwise("none")
    return back.select(*_KEYS, shown.alias("view"))


@query("overview_under", f"{_BOX} SELECT session_id, count(*) FILTER (WHERE {_VIEW} = 'overview') AS overviews FROM c GROUP BY session_id")
def overview_under(spark, sf_dir):
    return present_changed(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("view") == "overview").alias("overviews"))


@query("session_wait_change", f"SELECT session_id, outcome, 1 AS baseline_id, final_frame_id AS final_id FROM ({ORACLE_SQL['wait_change']})")
def session_wait_change(spark, sf_dir):
    r = T.wait_change(_comparisons(spark, sf_dir)[1], _SCHEDULE)
    return r.select("session_id", "outcome", F.lit(1).cast("long").alias("baseline_id"), F.col("final_frame_id").alias("final_id"))


@query("session_wait_stable", f"SELECT session_id, outcome, 1 AS baseline_id, final_frame_id AS final_id FROM ({ORACLE_SQL['wait_stable']})")
def session_wait_stable(spark, sf_dir):
    r = T.wait_stable(_comparisons(spark, sf_dir)[2], _SCHEDULE)
    return r.select("session_id", "outcome", F.lit(1).cast("long").alias("baseline_id"), F.col("final_frame_id").alias("final_id"))


@query("session_observe", f"SELECT session_id, outcome, 1 AS baseline_id, first_change_frame_id AS first_change_id, final_frame_id AS final_id FROM ({ORACLE_SQL['observe']})")
def session_observe(spark, sf_dir):
    _, b, c = _comparisons(spark, sf_dir)
    r = T.observe(b, c, _SCHEDULE)
    return r.select("session_id", "outcome", F.lit(1).cast("long").alias("baseline_id"), F.col("first_change_frame_id").alias("first_change_id"), F.col("final_frame_id").alias("final_id"))


@query("session_latest", f"SELECT session_id, frame_id, event_id FROM ({_NEWEST}) WHERE frame_id = newest")
def session_latest(spark, sf_dir):
    return O.latest_frame(_frames(spark, sf_dir)).select("session_id", "frame_id", "event_id")


@query("session_frame", f"SELECT session_id, frame_id, event_id, newest - frame_id AS back FROM ({_NEWEST}) WHERE frame_id > newest - 8")
def session_frame(spark, sf_dir):
    kept = O.retained_window(_frames(spark, sf_dir), 8)
    newest = kept.groupBy("session_id").agg(F.max("frame_id").alias("newest"))
    j = kept.join(newest, "session_id")
    return j.select("session_id", "frame_id", "event_id", (F.col("newest") - F.col("frame_id")).alias("back"))


@query("captured_wall_clock", "SELECT user_id AS session_id, event_id, epoch_us(ts) AS wall_us FROM events")
def captured_wall_clock(spark, sf_dir):
    """Wall time of captures: the wall clock at the session's newest, less the steady time since.

    A session's steady clock starts with its first event; only differences of it are used.
    """
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("at"))
    ends = e.groupBy("session_id").agg(F.min("at").alias("start"), F.max("at").alias("now_wall"))
    j = e.join(ends, "session_id").withColumns({"steady": F.col("at") - F.col("start"), "now_steady": F.col("now_wall") - F.col("start")})
    return j.select("session_id", "event_id", O.wall_clock(F.col("now_wall"), F.col("now_steady"), F.col("steady")).alias("wall_us"))


_ASKED = "SELECT o_orderkey AS id, o_custkey % 300 AS capacity, o_orderkey % 5 AS w, o_custkey % 2 = 0 AS older, o_orderkey % 3 = 0 AS newest, ['all_same', 'newest_detailed', 'newest_only', 'metadata_older'][o_custkey % 4 + 1] AS mode FROM orders"


def _asked(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey % 300 AS capacity", "o_orderkey % 5 AS w", "o_custkey % 2 = 0 AS older", "o_orderkey % 3 = 0 AS newest",
        "element_at(array('all_same', 'newest_detailed', 'newest_only', 'metadata_older'), cast(o_custkey % 4 + 1 as int)) AS mode",
    )


scalar(
    "session_create",
    _asked,
    _ASKED,
    ["id"],
    lambda: {"status": O.validate_create(F.col("capacity"), F.col("w"))},
    {"status": "CASE WHEN capacity < 1 OR capacity > 256 THEN 'invalid_arguments' WHEN w = 0 THEN 'invalid_region' ELSE 'ok' END"},
)
scalar(
    "older_newest_image",
    _asked,
    _ASKED,
    ["id"],
    lambda: {"older_image": P.image_for(F.col("mode"), F.lit(False)), "newest_image": P.image_for(F.col("mode"), F.lit(True))},
    {
        "older_image": "CASE mode WHEN 'all_same' THEN 'newest' WHEN 'newest_detailed' THEN 'older' ELSE 'metadata' END",
        "newest_image": "'newest'",
    },
)
scalar(
    "resolve_presentation_args",
    _asked,
    _ASKED,
    ["id"],
    lambda: {
        "temporal": F.when(F.col("older") | F.col("newest"), "newest_detailed"),
        "older_quality": F.lit(55), "newest_quality": F.lit(75), "overview_format": F.lit("jpeg"), "region_format": F.lit("png"),
    },
    {
        "temporal": "CASE WHEN older OR newest THEN 'newest_detailed' END",
        "older_quality": "55", "newest_quality": "75", "overview_format": "'jpeg'", "region_format": "'png'",
    },
)
scalar(
    "resolve_image",
    _asked,
    _ASKED,
    ["id"],
    lambda: {"format": F.when(F.col("older"), "jpeg").otherwise("png"), "quality": F.coalesce(F.when(F.col("older") & F.col("newest"), F.col("w") + 70), F.lit(80))},
    {"format": "CASE WHEN older THEN 'jpeg' ELSE 'png' END", "quality": "CASE WHEN older AND newest THEN w + 70 ELSE 80 END"},
)
