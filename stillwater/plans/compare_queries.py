"""Queries of comparison and cropping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import strips as B
from ..operators.crop import crop_pixels, geometry_consistent
from ..operators.segments import Scan
from ..sources import frames as S
from ..sources.strips import to_strips
from . import frame_sql as Q
from .registry import query

_RGB = C.CompareOptions("rgb", 40, 0.1)
_EXACT = C.CompareOptions()
_ARGS = ("rgb", 40, 0.1)
_WITH = f"WITH {Q.EMB}"
_CONSECUTIVE = f"{_WITH} {Q.emb_consecutive(*_ARGS)}"


@query("compare_frames", f"{_WITH} {Q.emb_consecutive('exact', 0, 0.0)}")
def compare_frames(spark, sf_dir):
    return C.compare_consecutive(S.embedding_pixels(spark, sf_dir), _EXACT)


@query("compare_consecutive", _CONSECUTIVE)
def compare_consecutive(spark, sf_dir):
    return C.compare_consecutive(S.embedding_pixels(spark, sf_dir), _RGB)


@query("compare_scanlines", _CONSECUTIVE)
def compare_scanlines(spark, sf_dir):
    return C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), _RGB, "lines")


@query("compare_strips", _CONSECUTIVE)
def compare_strips(spark, sf_dir):
    """compare_consecutive over bytes: equal strips are never opened."""
    return B.compare_consecutive(to_strips(S.embedding_scanlines(spark, sf_dir)), _RGB)


@query("compare_strips_exact", f"{_WITH} {Q.emb_consecutive('exact', 0, 0.0)}")
def compare_strips_exact(spark, sf_dir):
    return B.compare_consecutive(to_strips(S.embedding_scanlines(spark, sf_dir)), _EXACT)


@query("baseline_strips", f"{_WITH} {Q.emb_baseline(*_ARGS)}")
def baseline_strips(spark, sf_dir):
    return B.compare_to_baseline(to_strips(S.embedding_scanlines(spark, sf_dir)), _RGB)


@query("resize_frames")
def resize_frames(spark, sf_dir):
    """Every frame resampled to a size of its own, with a digest of the result."""
    f = B.whole_frames(to_strips(S.embedding_scanlines(spark, sf_dir)), ["session_id", "frame_id"])
    sized = f.withColumns({"to_width": (F.col("frame_id") % 7 + 2).cast("int"), "to_height": (F.col("frame_id") % 5 + 3).cast("int")})
    out = B.resize_frames(sized, ["session_id", "frame_id"])
    return out.select("session_id", "frame_id", "width", "height", F.sha2("data", 256).alias("sha256"))


@query("compare_to_baseline", f"{_WITH} {Q.emb_baseline(*_ARGS)}")
def compare_to_baseline(spark, sf_dir):
    return C.compare_to_baseline(S.embedding_pixels(spark, sf_dir), _RGB)


@query("compare_lineitem_months", f"WITH {Q.LI} {Q.comparison(Q.consecutive_pairs('li'), Q.KEYS, 'rgb', 60, 0.25)}")
def compare_lineitem_months(spark, sf_dir):
    return C.compare_consecutive(S.lineitem_pixels(spark, sf_dir), C.CompareOptions("rgb", 60, 0.25))


@query(
    "session_diff",
    f"""{_WITH}, pairs AS (
  SELECT p.session_id, p.before_id, p.after_id, a.x, a.y, b.r AS r1, b.g AS g1, b.b AS b1, a.r AS r2, a.g AS g2, a.b AS b2
  FROM (SELECT session_id, 1 AS before_id, max(frame_id) AS after_id FROM emb GROUP BY session_id) p
  JOIN emb a ON a.session_id = p.session_id AND a.frame_id = p.after_id
  JOIN emb b ON b.session_id = p.session_id AND b.frame_id = p.before_id AND a.x = b.x AND a.y = b.y)
{Q.comparison('SELECT * FROM pairs', 'session_id, before_id, after_id', *_ARGS)}""",
)
def session_diff(spark, sf_dir):
    frames = S.embedding_pixels(spark, sf_dir)
    pairs = frames.groupBy("session_id").agg(F.max("frame_id").alias("after_id"))
    pairs = pairs.select("session_id", F.lit(1).cast("long").alias("before_id"), "after_id")
    return C.session_diff(frames, pairs, _RGB)


def _column(name: str, columns: list[str]):
    text = ", ".join(["session_id", "frame_id", *columns])

    @query(name, f"SELECT {text} FROM ({_CONSECUTIVE})")
    def run(spark, sf_dir):
        return compare_scanlines(spark, sf_dir).select("session_id", "frame_id", *columns)


_column("changed_pixel_count", ["changed_pixels"])
_column("total_pixels", ["total_pixels"])
_column("changed_fraction", ["changed_fraction"])
_column("bounding_box", ["bbox_x", "bbox_y", "bbox_w", "bbox_h"])
_column("frame_changed", ["changed"])


def _pixels(name: str, options: C.CompareOptions, test: str):
    before = ", ".join(f"{c} AS {c}2, lag({c}) OVER earlier AS {c}1" for c in "rgb")

    @query(
        name,
        f"""{_WITH} SELECT session_id, frame_id, x, y, {test} AS pixel_changed
FROM (SELECT session_id, frame_id, x, y, {before} FROM emb WINDOW earlier AS (PARTITION BY session_id, x, y ORDER BY frame_id)) WHERE frame_id > 1""",
    )
    def run(spark, sf_dir):
        keys = ["session_id", "frame_id", "x", "y"]
        pairs = C.consecutive_pixels(S.embedding_pixels(spark, sf_dir))
        return pairs.select(*keys, C.pixel_changed(options).alias("pixel_changed"))


_pixels("pixel_changed_exact", _EXACT, "r1 <> r2 OR g1 <> g2 OR b1 <> b2")
_pixels("pixel_changed_rgb", _RGB, "greatest(abs(r1 - r2), abs(g1 - g2), abs(b1 - b2)) > 40")


@query(
    "effective_threshold",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey % 256 END AS threshold FROM orders",
)
def effective_threshold(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    mode = F.when(F.col("o_orderkey") % 2 == 0, "exact").otherwise("rgb")
    return o.select(
        F.col("o_orderkey").alias("id"), C.effective_threshold(mode, F.col("o_custkey") % 256).alias("threshold")
    )


@query(
    "diff_summary",
    f"""SELECT session_id, frame_id, CASE WHEN bbox_x IS NULL
  THEN printf('%s: no pixels changed (%d compared)', mode, total_pixels)
  ELSE printf('%s: %d/%d pixels changed (%.4f%%%s), changed region %dx%d+%d+%d', mode, changed_pixels, total_pixels,
    changed_fraction * 100.0, CASE WHEN changed THEN '' ELSE ', below area threshold' END, bbox_w, bbox_h, bbox_x, bbox_y)
  END AS summary FROM ({_CONSECUTIVE})""",
)
def diff_summary(spark, sf_dir):
    return C.diff_summary(compare_scanlines(spark, sf_dir), ["session_id", "frame_id"])


@query(
    "project_transition",
    f"""SELECT session_id, frame_id, changed, changed_pixels, total_pixels, changed_fraction, bbox_x, bbox_y, bbox_w, bbox_h
FROM ({_CONSECUTIVE})""",
)
def project_transition(spark, sf_dir):
    return C.project_transition(compare_scanlines(spark, sf_dir), ["session_id", "frame_id"])


@query(
    "initial_comparison",
    f"""{_WITH} {Q.comparison('SELECT session_id, frame_id, x, y, r AS r1, g AS g1, b AS b1, r AS r2, g AS g2, b AS b2 '
                              'FROM emb', Q.KEYS, *_ARGS)}""",
)
def initial_comparison(spark, sf_dir):
    return C.initial_comparison(["session_id", "frame_id"], S.embedding_pixels(spark, sf_dir), _RGB)


_SIZES = "SELECT o_orderkey AS id, 640 AS width, 480 AS height FROM orders"
_OTHERS = "SELECT o_orderkey AS id, 640 + CAST(o_custkey % 5 = 0 AS INT) AS width, 480 - CAST(o_custkey % 7 = 0 AS INT) AS height FROM orders"


@query(
    "compatible_frames",
    f"""SELECT a.id, CASE WHEN a.width = b.width AND a.height = b.height THEN 'ok' ELSE 'incompatible_frames' END AS status
FROM ({_SIZES}) a JOIN ({_OTHERS}) b ON a.id = b.id""",
)
def compatible_frames(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    a = o.selectExpr("o_orderkey AS id", "640 AS width", "480 AS height")
    b = o.selectExpr(
        "o_orderkey AS id", "640 + CAST(o_custkey % 5 = 0 AS INT) AS width", "480 - CAST(o_custkey % 7 = 0 AS INT) AS height"
    )
    return C.compatible(a, b, ["id"])


_GEOMETRY = """SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id,
  640 + CAST(event_id % 97 = 0 AS INT) AS width, 480 AS height, CAST(event_id % 89 = 0 AS INT) * 5 AS src_x, 0 AS src_y
FROM events"""


@query(
    "geometry_consistent",
    f"""SELECT session_id, frame_id, CASE WHEN width <> w0 OR height <> h0 THEN 'geometry_changed (size)'
  WHEN src_x <> x0 OR src_y <> y0 THEN 'geometry_changed (origin)' ELSE 'ok' END AS status
FROM (SELECT *, first_value(width) OVER s AS w0, first_value(height) OVER s AS h0, first_value(src_x) OVER s AS x0,
  first_value(src_y) OVER s AS y0 FROM ({_GEOMETRY}) WINDOW s AS (PARTITION BY session_id ORDER BY frame_id))""",
)
def geometry_consistent_query(spark, sf_dir):
    e = S.assign_frame_ids(S.table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id"), "session_id", "ts", "event_id")
    return geometry_consistent(
        e.selectExpr(
            "session_id", "frame_id", "640 + CAST(event_id % 97 = 0 AS INT) AS width", "480 AS height",
            "CAST(event_id % 89 = 0 AS INT) * 5 AS src_x", "0 AS src_y",
        )
    )


@query("crop", f"{_WITH} SELECT session_id, frame_id, x - 2 AS x, y - 1 AS y, r, g, b FROM emb WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def crop(spark, sf_dir):
    return crop_pixels(S.embedding_pixels(spark, sf_dir), 2, 1, 5, 4, S.SIDE, S.SIDE)


@query("frame_from_rgb8", "SELECT 1::BIGINT AS session_id, i // 48 + 1 AS frame_id, i % 48 % 8 AS x, i % 48 // 8 AS y, n AS r, n * 3 % 256 AS g, (n + 91) % 256 AS b "
       "FROM (SELECT i, xor((7 * (i % 48 % 8) + 13 * (i % 48 // 8)) % 256, i // 48 * 40 % 256) AS n FROM (SELECT unnest(range(144)) AS i))")  # fmt: skip
def frame_from_rgb8(spark, sf_dir):
    return S.texture(spark, 8, 6, [0, 40, 80])


@query("assign_frame_ids", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame_id FROM events")
def assign_frame_ids(spark, sf_dir):
    events = S.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return Scan(events, "user_id", "ts", "event_id").numbered().drop("ts")


@query(
    "previous_frame",
    "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id, "
    "first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS baseline_id FROM events",
)
def previous_frame(spark, sf_dir):
    events = S.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return Scan(events, "user_id", "ts", "event_id").neighbours("event_id", "previous_id", "baseline_id").drop("user_id", "ts")
