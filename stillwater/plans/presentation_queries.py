"""Queries of resampling, presentation planning, budget fitting, encoders and responses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import codec, parsing
from ..functions import geometry as G
from ..operators import compare as C
from ..operators import presentation as P
from ..operators import resample as R
from ..operators.crop import crop_scanlines
from ..operators.regions import pixels_in
from ..operators.strips import packed
from ..sources import frames as S
from ..sources.strips import texture_frames
from . import frame_sql as Q
from .registry import query, scalar

_KEYS = ["session_id", "frame_id"]


def _span_sql(i: str, s: int, t: int) -> tuple[str, str]:
    start = f"least(floor({i} * ({s}::DOUBLE / {t}))::INT, {s - 1})"
    return start, f"least(greatest(ceil(({i} + 1) * ({s}::DOUBLE / {t}))::INT, {start} + 1), {s})"


@query("source_span", "SELECT i, " + ", ".join(f"{_span_sql('i', 1001, 400)[k]} AS {n}" for k, n in enumerate(("start", "stop"))) + " FROM (SELECT unnest(range(400)) AS i)")
def source_span(spark, sf_dir):
    start, end = R.source_span("i", 1001, 400)
    return spark.range(400).selectExpr("id AS i", f"{start} AS start", f"{end} AS stop")


def _box_sql(tw: int, th: int) -> str:
    sx, ex = _span_sql("tx", 8, tw)
    sy, ey = _span_sql("ty", 8, th)
    mean = lambda c: f"least(greatest(round((list_reduce(list({c} ORDER BY y), lambda a, e: (a + e)::FLOAT) / count(*)::FLOAT)::FLOAT), 0), 255)::INT AS {c}"
    across = ", ".join(f"(sum({c})::FLOAT / count(*)::FLOAT)::FLOAT AS {c}" for c in "rgb")
    return f"""WITH {Q.EMB},
across AS (SELECT session_id, frame_id, y, tx, {across} FROM emb JOIN (SELECT unnest(range({tw})) AS tx) ON x >= {sx} AND x < {ex} GROUP BY ALL)
SELECT session_id, frame_id, tx AS x, ty AS y, {mean('r')}, {mean('g')}, {mean('b')}
FROM across JOIN (SELECT unnest(range({th})) AS ty) ON y >= {sy} AND y < {ey} GROUP BY session_id, frame_id, tx, ty"""


def _resized(name: str, tw: int, th: int):
    @query(name, _box_sql(tw, th))
    def run(spark, sf_dir):
        return R.to_pixels(R.resize_box(S.embedding_scanlines(spark, sf_dir), _KEYS, 8, 8, tw, th), _KEYS)


_resized("resize_box", 5, 3)
_resized("box_average", 2, 2)
_resized("apply_resize", 6, 6)  # width 6 of 8 x 8


@query("crop_scanlines", f"WITH {Q.EMB} SELECT session_id, frame_id, x - 3 AS x, y - 2 AS y, r, g, b FROM emb WHERE x BETWEEN 3 AND 5 AND y BETWEEN 2 AND 7")
def crop_lines(spark, sf_dir):
    return R.to_pixels(crop_scanlines(S.embedding_scanlines(spark, sf_dir), 3, 2, 3, 6), _KEYS)


# Stacks: the events of a user, three frames a stack, on a 1280 x 720 source at (10, 20).
_STACKS = """SELECT user_id * 1000000000 + (n - 1) // 3 AS stack_id, (n - 1) % 3 AS frame_index, event_id AS frame_id, 1280 AS width, 720 AS height, 10 AS src_x, 20 AS src_y
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"""
_REGIONS = [
    ("hud", 10, 20, 400, 100, "all", True, 50, "png", None, None),
    ("map", 900, 500, 300, 200, "newest", False, 120, "jpeg", 80, 200),
    ("log", 100, 600, 500, 100, "older", False, 30, "jpeg", 70, None),
    ("off", 1000, 700, 400, 100, "newest", False, 120, "png", None, None),
]
_REGION_KIND = (
    "name string, rx long, ry long, rw long, rh long, scope string, required boolean, region_priority int, region_format string, "
    "region_quality int, region_width int"
)
_OVERVIEW = {"older": {"format": "jpeg", "quality": 55, "width": 640}, "newest": {"format": "jpeg", "quality": 75, "width": 960}}
_VALUES = "(VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _REGIONS
) + ") AS g(name, rx, ry, rw, rh, scope, required, region_priority, region_format, region_quality, region_width)"
_PLAN = f"""WITH st AS ({_STACKS}), f AS (SELECT *, max(frame_index) OVER (PARTITION BY stack_id) AS top FROM st),
plan AS (
  SELECT stack_id, frame_index, frame_id, frame_index = top AS is_newest, width AS frame_width, height AS frame_height, 'overview' AS "view", 0 AS kind_rank,
    0 AS x, 0 AS y, 0 AS w, 0 AS h, true AS required, CASE top - frame_index WHEN 0 THEN 220 WHEN 1 THEN 60 ELSE 40 END AS priority,
    'jpeg' AS format, CASE WHEN frame_index = top THEN 75 ELSE 55 END AS quality, CASE WHEN frame_index = top THEN 960 ELSE 640 END AS width_policy, 'ok' AS status
  FROM f UNION ALL
  SELECT stack_id, frame_index, frame_id, frame_index = top, width, height, name, 1, rx - src_x, ry - src_y, rw, rh, required,
    CASE WHEN required THEN greatest(region_priority, 200) ELSE region_priority END, region_format, region_quality, region_width,
    CASE WHEN rx >= src_x AND ry >= src_y AND rx + rw <= src_x + width AND ry + rh <= src_y + height THEN 'ok' ELSE 'invalid_region' END
  FROM f JOIN {_VALUES} ON scope = 'all' OR scope = 'newest' AND frame_index = top OR scope = 'older' AND frame_index < top)"""


def _stacks(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    e = S.assign_frame_ids(e, "user_id", "ts", "event_id").withColumnRenamed("frame_id", "n")
    return e.selectExpr(
        "user_id", "user_id * 1000000000 + (n - 1) div 3 AS stack_id", "cast((n - 1) % 3 as int) AS frame_index", "event_id AS frame_id", "1280 AS width",
        "720 AS height", "10 AS src_x", "20 AS src_y",
    )


def _plan_of_users(spark, sf_dir):
    """The plan with its user, by whom the events are dealt out: what follows by user and stack shuffles no more."""
    return P.plan_views(_stacks(spark, sf_dir), spark.createDataFrame(_REGIONS, _REGION_KIND), _OVERVIEW, carry=("user_id",))


def _plan(spark, sf_dir):
    return _plan_of_users(spark, sf_dir).drop("user_id")


@query("plan_views", f'{_PLAN} SELECT * FROM plan')
def plan_views(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("regions_x_frames", f'{_PLAN} SELECT stack_id, frame_index, "view", status FROM plan WHERE kind_rank = 1')
def regions_x_frames(spark, sf_dir):
    return _plan(spark, sf_dir).filter("kind_rank = 1").select("stack_id", "frame_index", "view", "status")


@query("scope_filter", f'{_PLAN} SELECT "view", is_newest, count(*) AS n FROM plan GROUP BY "view", is_newest')
def scope_filter(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("view", "is_newest").agg(F.count("*").alias("n"))


@query("has_image_filter", f"{_PLAN} SELECT stack_id, count(*) AS images FROM plan WHERE format <> 'metadata' GROUP BY stack_id")
def has_image_filter(spark, sf_dir):
    return _plan(spark, sf_dir).filter("format <> 'metadata'").groupBy("stack_id").agg(F.count("*").alias("images"))


@query(
    "fitting_order",
    f"""{_PLAN} SELECT stack_id, frame_index, "view", row_number() OVER (PARTITION BY stack_id ORDER BY priority, frame_index, kind_rank, x, y, w, h, "view") AS place FROM plan""",
)
def fitting_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("stack_id").orderBy(*P.fitting_key())
    return _plan(spark, sf_dir).select("stack_id", "frame_index", "view", F.row_number().over(w).alias("place"))


@query("highest_required_priority", f"{_PLAN} SELECT stack_id, coalesce(max(priority) FILTER (WHERE required), 0) AS highest FROM plan GROUP BY stack_id")
def highest_required_priority(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return p.groupBy("stack_id").agg(F.coalesce(F.max(F.when(F.col("required"), F.col("priority"))), F.lit(0)).alias("highest"))


@query("presented_lookup", f"""{_PLAN} SELECT stack_id, max(frame_id) FILTER (WHERE is_newest AND "view" = 'overview') AS newest_id,
  max(width_policy) FILTER (WHERE is_newest AND "view" = 'overview') AS overview_width, max(x) FILTER (WHERE "view" = 'map') AS map_x FROM plan GROUP BY stack_id""")  # fmt: skip
def presented_lookup(spark, sf_dir):
    top = F.col("is_newest") & (F.col("view") == "overview")
    return _plan(spark, sf_dir).groupBy("stack_id").agg(
        F.max(F.when(top, F.col("frame_id"))).alias("newest_id"),
        F.max(F.when(top, F.col("width_policy"))).alias("overview_width"),
        F.max(F.when(F.col("view") == "map", F.col("x"))).alias("map_x"),
    )


@query("view_transform", f"""{_PLAN} SELECT stack_id, frame_index, "view", 10 + x AS offset_x, 20 + y AS offset_y,
  CASE WHEN w = 0 THEN frame_width ELSE w END::DOUBLE / coalesce(width_policy, CASE WHEN w = 0 THEN frame_width ELSE w END) AS scale_x FROM plan WHERE status = 'ok'""")  # fmt: skip
def view_transform(spark, sf_dir):
    w = F.when(F.col("w") == 0, F.col("frame_width")).otherwise(F.col("w"))
    source = G.to_source(G.rect(F.col("x"), F.col("y"), w, F.col("frame_height")), F.lit(10), F.lit(20))
    t = G.transform(source, F.coalesce("width_policy", w), F.col("frame_height"))
    return _plan(spark, sf_dir).filter("status = 'ok'").select(
        "stack_id", "frame_index", "view", t["offset_x"].alias("offset_x"), t["offset_y"].alias("offset_y"), t["scale_x"].alias("scale_x")
    )


# Fitting with a synthetic size: width times quality for jpeg, width times 120 for png.
_SIZE_SQL = "actual_width * CASE WHEN format = 'jpeg' THEN actual_quality ELSE 120 END"
_STATES = f"""{_PLAN},
p AS (SELECT *, CASE WHEN is_newest THEN 480 ELSE 320 END AS min_width, CASE WHEN is_newest THEN 55 ELSE 40 END AS min_quality,
        coalesce(width_policy, frame_width) AS cw FROM plan WHERE status = 'ok'),
steps AS (SELECT *, list_filter([85, 75, 65, 55, 45, 35], lambda s: s < quality AND s >= min_quality) AS qs,
        list_filter([1920, 1280, 960, 640, 480, 320], lambda s: s < cw AND s >= min_width) AS ws FROM p),
st2 AS (SELECT *, CASE WHEN is_newest THEN least(greatest(state - 13, 0), 6) ELSE least(state, 6) END AS nq,
        CASE WHEN is_newest THEN least(greatest(state - 19, 0), 6) ELSE least(greatest(state - 6, 0), 6) END AS nw
        FROM steps, (SELECT unnest(range(26)) AS state)),
states AS (SELECT *, format <> 'metadata' AND (required OR state < 13) AS shown,
        CASE WHEN format = 'jpeg' AND least(nq, len(qs)) > 0 THEN qs[least(nq, len(qs))] ELSE quality END AS actual_quality,
        CASE WHEN least(nw, len(ws)) > 0 THEN ws[least(nw, len(ws))] ELSE cw END AS actual_width FROM st2),
totals AS MATERIALIZED (SELECT stack_id, state, sum(CASE WHEN shown THEN {_SIZE_SQL} ELSE 0 END)::BIGINT AS bytes FROM states GROUP BY stack_id, state),
budget AS (SELECT DISTINCT stack_id, 60000 + stack_id * 7919 % 500000 AS budget FROM p)"""


def _floors(plan):
    newest = F.col("is_newest")
    p = plan.filter("status = 'ok'")
    return p.withColumns({"min_width": F.when(newest, 480).otherwise(320), "min_quality": F.when(newest, 55).otherwise(40)})


def _fitted(spark, sf_dir):
    return _floors(_plan(spark, sf_dir))


def _bytes(spark, sf_dir):
    """The bytes of each stack's plan in every state."""
    return P.state_bytes(P.view_steps(_floors(_plan_of_users(spark, sf_dir))), _size(), "user_id", "stack_id")


def _budget():
    return F.lit(60000) + F.col("stack_id") * 7919 % 500000


def _size():
    return F.col("actual_width") * F.when(F.col("format") == "jpeg", F.col("actual_quality")).otherwise(120)


@query(
    "fit_plan",
    f"""{_STATES}, r AS (SELECT stack_id, min(state) FILTER (WHERE bytes <= budget) AS state, min(bytes) AS least_bytes FROM totals JOIN budget USING (stack_id) GROUP BY stack_id)
SELECT r.stack_id, CASE WHEN r.state = 0 THEN 'exact' WHEN r.state > 0 THEN 'adjusted' ELSE 'payload_budget_exceeded' END AS fit, r.state,
  totals.bytes AS actual_bytes, least_bytes FROM r LEFT JOIN totals ON totals.stack_id = r.stack_id AND totals.state = r.state""",
)
def fit_plan(spark, sf_dir):
    return P.fit_plans(_bytes(spark, sf_dir), _budget(), "stack_id")


def _state(name: str, state: int):
    @query(
        name,
        f'{_STATES} SELECT stack_id, frame_index, "view", shown, actual_quality, actual_width FROM states WHERE state = {state}',
    )
    def run(spark, sf_dir):
        s = P.ladder_states(_fitted(spark, sf_dir), F.lit(state))
        return s.select("stack_id", "frame_index", "view", "shown", "actual_quality", "actual_width")


_state("rung_lower_quality", 1)
_state("rung_lower_resolution", 7)
_state("rung_omit_optional", 13)


@query("plan_sizes", f"{_STATES} SELECT stack_id, bytes FROM totals WHERE state = 0")
def plan_sizes(spark, sf_dir):
    return _bytes(spark, sf_dir).select("stack_id", F.col("bytes")[0].alias("bytes"))


@query("minimum_payload", f"{_STATES} SELECT stack_id, min(bytes) AS least_bytes FROM totals GROUP BY stack_id")
def minimum_payload(spark, sf_dir):
    return _bytes(spark, sf_dir).select("stack_id", F.array_min("bytes").alias("least_bytes"))


# Stacks of frames with pixels: an event's frame is a texture of 64 x 48, one of 32, and every view of it is encoded.
_SMALL_REGIONS = [
    ("hud", 12, 21, 20, 10, "all", True, 50, "png", None, None),
    ("map", 40, 40, 24, 16, "newest", False, 120, "jpeg", 80, 12),
    ("log", 10, 50, 32, 8, "older", False, 30, "jpeg", 70, None),
    ("off", 60, 60, 40, 10, "newest", False, 120, "png", None, None),
]
_SMALL_OVERVIEW = {"older": {"format": "jpeg", "quality": 55, "width": 32}, "newest": {"format": "jpeg", "quality": 85, "width": None}}


def _small_plan(frames, *base: str):
    """The views of frames that know is_newest, in the order of no stack: their priorities are those of a single frame."""
    f = frames.withColumns({"frame_index": F.lit(0), "total": F.lit(1)})
    regions = frames.sparkSession.createDataFrame(_SMALL_REGIONS, _REGION_KIND)
    return _floors(P.views_of(f, regions, _SMALL_OVERVIEW, "newest_detailed", *base))


def _small_frames(spark, sf_dir, newest_alone: bool = False):
    f = _stacks(spark, sf_dir).withColumns({"width": F.lit(64), "height": F.lit(48)})
    if newest_alone:  # stacks of one frame: each user's last
        f = f.groupBy("user_id").agg(F.max_by(F.struct(*[c for c in f.columns if c != "user_id"]), F.struct("stack_id", "frame_index")).alias("f"))
        f = f.select("user_id", "f.*").withColumns({"stack_id": F.col("user_id"), "frame_index": F.lit(0)})
    return f.withColumn("content", F.col("frame_id") % 32)


def _marked(spark, sf_dir):
    return P.mark_newest(_small_frames(spark, sf_dir), "user_id", "stack_id")


def _small_steps(spark, sf_dir):
    """Steps of all frames, a row each: for the counts of image_stages, and for tests."""
    carry = ("user_id", "content", "src_x", "src_y")
    f = _small_frames(spark, sf_dir)
    p = P.mark_newest(f, "user_id", "stack_id")
    base = (*carry, "stack_id", "frame_index", "frame_id", "is_newest")
    return P.view_steps(_floors(P.views_of(p, spark.createDataFrame(_SMALL_REGIONS, _REGION_KIND), _SMALL_OVERVIEW, "newest_detailed", *base)))


def _textures(spark, sf_dir):
    seeds = S.table(spark, sf_dir, "events").select((F.col("event_id") % 32).alias("content")).distinct()
    return texture_frames(seeds.withColumn("seed", F.col("content") * 40 % 256), 64, 48)


def _small_budget():
    return F.lit(6000) + F.col("stack_id") % 1000003 * 7919 % 40000


def _measured(spark, sf_dir):
    f = _marked(spark, sf_dir)
    return P.plan_bytes(f, P.kind_bytes(f, _small_plan, _textures(spark, sf_dir)), "user_id", "stack_id")


def _presented(spark, sf_dir, budget, images: bool):
    """The frames of all stacks that fit, with fit, state and their views nested."""
    f, textures = _marked(spark, sf_dir), _textures(spark, sf_dir)
    fitted = P.fitted_frames(f, P.kind_bytes(f, _small_plan, textures), budget, "user_id", "stack_id")
    return P.present(fitted, P.frame_views(P.kind_views(fitted, _small_plan, textures), images), "user_id", "stack_id")


@query("measure_plan")
def measure_plan(spark, sf_dir):
    """Base64 characters of every stack's images, each distinct setting encoded once."""
    return _measured(spark, sf_dir).select("stack_id", F.col("bytes")[0].alias("bytes"))


@query("fit_measured")
def fit_measured(spark, sf_dir):
    """Stacks fitted to budgets by the sizes of their encoded images."""
    return P.fit_plans(_measured(spark, sf_dir), _small_budget(), "stack_id")


@query("to_response")
def to_response(spark, sf_dir):
    """The document of each fitted stack: frames, views, maps to the source, images, totals."""
    frames = _presented(spark, sf_dir, _small_budget(), images=True)
    return P.documents(frames, "user_id", "stack_id", "fit", "state").select("stack_id", "fit", "state", "document")


def _small_sql(stacks: str) -> str:
    values = "(VALUES " + ", ".join(
        "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _SMALL_REGIONS
    ) + ") AS g(name, rx, ry, rw, rh, scope, required, region_priority, region_format, region_quality, region_width)"
    return f"""WITH st AS ({stacks}), f AS (SELECT *, max(frame_index) OVER (PARTITION BY stack_id) AS top FROM st),
v AS (
  SELECT user_id, stack_id, frame_index, frame_id, 'overview' AS "view", 0 AS kind_rank, true AS required, 'jpeg' AS format, CASE WHEN frame_index = top THEN 85 ELSE 55 END AS quality,
    0 AS x, 0 AS y, 64 AS w, 48 AS h, CASE WHEN frame_index = top THEN 64 ELSE 32 END AS iw FROM f
  UNION ALL
  SELECT user_id, stack_id, frame_index, frame_id, name, 1, required, region_format, region_quality, rx - 10, ry - 20, rw, rh, coalesce(region_width, rw)
  FROM f JOIN {values} ON (scope = 'all' OR scope = 'newest' AND frame_index = top OR scope = 'older' AND frame_index < top) AND rx + rw <= 74 AND ry + rh <= 68),
r AS (SELECT *, greatest(1, round(h * iw::DOUBLE / w))::INT AS ih FROM v)"""


@query(
    "present_stack",
    _small_sql(_STACKS.replace("SELECT user_id *", "SELECT user_id, user_id *", 1))
    + """,
docs AS (
  SELECT stack_id, frame_index, frame_id, '{"view":"' || "view" || '","required":' || required || ',"shown":true,"format":"' || format || '"'
    || CASE WHEN format = 'jpeg' THEN ',"quality":' || quality ELSE '' END || ',"image_width":' || iw || ',"image_height":' || ih
    || ',"source":{"x":' || x || ',"y":' || y || ',"width":' || w || ',"height":' || h || '},"transform":{"offset_x":' || x + 10 || ',"offset_y":' || y + 20
    || ',"scale_x":' || w::DOUBLE / iw || ',"scale_y":' || h::DOUBLE / ih || '}}' AS doc, kind_rank, "view" FROM r),
frames AS (
  SELECT stack_id, frame_index, count(*) AS n, '{"frame_index":' || frame_index || ',"frame_id":' || frame_id || ',"views":['
    || string_agg(doc, ',' ORDER BY kind_rank, "view") || '],"images":' || count(*) || '}' AS doc FROM docs GROUP BY stack_id, frame_index, frame_id)
SELECT stack_id, '{"frames":[' || string_agg(doc, ',' ORDER BY frame_index) || '],"images":' || sum(n)::BIGINT || '}' AS document FROM frames GROUP BY stack_id""",
)
def present_stack(spark, sf_dir):
    """Documents of all stacks as their plan has them, without the images themselves."""
    frames = _presented(spark, sf_dir, F.lit(1 << 40), images=False)  # without a limit: state 0
    return P.documents(frames, "user_id", "stack_id", images=False).select("stack_id", "document")


_LAST = """SELECT user_id, user_id AS stack_id, 0 AS frame_index, event_id AS frame_id
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"""


@query(
    "present_frame",
    _small_sql(_LAST) + """ SELECT user_id, frame_id, "view", required, format, CASE WHEN format = 'jpeg' THEN quality END AS quality, iw AS image_width, ih AS image_height,
  x + 10 AS offset_x, y + 20 AS offset_y, w::DOUBLE / iw AS scale_x, h::DOUBLE / ih AS scale_y, true AS has_image FROM r""",
)
def present_frame(spark, sf_dir):
    """Each user's newest frame: its overview and regions at their own sizes, encoded."""
    f = _small_frames(spark, sf_dir, newest_alone=True).withColumns({"is_newest": F.lit(True), "state": F.lit(0)})
    v = P.present(f, P.kind_views(f, _small_plan, _textures(spark, sf_dir)))
    return v.select(
        "user_id", "frame_id", "view", "required", "format", "quality", "image_width", "image_height", "offset_x", "offset_y", "scale_x", "scale_y",
        (F.octet_length("data") > 0).alias("has_image"),
    )


@query(
    "image_stages",
    _small_sql(_STACKS.replace("SELECT user_id *", "SELECT user_id, user_id *", 1))
    + """, one AS (SELECT DISTINCT frame_id % 32 AS content, x, y, w, h, iw, ih, format, CASE WHEN format = 'jpeg' THEN quality END AS quality FROM r)
SELECT count(*) AS images, sum(w * h * 3)::BIGINT AS cropped_bytes, sum(iw * ih * 3)::BIGINT AS resized_bytes FROM one""",
)
def image_stages(spark, sf_dir):
    """What passes the stages of all distinct images; their times and encoded bytes: presentation.observe_stages."""
    s = P.with_setting(_small_steps(spark, sf_dir).filter("from_state = 0"))
    images, seen = P.observe_stages(P.images_of(s.filter("shown"), _textures(spark, sf_dir)))
    return images.agg(
        F.count("*").alias("images"),
        F.sum(F.col("crop_w") * F.col("crop_h") * 3).alias("cropped_bytes"),
        F.sum(F.col("to_width") * F.col("to_height") * 3).alias("resized_bytes"),
    )


@query(
    "older_views_exhausted",
    f"""{_STATES} SELECT stack_id, state, coalesce(bool_and((format <> 'jpeg' OR len(list_filter(qs, lambda s: s < actual_quality)) = 0) AND len(list_filter(ws, lambda s: s < actual_width)) = 0)
  FILTER (WHERE NOT is_newest AND shown), true) AS exhausted, bool_or(is_newest AND (actual_quality <> quality OR actual_width <> cw OR NOT shown AND format <> 'metadata')) AS newest_degraded
FROM states GROUP BY stack_id, state""",
)
def older_views_exhausted(spark, sf_dir):
    plan = _floors(_plan_of_users(spark, sf_dir))
    return P.exhaustion(plan, "user_id", "stack_id").drop("user_id")


_LADDER = "SELECT o_orderkey AS id, (o_custkey % 110)::INT AS q, (o_orderkey % 2200)::INT AS w, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 50 END AS q_floor, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 500 END AS w_floor FROM orders"


def _ladder(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "cast(o_custkey % 110 as int) AS q", "cast(o_orderkey % 2200 as int) AS w",
        "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 50 END AS q_floor", "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 500 END AS w_floor",
    )


for _n, _l, _c, _f in (("ladder_next_quality", P.QUALITY_LADDER, "q", "q_floor"), ("ladder_next_width", P.WIDTH_LADDER, "w", "w_floor")):
    scalar(
        _n,
        _ladder,
        _LADDER,
        ["id"],
        (lambda l, c, f: lambda: {"step": P.next_step(l, F.col(c), F.col(f))})(_l, _c, _f),
        {"step": f"list_max(list_filter({_l}, lambda s: s < {_c} AND s >= coalesce({_f}, 0)))"},
    )

_CHANGED = f"WITH {Q.EMB}, c AS ({Q.emb_consecutive('rgb', 40, 0.1)})"
_BACK = "coalesce(bbox_w * bbox_h / 64.0::DOUBLE > 0.6, false)"


@query(
    "changed_region",
    f"""{_CHANGED} SELECT session_id, frame_id, {_BACK} AS fell_back,
  CASE WHEN {_BACK} THEN 0 ELSE greatest(bbox_x - 1, 0) END AS returned_x, CASE WHEN {_BACK} THEN 0 ELSE greatest(bbox_y - 1, 0) END AS returned_y,
  CASE WHEN {_BACK} THEN 8 ELSE least(bbox_x + bbox_w + 1, 8) - greatest(bbox_x - 1, 0) END AS returned_width,
  CASE WHEN {_BACK} THEN 8 ELSE least(bbox_y + bbox_h + 1, 8) - greatest(bbox_y - 1, 0) END AS returned_height
FROM c WHERE bbox_x IS NOT NULL""",
)
def changed_region(spark, sf_dir):
    c = C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), C.CompareOptions("rgb", 40, 0.1), "lines").filter("bbox_x is not null")
    return P.changed_region(c, _KEYS, 1, 0.6, G.rect(F.lit(0), F.lit(0), F.lit(8), F.lit(8)))


@query("changed_fallback", f"{_CHANGED} SELECT session_id, frame_id, {_BACK} AS fell_back FROM c")
def changed_fallback(spark, sf_dir):
    c = C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), C.CompareOptions("rgb", 40, 0.1), "lines")
    out = P.changed_region(c, _KEYS, 1, 0.6, G.rect(F.lit(0), F.lit(0), F.lit(8), F.lit(8)))
    return out.select(*_KEYS, F.coalesce("fell_back", F.lit(False)).alias("fell_back"))


@query("no_change", f"{_CHANGED} SELECT session_id, frame_id, bbox_x IS NULL AS no_change FROM c")
def no_change(spark, sf_dir):
    c = C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), C.CompareOptions("rgb", 40, 0.1), "lines")
    return c.select(*_KEYS, F.col("bbox_x").isNull().alias("no_change"))


@query("region_pixels", f"WITH {Q.EMB} SELECT name, session_id, frame_id, count(*) AS pixels, sum(r)::BIGINT AS total FROM emb JOIN (VALUES ('a', 0, 0, 3, 3), ('b', 2, 4, 6, 4)) AS g(name, rx, ry, rw, rh) "
       "ON x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh GROUP BY name, session_id, frame_id")  # fmt: skip
def region_pixels(spark, sf_dir):
    g = spark.createDataFrame([("a", 0, 0, 3, 3), ("b", 2, 4, 6, 4)], "name string, rx int, ry int, rw int, rh int")  # two rows
    j = pixels_in(S.embedding_pixels(spark, sf_dir), g, tile=4)
    return j.groupBy("name", *_KEYS).agg(F.count("*").alias("pixels"), F.sum("r").alias("total"))


_POLICIES = """SELECT o_custkey AS policy, ['hud', 'map', 'overview', '', 'log'][o_orderkey % 5 + 1] AS name, o_orderkey % 17 AS w, o_orderkey % 2 = 0 AS metadata_only, o_orderkey % 19 = 0 AS base64 FROM orders"""


def _policies(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS policy", "element_at(array('hud', 'map', 'overview', '', 'log'), cast(o_orderkey % 5 + 1 as int)) AS name",
        "o_orderkey % 17 AS w", "o_orderkey % 2 = 0 AS metadata_only", "o_orderkey % 19 = 0 AS base64",
    )


@query("duplicate_region_names", f"SELECT policy, name, count(*) AS n FROM ({_POLICIES}) GROUP BY policy, name HAVING count(*) > 1")
def duplicate_region_names(spark, sf_dir):
    return P.duplicate_names(_policies(spark, sf_dir), "policy")


@query(
    "validate_policy",
    f"""WITH p AS ({_POLICIES}), n AS (SELECT policy, max(c) AS most FROM (SELECT policy, name, count(*) AS c FROM p GROUP BY policy, name) GROUP BY policy)
SELECT policy, CASE WHEN bool_or(name = '') OR bool_or(name = 'overview') OR any_value(most) > 1 OR bool_or(w = 0) OR bool_or(metadata_only AND base64)
  THEN 'invalid_presentation_policy' ELSE 'ok' END AS status FROM p JOIN n USING (policy) GROUP BY policy""",
)
def validate_policy(spark, sf_dir):
    p = _policies(spark, sf_dir)
    per = p.groupBy("policy", "name").agg(
        F.count("*").alias("n"), F.bool_or((F.col("w") == 0) | (F.col("metadata_only") & F.col("base64"))).alias("bad")
    )
    wrong = F.col("name").isin("", "overview") | (F.col("n") > 1) | F.col("bad")
    return per.groupBy("policy").agg(F.when(F.bool_or(wrong), "invalid_presentation_policy").otherwise("ok").alias("status"))


_MODES = ("all_same", "newest_detailed", "newest_only", "metadata_older")


def _modes(spark, sf_dir):
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("event_id") % 4 + 1).cast("int"))
    return S.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), mode.alias("mode"), (F.col("event_id") % 3 == 0).alias("is_newest"))


_MODES_SQL = f"SELECT event_id AS id, {list(_MODES)}[event_id % 4 + 1] AS mode, event_id % 3 = 0 AS is_newest FROM events"
_IMAGE = "CASE WHEN is_newest OR mode = 'all_same' THEN 'newest' WHEN mode = 'newest_detailed' THEN 'older' ELSE 'metadata' END"
scalar("temporal_image_for", _modes, _MODES_SQL, ["id"], lambda: {"image": P.image_for(F.col("mode"), F.col("is_newest"))}, {"image": _IMAGE})
scalar("has_image_at", _modes, _MODES_SQL, ["id"], lambda: {"has": P.image_for(F.col("mode"), F.col("is_newest")) != "metadata"}, {"has": f"{_IMAGE} <> 'metadata'"})
_PRESETS = [
    ("png", False, "png", 80, None, True), ("png_width", False, "png", 80, 640, True), ("jpeg", False, "jpeg", 75, None, True),
    ("jpeg_width", False, "jpeg", 75, 640, True), ("metadata_only", True, "png", 80, None, False),
]


@query("policy_presets", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _PRESETS)
       + ") AS t(preset, metadata_only, format, quality, width, base64)")
def policy_presets(spark, sf_dir):
    return spark.createDataFrame(_PRESETS, "preset string, metadata_only boolean, format string, quality int, width int, base64 boolean")


@query(
    "requests_any_image",
    "SELECT o_orderkey AS id, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_custkey % 5 = 0 OR o_custkey % 7 = 0 AS any_image FROM orders",
)
def requests_any_image(spark, sf_dir):
    return S.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_custkey % 5 = 0 OR o_custkey % 7 = 0 AS any_image"
    )


@query("within_budget", f"{_STATES} SELECT stack_id, state, bytes <= budget AS within FROM totals JOIN budget USING (stack_id)")
def within_budget(spark, sf_dir):
    t = _bytes(spark, sf_dir).select("stack_id", F.posexplode("bytes").alias("state", "bytes"))
    return t.select("stack_id", "state", (F.col("bytes") <= _budget()).alias("within"))


def _packed(spark, sf_dir, seeds: int = 6):
    return packed(S.to_scanlines(S.texture(spark, 64, 48, [40 * i for i in range(seeds)]), _KEYS), _KEYS)


def _encoded(spark, sf_dir, kind: str, quality: int = 75, effort: str = "default"):
    f = _packed(spark, sf_dir).withColumns({"format": F.lit(kind), "quality": F.lit(quality), "effort": F.lit(effort)})
    return codec.encode(f, _KEYS)


@query("encode_jpeg")
def encode_jpeg(spark, sf_dir):
    e = _encoded(spark, sf_dir, "jpeg")
    return e.select(*_KEYS, F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("sha256"), parsing.detect_format(F.col("data")).alias("format"))


@query("encode_png")
def encode_png(spark, sf_dir):
    e = _encoded(spark, sf_dir, "png")
    return e.select(*_KEYS, F.octet_length("data").alias("bytes"), parsing.detect_format(F.col("data")).alias("format"))


@query("encode_dispatch")
def encode_dispatch(spark, sf_dir):
    f = _packed(spark, sf_dir).withColumns(
        {"format": F.when(F.col("frame_id") % 3 == 0, "metadata").when(F.col("frame_id") % 3 == 1, "jpeg").otherwise("png"), "quality": F.lit(80), "effort": F.lit("fast")}
    )
    e = codec.encode(f, _KEYS)
    return e.select(*_KEYS, "format", parsing.detect_format(F.col("data")).alias("detected"))


@query(
    "decode_png",
    "SELECT 1::BIGINT AS session_id, i // 3072 + 1 AS frame_id, sum(n + n * 3 % 256 + (n + 91) % 256)::BIGINT AS total FROM "
    "(SELECT i, xor((7 * (i % 3072 % 64) + 13 * (i % 3072 // 64)) % 256, i // 3072 * 40 % 256) AS n FROM (SELECT unnest(range(18432)) AS i)) GROUP BY i // 3072",
)
def decode_png(spark, sf_dir):
    """PNG encoding and decoding round trip: the channel sums of the decoded frames."""
    import pandas as pd

    def run(batches):
        for b in batches:
            sums = [int(codec.decode_png(d).astype(np.int64).sum()) for d in b["data"]]
            yield pd.DataFrame({"session_id": b["session_id"], "frame_id": b["frame_id"], "total": sums})

    return _encoded(spark, sf_dir, "png").mapInPandas(run, "session_id long, frame_id long, total long")


@query("payload_totals")
def payload_totals(spark, sf_dir):
    e = _encoded(spark, sf_dir, "jpeg").select(*_KEYS, F.octet_length("data").cast("long").alias("bytes"))
    e = e.withColumn("base64_chars", parsing.base64_length(F.col("bytes")))
    return e.groupBy("session_id").agg(F.sum("bytes").alias("bytes"), F.sum("base64_chars").alias("base64_chars"), F.count("*").alias("frames"))


_HUFFMAN = {"dc_luma": codec.DC_LUMA, "ac_luma": codec.AC_LUMA, "dc_chroma": codec.DC_CHROMA, "ac_chroma": codec.AC_CHROMA}
#: (table, place, value, length) of the standard's lists; a code is the sum of the shares of those before it.
_LENGTHS = ", ".join(
    f"('{name}', {place}, {value}, {length})"
    for name, (bits, values) in _HUFFMAN.items()
    for place, (value, length) in enumerate(zip(values, [k for k, n in enumerate(bits, 1) for _ in range(n)]))
)


@query("huffman_table", f"""SELECT name, value, lpad(bin((coalesce(sum(1::BIGINT << (16 - length)) OVER before, 0) // (1::BIGINT << (16 - length)))::BIGINT), length, '0') AS code
FROM (VALUES {_LENGTHS}) AS t(name, place, value, length) WINDOW before AS (PARTITION BY name ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def huffman_table(spark, sf_dir):
    rows = [(k, v, c) for k, t in _HUFFMAN.items() for v, c in codec.huffman_codes(t).items()]
    return spark.createDataFrame(rows, "name string, value int, code string")


@query("to_json", f"""{_CHANGED} SELECT session_id, frame_id, '{{"mode":"rgb","changed":' || changed || ',"changed_pixels":' || changed_pixels || ',"total_pixels":' || total_pixels
  || CASE WHEN bbox_x IS NULL THEN '' ELSE ',"bounding_box":{{"x":' || bbox_x || ',"y":' || bbox_y || ',"width":' || bbox_w || ',"height":' || bbox_h || '}}' END || '}}' AS document FROM c""")  # fmt: skip
def to_json(spark, sf_dir):
    c = C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), C.CompareOptions("rgb", 40, 0.1), "lines")
    box = F.when(F.col("bbox_x").isNotNull(), F.struct(F.col("bbox_x").alias("x"), F.col("bbox_y").alias("y"), F.col("bbox_w").alias("width"), F.col("bbox_h").alias("height")))
    return c.select(*_KEYS, F.to_json(F.struct("mode", "changed", "changed_pixels", "total_pixels", box.alias("bounding_box"))).alias("document"))


@query("plan_names", f"""{_PLAN} SELECT stack_id, count(DISTINCT frame_id) AS frames, count(*) AS views,
  list("view" ORDER BY frame_index, kind_rank, "view") AS names FROM plan WHERE status = 'ok' GROUP BY stack_id""")  # fmt: skip
def plan_names(spark, sf_dir):
    p = _plan(spark, sf_dir).filter("status = 'ok'")
    g = p.groupBy("stack_id").agg(  # at most 8 frames of a few views a stack
        F.countDistinct("frame_id").alias("frames"), F.count("*").alias("views"),
        F.array_sort(F.collect_list(F.struct("frame_index", "kind_rank", "view"))).alias("v"),
    )
    return g.select("stack_id", "frames", "views", F.col("v.view").alias("names"))


@query("client_accessors", f"""{_CHANGED} SELECT session_id, max(frame_id) AS newest_id, bool_or(changed) AS any_changed, count(*) FILTER (WHERE bbox_x IS NOT NULL) AS boxes FROM c GROUP BY session_id""")
def client_accessors(spark, sf_dir):
    c = C.compare_consecutive(S.embedding_scanlines(spark, sf_dir), C.CompareOptions("rgb", 40, 0.1), "lines")
    return c.groupBy("session_id").agg(F.max("frame_id").alias("newest_id"), F.bool_or("changed").alias("any_changed"), F.count("bbox_x").alias("boxes"))
