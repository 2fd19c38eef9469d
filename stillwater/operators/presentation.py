"""Presentation of frame stacks: which views are shown, how, and how a plan is fitted to a budget.

Policies are small tables; plans are rows (one a frame and view). Fitting knows the states of the ladder, a fixed number
for each plan: a view changes in at most 13 of them, so each of its settings counts from one state to the next in which
it changes, and sums by state give the size of a whole plan in every state at once: no loop, any number of plans.
Frames of one kind (FRAME_KIND) have the same views, so sizes and images are made once a kind, by encoding each distinct
setting once, written, and joined to the frames: by a broadcast where Spark finds their table small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import codec, kernels
from ..functions import geometry as G
from ..sources.tables import written

# Ladders of fitting and priorities of views.
QUALITY_LADDER = [85, 75, 65, 55, 45, 35]
WIDTH_LADDER = [1920, 1280, 960, 640, 480, 320]
NEWEST, REQUIRED_REGION, OPTIONAL_REGION, OLD, OLDEST = 220, 200, 120, 60, 40

#: Steps of each rung, in order: older quality, older width, omission of optional views, newest quality, newest width.
_RUNGS = (len(QUALITY_LADDER), len(WIDTH_LADDER), 1, len(QUALITY_LADDER), len(WIDTH_LADDER))


#: Regions of one policy at most.
MAX_REGIONS = 64
#: States of the ladder, the plan itself included.
STATES = sum(_RUNGS) + 1
#: Rows and bytes (as JSON) up to which a table of kinds' views is broadcast to the frames.
BROADCAST_KINDS, BROADCAST_BYTES = 10_000, 32 << 20
#: Bytes of views (as JSON) that a task gathers into documents, about.
GATHERED_BYTES = 64 << 20
#: The column that orders the frames of plans by what they show.
ALIKE = "alike"


def mark_newest(frames: DataFrame, *stack: str) -> DataFrame:
    """frames (stack, frame_index ...) with total and is_newest, by position."""
    total = (F.max("frame_index").over(Window.partitionBy(*(stack or ("stack_id",)))) + 1).alias("total")
    return frames.select("*", total).withColumn("is_newest", F.col("frame_index") + 1 == F.col("total"))


def overview_priority(index: Column, total: Column) -> Column:
    back = total - 1 - index
    return F.when(back == 0, NEWEST).when(back == 1, OLD).otherwise(OLDEST)


def scope_applies(scope: Column, is_newest: Column) -> Column:
    return F.when(scope == "newest", is_newest).when(scope == "older", ~is_newest).otherwise(F.lit(True))


def image_for(mode: Column, is_newest: Column, older: str = "older", newest: str = "newest") -> Column:
    """Which image settings a frame of a temporal mode takes: older, newest, or none."""
    return (
        F.when(is_newest | (mode == "all_same"), newest).when(mode == "newest_detailed", older).otherwise("metadata")
    )


def region_rows(regions: DataFrame) -> list:
    """The regions of a policy, whose number is bounded."""
    rows = regions.limit(MAX_REGIONS + 1).collect()
    if len(rows) > MAX_REGIONS:
        raise EngineError("invalid_presentation_policy", f"a policy has at most {MAX_REGIONS} regions")
    return rows


def plan_views(frames: DataFrame, regions: DataFrame, overview: dict, mode: str = "newest_detailed", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row a view: every frame's overview, then the regions that apply to it, exploded from the frame's one row.

    frames: stack_id, frame_index, frame_id, width, height, src_x, src_y. regions (MAX_REGIONS at most): name, rect in
    source coordinates, scope, required, priority, format, quality, width_policy. overview: older and newest settings
    (format, quality, width). carry: more columns of frames; those of them that name the frames' partitioning keep it. A
    region outside a frame gives status invalid_region.
    """
    base = (*carry, "stack_id", "frame_index", "frame_id", "is_newest")
    return views_of(mark_newest(frames, *carry, "stack_id"), regions, overview, mode, *base)


def views_of(f: DataFrame, regions: DataFrame, overview: dict, mode: str, *base: str) -> DataFrame:
    """The views (see plan_views) of frames that know their total and is_newest, with the columns ``base`` of their frame."""
    which = image_for(F.lit(mode), F.col("is_newest"))
    pick = lambda k: F.when(which == "newest", F.lit(overview["newest"][k])).when(which == "older", F.lit(overview["older"][k]))

    def view(name, rank, local, required, priority, kind, quality, width, status):
        values = {"view": F.lit(name), "kind_rank": F.lit(rank)}
        values |= {c: local[k].cast("long") for c, k in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))}
        values |= {"required": F.lit(required), "priority": priority.cast("int"), "format": kind}
        values |= {"quality": quality.cast("int"), "width_policy": width.cast("int"), "status": status}
        return F.struct(*[v.alias(c) for c, v in values.items()])

    none = dict.fromkeys(("x", "y", "width", "height"), F.lit(0))
    rank = overview_priority(F.col("frame_index"), F.col("total"))
    views = [view("overview", 0, none, True, rank, F.coalesce(pick("format"), F.lit("metadata")), pick("quality"), pick("width"), F.lit("ok"))]
    bounds = G.rect(F.col("src_x"), F.col("src_y"), F.col("width"), F.col("height"))
    for r in region_rows(regions):
        rect = G.rect(*[F.lit(v) for v in (r.rx, r.ry, r.rw, r.rh)])
        priority = F.lit(max(r.region_priority, REQUIRED_REGION) if r.required else r.region_priority)
        status = F.when(G.within(rect, bounds), "ok").otherwise("invalid_region")
        local = G.to_local(rect, F.col("src_x"), F.col("src_y"))
        local = {k: local[k] for k in none}
        made = view(r.name, 1, local, r.required, priority, F.lit(r.region_format), F.lit(r.region_quality), F.lit(r.region_width), status)
        views.append(F.when(scope_applies(F.lit(r.scope), F.col("is_newest")), made))
    each = F.explode(F.filter(F.array(*views), lambda v: v.isNotNull())).alias("v")
    return f.select(*base, F.col("width").alias("frame_width"), F.col("height").alias("frame_height"), each).select(*base, "frame_width", "frame_height", "v.*")


def fitting_key() -> list[Column]:
    """The total order in which views are degraded, least valuable first."""
    return [F.col(c) for c in ("priority", "frame_index", "kind_rank", "x", "y", "w", "h", "view")]


def steps_below(ladder: list[int], current: Column, floor: Column) -> Column:
    """Ladder steps under ``current`` and not under ``floor``, largest first."""
    return F.filter(F.array(*[F.lit(s) for s in ladder]), lambda s: (s < current) & (s >= F.coalesce(floor, F.lit(0))))


def after_steps(steps: Column, n: Column, current: Column) -> Column:
    """The value after n steps, stopping at the last."""
    at = F.least(n, F.size(steps))
    return F.when(at > 0, F.get(steps, at - 1)).otherwise(current)


def next_step(ladder: list[int], current: Column, floor: Column) -> Column:
    return F.get(steps_below(ladder, current, floor), F.lit(0))


def ladder_states(plan: DataFrame, state: Column | None = None) -> DataFrame:
    """Each view of a plan in each state of the ladder, 0 being the plan itself: state, quality, shown_width, shown.

    plan: see plan_views, with min_quality and min_width. States past what a view can give leave it as it is. state: the
    one state of the row to show, instead of all.
    """
    ends = [sum(_RUNGS[: i + 1]) for i in range(len(_RUNGS))]
    s = plan.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(ends[-1]))) if state is None else state)
    done = lambda i: F.greatest(F.lit(0), F.least(F.col("state") - (ends[i] - _RUNGS[i]), F.lit(_RUNGS[i])))
    image = F.col("format") != "metadata"
    shown = image & (F.col("required") | (done(2) == 0))
    current = F.coalesce("width_policy", "frame_width")
    width_steps = steps_below(WIDTH_LADDER, current, F.col("min_width"))
    quality_steps = steps_below(QUALITY_LADDER, F.col("quality"), F.col("min_quality"))
    n_quality = F.when(F.col("is_newest"), done(3)).otherwise(done(0))
    n_width = F.when(F.col("is_newest"), done(4)).otherwise(done(1))
    quality = F.when(F.col("format") == "jpeg", after_steps(quality_steps, n_quality, F.col("quality"))).otherwise(F.col("quality"))
    return s.select(
        *[c for c in plan.columns if c != "state"],
        "state",
        shown.alias("shown"),
        quality.cast("int").alias("actual_quality"),
        after_steps(width_steps, n_width, current).cast("int").alias("actual_width"),
    )


def _rungs(plan: DataFrame) -> DataFrame:
    """``plan`` with the steps that each view can take (_qs, _ws), the states after which it takes them (_q_from, _w_from)
    and the first in which it is omitted (_omitted, STATES if never)."""
    ends = [sum(_RUNGS[: i + 1]) for i in range(len(_RUNGS))]
    omitted = F.when((F.col("format") != "metadata") & ~F.col("required"), F.lit(ends[2])).otherwise(F.lit(STATES))
    return plan.withColumns(
        {
            "_current": F.coalesce("width_policy", "frame_width"),
            "_qs": F.when(F.col("format") == "jpeg", steps_below(QUALITY_LADDER, F.col("quality"), F.col("min_quality"))).otherwise(F.array().cast("array<int>")),
            "_q_from": F.when(F.col("is_newest"), ends[2]).otherwise(0), "_w_from": F.when(F.col("is_newest"), ends[3]).otherwise(ends[0]),
            "_omitted": omitted,
        }
    ).withColumn("_ws", steps_below(WIDTH_LADDER, F.col("_current"), F.col("min_width")))


def ladder_ends(plan: DataFrame) -> DataFrame:
    """Each view once, with open_until, the first state in which it shows nothing that a step could still lower, and
    changed_from, the first in which it isn't as planned (STATES: none): both hold in all states from there on."""
    n_quality, n_width = F.size("_qs"), F.size("_ws")
    last = F.greatest(F.when(n_quality > 0, F.col("_q_from") + n_quality).otherwise(0), F.when(n_width > 0, F.col("_w_from") + n_width).otherwise(0))
    first = F.least(F.when(n_quality > 0, F.col("_q_from") + 1), F.when(n_width > 0, F.col("_w_from") + 1), F.col("_omitted"))
    open_until = F.when(F.col("format") != "metadata", F.least(last, F.col("_omitted"))).otherwise(0)
    return _rungs(plan).select(*plan.columns, open_until.alias("open_until"), first.alias("changed_from"))


def exhaustion(plan: DataFrame, *keys: str) -> DataFrame:
    """keys, state, exhausted (every older view that is shown is at its floor) and newest_degraded (a newest view isn't as
    planned), a row a state: from one row a view, as either holds from some state on."""
    older, newest = F.when(~F.col("is_newest"), F.col("open_until")), F.when(F.col("is_newest"), F.col("changed_from"))
    ends = ladder_ends(plan).groupBy(*keys).agg(F.coalesce(F.max(older), F.lit(0)).alias("_spent"), F.coalesce(F.min(newest), F.lit(STATES)).alias("_changed"))
    s = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(STATES - 1))).alias("state"))
    return s.select(*keys, "state", (F.col("state") >= F.col("_spent")).alias("exhausted"), (F.col("state") >= F.col("_changed")).alias("newest_degraded"))


def view_steps(plan: DataFrame) -> DataFrame:
    """Each view once for each of its settings: from_state, to_state (the first in which it has others), shown,
    actual_quality, actual_width. The same as ladder_states, without a row for states in which nothing changes."""
    p = _rungs(plan)
    starts = F.expr(
        """array_sort(array_distinct(concat(array(0), transform(_qs, (v, i) -> _q_from + i + 1),
            transform(_ws, (v, i) -> _w_from + i + 1), if(_omitted < %d, array(_omitted), array()))))""" % STATES
    )
    p = p.withColumn("_starts", starts)
    at = p.select("*", F.posexplode("_starts").alias("_i", "from_state"))
    done = lambda first, steps: F.greatest(F.lit(0), F.least(F.col("from_state") - F.col(first), F.size(steps)))
    return at.select(
        *plan.columns,
        "from_state",
        F.coalesce(F.get("_starts", F.col("_i") + 1), F.lit(STATES)).alias("to_state"),
        ((F.col("format") != "metadata") & (F.col("from_state") < F.col("_omitted"))).alias("shown"),
        after_steps(F.col("_qs"), done("_q_from", "_qs"), F.col("quality")).cast("int").alias("actual_quality"),
        after_steps(F.col("_ws"), done("_w_from", "_ws"), F.col("_current")).cast("int").alias("actual_width"),
    )


def state_bytes(steps: DataFrame, size: Column, *keys: str) -> DataFrame:
    """keys and bytes: the size of each plan in every state, from its views' steps: partial sums, one shuffle at most."""
    s = steps.select(*keys, "from_state", "to_state", F.when(F.col("shown"), size).otherwise(0).cast("long").alias("_size"))
    within = lambda k: (F.col("from_state") <= k) & (F.col("to_state") > k)
    return _summed(s, [F.when(within(k), F.col("_size")) for k in range(STATES)], *keys)


def _summed(rows: DataFrame, sizes: list[Column], *keys: str, **also: Column) -> DataFrame:
    """keys, bytes (the sum of each of ``sizes``, 0 without any), and the aggregates ``also``."""
    sums = rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{k}") for k, c in enumerate(sizes)], *[v.alias(k) for k, v in also.items()])
    return sums.select(*keys, *also, F.array(*[F.col(f"_{k}") for k in range(len(sizes))]).alias("bytes"))


def fit_plans(sizes: DataFrame, budget: Column, *keys: str) -> DataFrame:
    """keys, fit (exact, adjusted, payload_budget_exceeded), state, actual_bytes, least_bytes, from ``state_bytes``."""
    first = F.array_position(F.transform("bytes", lambda b: b <= budget), True) - 1
    state = F.when(first >= 0, first).cast("int")
    r = sizes.select(*keys, "bytes", state.alias("state"), F.array_min("bytes").alias("least_bytes"))
    fit = F.when(F.col("state") == 0, "exact").when(F.col("state") > 0, "adjusted").otherwise("payload_budget_exceeded")
    return r.select(*keys, fit.alias("fit"), "state", F.get("bytes", F.col("state")).alias("actual_bytes"), "least_bytes")


#: What decides an image, besides the content of its frame.
SETTING = ("crop_x", "crop_y", "crop_w", "crop_h", "to_width", "to_height", "format", "image_quality")


def with_setting(steps: DataFrame) -> DataFrame:
    """Steps with the columns of SETTING: crop, size and quality of the image, each from its own row."""
    whole = F.col("w") == 0
    w, h = F.when(whole, F.col("frame_width")).otherwise(F.col("w")), F.when(whole, F.col("frame_height")).otherwise(F.col("h"))
    to_width = F.when(F.col("width_policy").isNull() & (F.col("actual_width") == F.col("frame_width")), w).otherwise(F.col("actual_width"))
    to_height = F.greatest(F.lit(1), F.round(h * to_width / w))
    named = {"crop_x": F.col("x"), "crop_y": F.col("y"), "crop_w": w, "crop_h": h, "to_width": to_width, "to_height": to_height}
    named = {c: v.cast("int") for c, v in named.items()}
    return steps.withColumns(named | {"image_quality": F.when(F.col("format") == "jpeg", F.col("actual_quality")).otherwise(0).cast("int")})


def images_of(settings: DataFrame, frames: DataFrame, effort: str = "default") -> DataFrame:
    """content, SETTING and data (the encoded image) of each distinct setting, encoded once.

    settings: content and SETTING, repeated as they may be. frames: content, width, height, data, a row a content. The
    kernel crops, resamples and encodes each row by its own numbers, and says how long each stage took.
    """
    keys = ["content", *SETTING]
    one = settings.select(*keys).distinct().join(frames.select("content", "width", F.col("data").alias("pixels")), "content")

    def run(batches):
        import time

        for b in batches:
            rows = b.to_pylist()
            made, took = [], []
            for r in rows:
                t = [time.perf_counter()]
                rgb = kernels.pixels(r["pixels"], r["width"])
                rgb = rgb[r["crop_y"] : r["crop_y"] + r["crop_h"], r["crop_x"] : r["crop_x"] + r["crop_w"]]
                t.append(time.perf_counter())
                rgb = kernels.resize(np.ascontiguousarray(rgb), r["to_width"], r["to_height"])
                t.append(time.perf_counter())
                made.append(codec.encode_jpeg(rgb, r["image_quality"]) if r["format"] == "jpeg" else codec.encode_png(rgb, effort))
                t.append(time.perf_counter())
                took.append([int((y - x) * 1e6) for x, y in zip(t, t[1:], strict=False)])
            times = [pa.array([t[i] for t in took], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(made, pa.binary()), *times], [*keys, "data", "crop_us", "resize_us", "encode_us"])

    kind = f"content {settings.schema['content'].dataType.simpleString()}, " + ", ".join(f"{c} {'string' if c == 'format' else 'int'}" for c in SETTING)
    spread = one.repartition("content", *SETTING)  # the work is in the encoder, not in the rows' number
    return spread.mapInArrow(run, f"{kind}, data binary, crop_us long, resize_us long, encode_us long")


def observe_stages(images: DataFrame) -> tuple[DataFrame, Observation]:
    """``images`` (of images_of), and totals of its stages that the job which reads it fills in: images, encoded_bytes and
    the microseconds that crops, resizes and encodings took in the kernel."""
    seen = Observation()
    sums = [F.coalesce(F.sum(f"{c}_us"), F.lit(0)).alias(f"{c}_us") for c in ("crop", "resize", "encode")]
    encoded = F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("encoded_bytes")
    return images.observe(seen, F.count("*").alias("images"), encoded, *sums), seen


def measured(steps: DataFrame, frames: DataFrame) -> DataFrame:
    """Steps (with content) with size: the characters of the image in base64, 0 where none is shown."""
    s = with_setting(steps)
    shown = s.filter("shown")
    images = images_of(shown, frames)
    sizes = images.select("content", *SETTING, ((F.octet_length("data") + 2) / 3).cast("long").alias("thirds"))
    j = s.join(sizes.select("content", *SETTING, (F.col("thirds") * 4).alias("size")), ["content", *SETTING], "left")
    return j.withColumn("size", F.when(F.col("shown"), F.col("size")).otherwise(0))


#: What decides a frame's views in any state, besides the policy; content stands for the pixels.
FRAME_KIND = ("content", "width", "height", "src_x", "src_y", "is_newest")


def _by_kind(frames: DataFrame, table: DataFrame, how: str, *more: str) -> DataFrame:
    """``frames`` with what ``table`` has for their FRAME_KIND and ``more``, equal nulls being equal."""
    keys = (*FRAME_KIND, *more)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    t = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    return frames.join(t, same, how).drop(*[f"_{k}" for k in keys])


def kind_bytes(frames: DataFrame, plan_of, pictures: DataFrame) -> DataFrame:
    """FRAME_KIND and bytes: what the images of a frame's views take in every state, a row a distinct kind, written.

    plan_of: gives the plan (with floors) of frames, with the columns named. pictures: see images_of.
    """
    kinds = written(frames.select(*FRAME_KIND).distinct(), "kinds")
    steps = measured(view_steps(plan_of(kinds, *FRAME_KIND)), pictures)
    return written(state_bytes(steps, F.col("size"), *FRAME_KIND), "kind-bytes")


def plan_bytes(frames: DataFrame, sizes: DataFrame, *keys: str, **also: Column) -> DataFrame:
    """keys and bytes: the size of each plan in every state, from its frames and their ``kind_bytes``."""
    j = _by_kind(frames, sizes, "left")
    return _summed(j, [F.get("bytes", F.lit(k)) for k in range(STATES)], *keys, **also)


def fitted_frames(frames: DataFrame, sizes: DataFrame, budget: Column, *keys: str) -> DataFrame:
    """frame_index, frame_id and FRAME_KIND of the frames of all plans that fit, with fit, state and ALIKE: a plan's few
    frames are kept beside its sums, so that they aren't joined to them.

    ALIKE: a digest of each frame's kind and state, the newest first. Plans that show the same have the same, and plans
    with the same newest frames follow each other in its order.
    """
    own = F.collect_list(F.struct("frame_index", "frame_id", *FRAME_KIND))
    fits = fit_plans(plan_bytes(frames, sizes, *keys, _frames=own), budget, *keys, "_frames")
    shows = F.transform(F.reverse(F.array_sort("_frames")), lambda f: F.xxhash64(*[f[k] for k in FRAME_KIND], F.col("state")))
    return fits.filter("state is not null").select(*keys, "fit", "state", shows.alias(ALIKE), F.inline("_frames"))


def kind_views(frames: DataFrame, plan_of, pictures: DataFrame) -> DataFrame:
    """A row a view of each distinct FRAME_KIND and state of ``frames``: its settings, its map to the source, its image,
    and n_frames, how many frames show it.

    A view that isn't shown has no image; its identity stays. plan_of: see kind_bytes.
    """
    kinds = written(frames.groupBy(*FRAME_KIND, "state").agg(F.count("*").alias("n_frames")), "kinds")
    s = with_setting(ladder_states(plan_of(kinds, *FRAME_KIND, "state", "n_frames"), F.col("state")))
    images = images_of(s.filter("shown"), pictures).select("content", *SETTING, "data")
    t = G.transform(G.rect(F.col("src_x") + F.col("crop_x"), F.col("src_y") + F.col("crop_y"), F.col("crop_w"), F.col("crop_h")), F.col("to_width"), F.col("to_height"))
    j = s.join(images, ["content", *SETTING], "left").withColumn("data", F.when(F.col("shown"), F.col("data")))
    shape = [F.when(F.col("shown"), F.col(c)).alias(n) for c, n in (("to_width", "image_width"), ("to_height", "image_height"))]
    return j.select(
        *FRAME_KIND, "state", "n_frames", "view", "kind_rank", "required", "shown", "format", "crop_x", "crop_y", "crop_w", "crop_h",
        *shape, F.when(F.col("format") == "jpeg", F.col("actual_quality")).alias("quality"),
        *[t[c].alias(c) for c in ("offset_x", "offset_y", "scale_x", "scale_y")], "data",
    )


def present(frames: DataFrame, views: DataFrame, *keys: str) -> DataFrame:
    """``frames`` (FRAME_KIND, state, with keys ALIKE too) with what ``views`` has for their kind and state: rows of views, or frames'.

    A small table of views is broadcast, so that no image is shuffled for each frame that shows it; else frames go to their
    kinds, and their images to where they are gathered. keys: by what they will be gathered; frames are then dealt out before
    they have images, into as many parts as hold GATHERED_BYTES each, so that gathering a part needn't spill. Parts are ranges
    of ALIKE, so that what shows the same lies together, and of keys, so that any number of equal ones is dealt out too.
    Frames that aren't dealt out lose ALIKE.
    """
    made = written(views, "views")
    shown = made.drop("n_frames")
    few = made.limit(BROADCAST_KINDS + 1).count() <= BROADCAST_KINDS
    if few:
        size = F.octet_length(F.to_json(F.struct(*shown.columns)))  # the files may be far smaller than their rows
        total = made.agg(F.coalesce(F.sum(size), F.lit(0)).alias("table"), F.coalesce(F.sum(size * F.col("n_frames")), F.lit(0)).alias("gathered")).first()
        few = total.table <= BROADCAST_BYTES
    if few and keys:
        frames = frames.repartitionByRange(max(1, -(-total.gathered // GATHERED_BYTES)), ALIKE, *keys)
    else:
        frames = frames.drop(ALIKE)
    return _by_kind(frames, F.broadcast(shown) if few else shown, "inner", "state")


def frame_views(views: DataFrame, images: bool = True) -> DataFrame:
    """FRAME_KIND, state, n_frames, totals and text: ``kind_views`` nested, in order, as what follows a frame's ids in JSON. So
    text is made once a kind, not for each frame that shows it. images: with each image in base64 and its bytes."""
    shape = ["view", "required", "shown", "format", "quality", "image_width", "image_height"]
    source = F.struct(F.col("crop_x").alias("x"), F.col("crop_y").alias("y"), F.col("crop_w").alias("width"), F.col("crop_h").alias("height"))
    to_source = F.struct("offset_x", "offset_y", "scale_x", "scale_y")
    parts = ["kind_rank", *shape, source.alias("source"), to_source.alias("transform")]
    if images:
        parts += [F.octet_length("data").cast("long").alias("bytes"), F.base64("data").alias("base64")]
    nested = views.groupBy(*FRAME_KIND, "state", "n_frames").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*parts))), lambda v: v.dropFields("kind_rank")).alias("views"),
        F.count(F.when(F.col("shown"), 1)).alias("images"),
        *([F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes")] if images else []),
    )
    total = ["images", *(["bytes"] if images else [])]
    return nested.select(*FRAME_KIND, "state", "n_frames", *total, _rest_of_json("views", *total).alias("text"))


def _rest_of_json(*columns: str) -> Column:
    """The fields of a JSON object after others, and its end."""
    return F.substr(F.to_json(F.struct(*columns)), F.lit(2))


def documents(frames: DataFrame, *keys: str, images: bool = True) -> DataFrame:
    """keys and document: frames with their ``frame_views`` nested in order, with totals of each frame and of all.

    A stack has few frames of few views, so a document is a row. Documents repeat their images, which codecs of files only
    see within some tens of KB: those of frames dealt out by ALIKE come in its order.
    """
    total = ["images", *(["bytes"] if images else [])]
    ids = F.to_json(F.struct("frame_index", "frame_id"))
    frame = F.struct("frame_index", F.substr(ids, F.lit(1), F.length(ids) - 1).alias("ids"), "text")
    by = [*([ALIKE] if ALIKE in frames.columns else []), *keys]
    all_ = frames.groupBy(*by).agg(F.array_sort(F.collect_list(frame)).alias("frames"), *[F.sum(c).alias(c) for c in total])
    texts = F.array_join(F.transform("frames", lambda f: F.concat(f["ids"], F.lit(","), f["text"])), ",")
    docs = all_.select(*by, F.concat(F.lit('{"frames":['), texts, F.lit("],"), _rest_of_json(*total)).alias("document"))
    return docs.sortWithinPartitions(*by).drop(ALIKE) if ALIKE in by else docs


def changed_region(comparisons: DataFrame, keys: list[str], padding: int, max_fraction: float, bounds: Column) -> DataFrame:
    """raw and returned rectangle of each comparison's box: padded, or the whole frame when it is too large a part.

    Null where nothing changed; the comparison's verdict isn't asked.
    """
    raw = G.rect(F.col("bbox_x"), F.col("bbox_y"), F.col("bbox_w"), F.col("bbox_h"))
    there = F.col("bbox_x").isNotNull()
    back = there & (G.area(raw) / G.area(bounds) > max_fraction)
    padded = G.pad_clamp(raw, F.lit(padding), bounds)
    out = lambda k: F.when(back, bounds[k]).when(there, padded[k]).cast("long")
    return comparisons.select(
        *keys, back.alias("fell_back"), *[out(k).alias(f"returned_{k}") for k in ("x", "y", "width", "height")]
    )


def duplicate_names(regions: DataFrame, policy: str) -> DataFrame:
    return regions.groupBy(policy, "name").agg(F.count("*").alias("n")).filter("n > 1")
