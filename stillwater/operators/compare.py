"""Exact frame comparison: counts, fraction and bounding box of changed pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError


@dataclass(frozen=True)
class CompareOptions:
    """A pixel changed if any channel differs (exact) or by more than pixel_threshold (rgb, strict); a frame changed
    if a pixel did and the changed fraction reaches area_threshold (inclusive)."""

    mode: str = "exact"
    pixel_threshold: int = 0
    area_threshold: float = 0.0

    def __post_init__(self):
        if self.mode not in ("exact", "rgb"):
            raise EngineError("invalid_arguments", f"{self.mode!r} is not a comparison mode")
        if not 0 <= self.pixel_threshold <= 255:
            raise EngineError("invalid_arguments", "the pixel threshold is between 0 and 255")
        if not 0.0 <= self.area_threshold <= 1.0:
            raise EngineError("invalid_arguments", "the area threshold is between 0.0 and 1.0")

    @property
    def effective_threshold(self) -> int:
        """Exact mode reports 0."""
        return 0 if self.mode == "exact" else self.pixel_threshold


#: Defaults of temporal operators.
TEMPORAL = CompareOptions("rgb", 12, 0.005)


def effective_threshold(mode: Column, threshold: Column) -> Column:
    """The pixel threshold that a comparison reports: 0 in exact mode."""
    return F.when(mode == "exact", 0).otherwise(threshold)


def pixel_changed(options: CompareOptions, before: str = "before", after: str = "after") -> Column:
    """Whether a pixel changed between the structs (r, g, b) ``before`` and ``after``."""
    pairs = [(F.col(f"{before}.{c}"), F.col(f"{after}.{c}")) for c in "rgb"]
    if options.effective_threshold == 0:
        return (pairs[0][0] != pairs[0][1]) | (pairs[1][0] != pairs[1][1]) | (pairs[2][0] != pairs[2][1])
    return F.greatest(*[F.abs(a - b) for a, b in pairs]) > options.pixel_threshold


def finish(agg: DataFrame, keys: list[str], options: CompareOptions) -> DataFrame:
    """The output row from changed_pixels, total_pixels and the edges of the box."""
    fraction = F.col("changed_pixels") / F.col("total_pixels")
    return agg.select(
        *keys,
        F.lit(options.mode).alias("mode"),
        F.lit(options.effective_threshold).alias("pixel_threshold"),
        F.lit(float(options.area_threshold)).alias("area_threshold"),
        ((F.col("changed_pixels") > 0) & (fraction >= options.area_threshold)).alias("changed"),
        "changed_pixels",
        "total_pixels",
        fraction.alias("changed_fraction"),
        F.col("x0").alias("bbox_x"),
        F.col("y0").alias("bbox_y"),
        (F.col("x1") - F.col("x0") + 1).alias("bbox_w"),
        (F.col("y1") - F.col("y0") + 1).alias("bbox_h"),
    )


def compare_pixels(before: DataFrame, after: DataFrame, keys: list[str], options: CompareOptions) -> DataFrame:
    """Comparison of two frames for each value of ``keys``, which both sides have with x, y, r, g, b."""
    pack = F.struct("r", "g", "b")
    pairs = before.select(*keys, "x", "y", pack.alias("before")).join(
        after.select(*keys, "x", "y", pack.alias("after")), [*keys, "x", "y"]
    )
    return _pixel_pairs(pairs, keys, options)


def _pixel_pairs(pairs: DataFrame, keys: list[str], options: CompareOptions) -> DataFrame:
    """Comparisons from the structs before and after of each place."""
    hit = F.when(pixel_changed(options), True)
    agg = pairs.groupBy(*keys).agg(
        F.count(hit).alias("changed_pixels"),
        F.count("*").alias("total_pixels"),
        F.min(F.when(hit, F.col("x"))).alias("x0"),
        F.max(F.when(hit, F.col("x"))).alias("x1"),
        F.min(F.when(hit, F.col("y"))).alias("y0"),
        F.max(F.when(hit, F.col("y"))).alias("y1"),
    )
    return finish(agg, keys, options)


def compare_scanlines(before: DataFrame, after: DataFrame, keys: list[str], options: CompareOptions) -> DataFrame:
    """compare_pixels over layout L: one row a line is joined, each line is reduced where it stands."""
    pairs = before.select(*keys, "y", *[F.col(c).alias(f"{c}1") for c in "rgb"]).join(
        after.select(*keys, "y", *[F.col(c).alias(f"{c}2") for c in "rgb"]), [*keys, "y"]
    )
    return _line_pairs(pairs, keys, options)


def _line_pairs(pairs: DataFrame, keys: list[str], options: CompareOptions) -> DataFrame:
    """Comparisons from the channels r1 to b1 and r2 to b2 of each line."""
    t = options.effective_threshold
    lines = F.expr(
        f"""transform(sequence(0, size(r1) - 1), i -> if(greatest(abs(r1[i] - r2[i]), abs(g1[i] - g2[i]),
            abs(b1[i] - b2[i])) > {t}, i, null))"""
    )
    rows = pairs.select(*keys, "y", F.size("r1").alias("width"), F.filter(lines, lambda i: i.isNotNull()).alias("at"))
    hit = F.size("at") > 0
    agg = rows.groupBy(*keys).agg(
        F.sum(F.size("at")).alias("changed_pixels"),
        F.sum("width").alias("total_pixels"),
        F.min(F.when(hit, F.col("at")[0])).alias("x0"),
        F.max(F.when(hit, F.element_at("at", -1))).alias("x1"),
        F.min(F.when(hit, F.col("y"))).alias("y0"),
        F.max(F.when(hit, F.col("y"))).alias("y1"),
    )
    return finish(agg, keys, options)


def with_previous(frames: DataFrame, session: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """(before, after): each frame after the first, keyed by its id, and the one before it under the same id."""
    before = frames.withColumn("frame_id", F.col("frame_id") + 1)
    return before, frames


def _in_order(frames: DataFrame, layout: str, earlier) -> DataFrame:
    """Places of frames with what ``earlier`` (a column, a window: a column) tells of the same place, as pairs: one shuffle
    by session and place, in which a frame of any size is spread over its lines or pixels."""
    position = ["x", "y"] if layout == "pixels" else ["y"]
    w = Window.partitionBy("session_id", *position).orderBy("frame_id")
    keys = ["session_id", "frame_id", *position]
    if layout == "pixels":
        both = [earlier(F.struct("r", "g", "b"), w).alias("before"), F.struct("r", "g", "b").alias("after")]
    else:
        both = [f(c) for c in "rgb" for f in (lambda c: earlier(F.col(c), w).alias(f"{c}1"), lambda c: F.col(c).alias(f"{c}2"))]
    return frames.select(*keys, *both, earlier(F.col("frame_id"), w).alias("earlier_id"))


def consecutive_pixels(frames: DataFrame) -> DataFrame:
    """session_id, frame_id, x, y, before, after: pixels of layout P with those of the frame before."""
    return _in_order(frames, "pixels", lambda c, w: F.lag(c).over(w)).filter("earlier_id = frame_id - 1")


def compare_consecutive(frames: DataFrame, options: CompareOptions, layout: str = "pixels") -> DataFrame:
    """Each frame of a session against the one before it; places that either lacks don't count."""
    pairs = _in_order(frames, layout, lambda c, w: F.lag(c).over(w)).filter("earlier_id = frame_id - 1")
    return (_pixel_pairs if layout == "pixels" else _line_pairs)(pairs, ["session_id", "frame_id"], options)


def compare_to_baseline(frames: DataFrame, options: CompareOptions, layout: str = "pixels") -> DataFrame:
    """Each later frame of a session against its first; places that either lacks don't count."""
    pairs = _in_order(frames, layout, lambda c, w: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pairs = pairs.filter("earlier_id = 1 AND frame_id > 1")
    return (_pixel_pairs if layout == "pixels" else _line_pairs)(pairs, ["session_id", "frame_id"], options)


def session_diff(frames: DataFrame, pairs: DataFrame, options: CompareOptions) -> DataFrame:
    """Two frames of each session: pairs has session_id, before_id, after_id."""
    keys = ["session_id", "before_id", "after_id"]
    pick = lambda c: pairs.withColumn("frame_id", F.col(c)).join(frames, ["session_id", "frame_id"]).drop("frame_id")
    before, after = pick("before_id"), pick("after_id")
    return compare_pixels(before, after, keys, options)


def compatible(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: incompatible_frames where width or height differ; frames are never overlapped or resized."""
    joined = a.select(*keys, F.col("width").alias("w1"), F.col("height").alias("h1")).join(
        b.select(*keys, F.col("width").alias("w2"), F.col("height").alias("h2")), keys
    )
    same = (F.col("w1") == F.col("w2")) & (F.col("h1") == F.col("h2"))
    return joined.select(*keys, F.when(same, "ok").otherwise("incompatible_frames").alias("status"))


def diff_summary(c: DataFrame, keys: list[str]) -> DataFrame:
    """One line of text a comparison."""
    text = F.when(
        F.col("bbox_x").isNull(),
        F.format_string("%s: no pixels changed (%d compared)", "mode", "total_pixels"),
    ).otherwise(
        F.format_string(
            "%s: %d/%d pixels changed (%.4f%%%s), changed region %dx%d+%d+%d",
            "mode",
            "changed_pixels",
            "total_pixels",
            F.col("changed_fraction") * 100.0,
            F.when(F.col("changed"), "").otherwise(", below area threshold"),
            "bbox_w",
            "bbox_h",
            "bbox_x",
            "bbox_y",
        )
    )
    return c.select(*keys, text.alias("summary"))


def project_transition(c: DataFrame, keys: list[str]) -> DataFrame:
    """The five columns of a comparison that a transition reports."""
    return c.select(*keys, "changed", "changed_pixels", "total_pixels", "changed_fraction", "bbox_x", "bbox_y", "bbox_w", "bbox_h")


def initial_comparison(keys: list[str], frames: DataFrame, options: CompareOptions) -> DataFrame:
    """A frame with itself, so that a result always exists: nothing changed."""
    agg = frames.groupBy(*keys).agg(
        F.lit(0).cast("long").alias("changed_pixels"), F.count("*").alias("total_pixels"),
        *[F.lit(None).cast("int").alias(c) for c in ("x0", "x1", "y0", "y1")],
    )
    return finish(agg, keys, options)
