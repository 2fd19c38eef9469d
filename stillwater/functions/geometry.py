"""Rectangles and coordinate maps, as columns. A rectangle is a struct (x, y, width, height); its edges and
areas are computed in BIGINT so none can overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def rect_new(x: Column, y: Column, width: Column, height: Column) -> Column:
    """The rectangle, or null when it is empty."""
    return F.when((width > 0) & (height > 0), rect(x, y, width, height))


def right(r: Column) -> Column:
    return r["x"].cast("long") + r["width"].cast("long")


def bottom(r: Column) -> Column:
    return r["y"].cast("long") + r["height"].cast("long")


def area(r: Column) -> Column:
    return r["width"].cast("long") * r["height"].cast("long")


def is_empty(r: Column) -> Column:
    return (r["width"] == 0) | (r["height"] == 0)


def within(r: Column, bounds: Column) -> Column:
    """Whether r lies in bounds entirely, edges included."""
    return (
        (r["x"] >= bounds["x"]) & (r["y"] >= bounds["y"]) & (right(r) <= right(bounds)) & (bottom(r) <= bottom(bounds))
    )


def intersect(a: Column, b: Column) -> Column:
    """The common rectangle, or null when there is none."""
    x, y = F.greatest(a["x"], b["x"]).cast("long"), F.greatest(a["y"], b["y"]).cast("long")
    width, height = F.least(right(a), right(b)) - x, F.least(bottom(a), bottom(b)) - y
    return F.when((width > 0) & (height > 0), rect(x, y, width, height))


def pad_clamp(r: Column, padding: Column, bounds: Column) -> Column:
    """r grown on all sides, kept in bounds, at least one pixel large."""
    x = F.greatest(r["x"] - padding, bounds["x"]).cast("long")
    y = F.greatest(r["y"] - padding, bounds["y"]).cast("long")
    width = F.least(right(r) + padding, right(bounds)) - x
    height = F.least(bottom(r) + padding, bottom(bounds)) - y
    return rect(x, y, F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1)))


def to_local(r: Column, origin_x: Column, origin_y: Column) -> Column:
    return rect(r["x"] - origin_x, r["y"] - origin_y, r["width"], r["height"])


def to_source(r: Column, origin_x: Column, origin_y: Column) -> Column:
    return rect(r["x"] + origin_x, r["y"] + origin_y, r["width"], r["height"])


def transform(source: Column, image_width: Column, image_height: Column) -> Column:
    """Where an image of a source rectangle lies: origin, offsets, source pixels an image pixel."""
    return F.struct(
        F.lit("top-left").alias("origin"),
        source["x"].alias("offset_x"),
        source["y"].alias("offset_y"),
        (source["width"].cast("double") / image_width.cast("double")).alias("scale_x"),
        (source["height"].cast("double") / image_height.cast("double")).alias("scale_y"),
    )


def image_to_source(t: Column, x: Column, y: Column) -> Column:
    return F.struct(
        F.round(t["offset_x"].cast("double") + x.cast("double") * t["scale_x"]).cast("long").alias("x"),
        F.round(t["offset_y"].cast("double") + y.cast("double") * t["scale_y"]).cast("long").alias("y"),
    )


def source_to_image(t: Column, x: Column, y: Column) -> Column:
    return F.struct(
        F.round((x - t["offset_x"]).cast("double") / t["scale_x"]).cast("long").alias("x"),
        F.round((y - t["offset_y"]).cast("double") / t["scale_y"]).cast("long").alias("y"),
    )


def _at_least_one(size: Column) -> Column:
    return F.greatest(F.round(size).cast("long"), F.lit(1))


def _scaled(size: Column, factor: Column) -> Column:
    return _at_least_one(size.cast("double") * factor)


def dims_for_width(width: Column, height: Column, target: Column) -> Column:
    other = height.cast("double") * target / width
    return F.struct(target.cast("long").alias("width"), _at_least_one(other).alias("height"))


def dims_for_height(width: Column, height: Column, target: Column) -> Column:
    other = width.cast("double") * target / height
    return F.struct(_at_least_one(other).alias("width"), target.cast("long").alias("height"))


def dims_for_scale(width: Column, height: Column, factor: Column) -> Column:
    return F.struct(_scaled(width, factor).alias("width"), _scaled(height, factor).alias("height"))


def effective_width(width: Column, height: Column, kind: Column, value: Column) -> Column:
    """The width a view would have under a resize policy (none, width, height, scale)."""
    by_height = F.floor(width * value / F.greatest(height, F.lit(1)))
    return (
        F.when(kind == "width", value.cast("long"))
        .when(kind == "height", F.greatest(by_height, F.lit(1)).cast("long"))
        .when(kind == "scale", _scaled(width, value))
        .otherwise(width.cast("long"))
    )


def age(now: Column, captured_at: Column) -> Column:
    return F.greatest(now - captured_at, F.lit(0))


def byte_len(width: Column, height: Column) -> Column:
    return width.cast("long") * height.cast("long") * 3
