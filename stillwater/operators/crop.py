"""Cropping and geometry checks of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError


def crop_pixels(pixels: DataFrame, x: int, y: int, width: int, height: int, frame_width: int, frame_height: int) -> DataFrame:
    """A rectangle of each frame in its own coordinates; it must lie inside, and is never clipped."""
    if width <= 0 or height <= 0 or x < 0 or y < 0 or x + width > frame_width or y + height > frame_height:
        raise EngineError("invalid_region", f"{width}x{height}+{x}+{y} is not inside {frame_width}x{frame_height}")
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.filter(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def crop_scanlines(lines: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """crop_pixels over layout L: lines are filtered and sliced."""
    rows = lines.filter(F.col("y").between(y, y + height - 1)).withColumn("y", F.col("y") - y)
    return rows.withColumns({c: F.slice(c, x + 1, width) for c in "rgb"})


def geometry_consistent(frames: DataFrame) -> DataFrame:
    """session_id, frame_id, status: geometry_changed where size, then origin, differ from the session's first frame."""
    w = Window.partitionBy("session_id").orderBy("frame_id")
    first = {c: F.first(c).over(w) for c in ("width", "height", "src_x", "src_y")}
    size = (F.col("width") != first["width"]) | (F.col("height") != first["height"])
    origin = (F.col("src_x") != first["src_x"]) | (F.col("src_y") != first["src_y"])
    status = F.when(size, "geometry_changed (size)").when(origin, "geometry_changed (origin)").otherwise("ok")
    return frames.select("session_id", "frame_id", status.alias("status"))
