"""Box resampling: each target pixel is the mean of the source pixels its span touches, along x, then along y."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


def source_span(i: str, source: int, target: int) -> tuple[str, str]:
    """SQL of the span [start, end) of target index ``i``: unweighted, at least one pixel."""
    start = f"least(cast(floor({i} * ({source}D / {target}D)) as int), {source - 1})"
    end = f"least(greatest(cast(ceil(({i} + 1) * ({source}D / {target}D)) as int), {start} + 1), {source})"
    return start, end


def _mean(values: str) -> str:
    """Mean in 32-bit floats, added up in order."""
    total = f"aggregate({values}, cast(0 as float), (a, v) -> cast(a + v as float))"
    return f"cast({total} / cast(size({values}) as float) as float)"


def resize_box(lines: DataFrame, keys: list[str], width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Layout L resized; the source geometry stays. Equal sizes return the lines as they are."""
    if to_width <= 0 or to_height <= 0:
        raise EngineError("resize_failed", f"{to_width}x{to_height} is empty")
    if (width, height) == (to_width, to_height):
        return lines
    start, end = source_span("x", width, to_width)
    across = lines.select(
        *keys,
        "y",
        *[
            F.expr(
                f"transform(sequence(0, {to_width - 1}), x -> {_mean(f'slice({c}, {start} + 1, {end} - {start})')})"
            ).alias(c)
            for c in "rgb"
        ],
    )
    start, end = source_span("t", height, to_height)
    touched = F.expr(f"filter(sequence(0, {to_height - 1}), t -> y >= {start} and y < {end})")
    # lines of one target line: as many as the ratio of heights
    down = across.select(*keys, F.explode(touched).alias("t"), "y", "r", "g", "b").groupBy(*keys, "t").agg(
        F.array_sort(F.collect_list(F.struct("y", "r", "g", "b"))).alias("at")
    )
    values = lambda c: F.expr(
        f"transform(sequence(0, {to_width - 1}), x -> cast(least(greatest(round("
        f"{_mean(f'transform(at, l -> l.{c}[x])')}), 0), 255) as int))"
    ).alias(c)
    return down.select(*keys, F.col("t").alias("y"), *[values(c) for c in "rgb"])


def to_pixels(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Layout P of layout L."""
    cells = lines.select(*keys, "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "c"))
    return cells.select(*keys, "x", "y", "c.r", "c.g", "c.b")
