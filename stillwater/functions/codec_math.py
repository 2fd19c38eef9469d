"""Arithmetic of image coding, as columns: colour conversion, quantisation and the 8 x 8 transform."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The standard luminance and chrominance quantisation tables, row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

#: Places of the 64 coefficients in coding order: diagonals of the block, up and down in turn.
ZIGZAG = [
    y * 8 + x
    for s in range(15)
    for x, y in sorted(
        ((x, s - x) for x in range(8) if 0 <= s - x < 8), key=lambda p: p[0] if s % 2 == 0 else p[1]
    )
]


def normalise(channels: Column, c1: Column, c2: Column, c3: Column) -> Column:
    """struct(r, g, b) of stored samples: grey, with or without alpha, is repeated; colour is stored b, g, r; alpha is
    dropped, never blended."""
    grey = channels <= 2
    return F.struct(
        F.when(grey, c1).otherwise(c3).alias("r"), F.when(grey, c1).otherwise(c2).alias("g"), c1.alias("b")
    )


def _clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def ycbcr(r: Column, g: Column, b: Column) -> Column:
    """struct(y, cb, cr) in integers; shifts round towards minus infinity."""
    return F.struct(
        _clamp(F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)).alias("y"),
        _clamp(F.shiftright(-43 * r - 85 * g + 128 * b + 128, 8) + 128).alias("cb"),
        _clamp(F.shiftright(128 * r - 107 * g - 21 * b + 128, 8) + 128).alias("cr"),
    )


def quant_value(base: Column, quality: Column) -> Column:
    """A table entry at a quality of 1 to 100."""
    scale = F.when(quality < 50, F.floor(5000 / quality)).otherwise(200 - 2 * quality)
    return _clamp(F.floor((base * scale + 50) / 100), 1, 255).cast("int")


def quantised(coefficient: Column, step: Column) -> Column:
    return _clamp(F.round(coefficient / step), -1023, 1023).cast("int")


def dct(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, w, c: the orthonormal transform of 64 level-shifted values ``v``; u counts along rows."""
    wave = lambda k, x: f"cos((2 * {x} + 1) * {k} * {math.pi!r}D / 16)"
    scale = lambda k: f"if({k} = 0, {math.sqrt(0.5)!r}D, 1D)"
    term = f"v[p] * {wave('u', '(p % 8)')} * {wave('w', '(p div 8)')}"
    grid = blocks.select(*keys, "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("u"))
    grid = grid.select(*keys, "v", "u", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("w"))
    total = F.expr(f"aggregate(sequence(0, 63), 0D, (a, p) -> a + {term}) * 0.25D * {scale('u')} * {scale('w')}")
    return grid.select(*keys, "u", "w", total.alias("c"))
