"""Pixels in regions: regions go to the tiles they meet, pixels to theirs, and only what meets in a tile is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile in pixels; (region, tile) rows up to which they are broadcast, about 100 bytes each.
TILE, BROADCAST_TILES = 64, 200_000


def tiles_of(regions: DataFrame, tile: int) -> DataFrame:
    """A row a region (rx, ry, rw, rh and any others) and tile that it meets; empty regions meet none."""
    span = lambda at, size: f"sequence(cast(floor({at} / {tile}) as int), cast(floor(({at} + {size} - 1) / {tile}) as int))"
    r = regions.filter("rw > 0 AND rh > 0").withColumn("_tx", F.explode(F.expr(span("rx", "rw"))))
    return r.withColumn("_ty", F.explode(F.expr(span("ry", "rh"))))


def pixels_in(pixels: DataFrame, regions: DataFrame, tile: int = TILE) -> DataFrame:
    """Each pixel (x, y and any others) with each region that it lies in: an equi-join by tile, then the exact test.

    The index is broadcast if it has been counted and is small; else both sides are shuffled by tile.
    """
    index = tiles_of(regions, tile)
    if index.limit(BROADCAST_TILES + 1).count() <= BROADCAST_TILES:
        index = F.broadcast(index)
    p = pixels.withColumns({"_tx": F.floor(F.col("x") / tile).cast("int"), "_ty": F.floor(F.col("y") / tile).cast("int")})
    inside = "x >= rx AND x < rx + rw AND y >= ry AND y < ry + rh"
    return p.join(index, ["_tx", "_ty"]).filter(inside).drop("_tx", "_ty")
