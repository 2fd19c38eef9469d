"""Comparison and resampling of frames at full size, over bytes.

Lines of equal bytes are never opened: a digest, then the bytes, tell so in the JVM. The others go to one Arrow kernel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import kernels as K
from ..sources.strips import to_strips
from .compare import CompareOptions, finish


def changes(options: CompareOptions):
    """Arrow kernel: changed pixels and box of pairs of strips; null pairs are equal ones, which it doesn't see."""
    threshold = options.effective_threshold

    @F.pandas_udf("changed long, x0 int, x1 int, y0 int, y1 int")
    def run(before: pd.Series, after: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(after), 5), np.int64)
        for i, (a, b, w) in enumerate(zip(before, after, width, strict=True)):
            if b is not None and (found := K.changes(K.pixels(a, w), K.pixels(b, w), threshold)):
                out[i] = found
        made = pd.DataFrame(out, columns=["changed", "x0", "x1", "y0", "y1"])
        return made.astype({c: "int32" for c in ("x0", "x1", "y0", "y1")})

    return run


def compare_pairs(pairs: DataFrame, keys: list[str], options: CompareOptions) -> DataFrame:
    """Comparisons from strips: keys, y, width, before, after (BINARY of equal length). Strips of one frame may differ in
    their lines; a strip whose sides differ in length raises incompatible_frames."""
    size = F.octet_length("after")
    wrong = F.raise_error(F.lit(str(EngineError("incompatible_frames", "strips of other sizes are compared"))))
    same = (F.xxhash64("before") == F.xxhash64("after")) & (F.col("before") == F.col("after"))
    open_ = F.when(F.octet_length("before") != size, wrong.cast("boolean")).otherwise(~same)
    p = pairs.select(*keys, "y", "width", (size / 3).cast("long").alias("n"), open_.alias("open"), "before", "after")
    pick = lambda c: F.when(F.col("open"), F.col(c))
    seen = p.select(*keys, "y", "n", changes(options)(pick("before"), pick("after"), F.col("width")).alias("c"))
    hit = F.col("c.changed") > 0
    agg = seen.groupBy(*keys).agg(
        F.sum("c.changed").alias("changed_pixels"),
        F.sum("n").alias("total_pixels"),
        F.min(F.when(hit, F.col("c.x0"))).alias("x0"),
        F.max(F.when(hit, F.col("c.x1"))).alias("x1"),
        F.min(F.when(hit, F.col("y") + F.col("c.y0"))).alias("y0"),
        F.max(F.when(hit, F.col("y") + F.col("c.y1"))).alias("y1"),
    )
    return finish(agg, keys, options)


def _in_order(strips: DataFrame, earlier) -> DataFrame:
    w = Window.partitionBy("session_id", "y").orderBy("frame_id")
    return strips.select(
        "session_id", "frame_id", "y", "width", earlier(F.col("data"), w).alias("before"), F.col("data").alias("after"), earlier(F.col("frame_id"), w).alias("earlier_id")
    )


def compare_consecutive(strips: DataFrame, options: CompareOptions) -> DataFrame:
    """compare.compare_consecutive over layout S: one shuffle by session and strip."""
    pairs = _in_order(strips, lambda c, w: F.lag(c).over(w)).filter("earlier_id = frame_id - 1")
    return compare_pairs(pairs, ["session_id", "frame_id"], options)


def compare_to_baseline(strips: DataFrame, options: CompareOptions) -> DataFrame:
    """compare.compare_to_baseline over layout S."""
    pairs = _in_order(strips, lambda c, w: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return compare_pairs(pairs.filter("earlier_id = 1 AND frame_id > 1"), ["session_id", "frame_id"], options)


def whole_frames(strips: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, data of each frame from its strips."""
    data = F.expr("listagg(data) WITHIN GROUP (ORDER BY y)").alias("data")
    rows = strips.groupBy(*keys).agg(F.max("width").alias("width"), data)
    return rows.select(*keys, "width", (F.octet_length("data") / (3 * F.col("width"))).cast("int").alias("height"), "data")


def packed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, data of each frame of layout L."""
    return whole_frames(to_strips(lines, tuple(keys)), keys)


def resize_frames(frames: DataFrame, keys: list[str], to_width: str = "to_width", to_height: str = "to_height") -> DataFrame:
    """Frames (keys, width, height, data) resampled to the sizes that their own rows name; sizes of 0 are refused."""
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys)
    refused = str(EngineError("resize_failed", "an empty size"))

    def run(batches):
        for b in batches:
            data, wide, high = [], b.column(to_width).to_pylist(), b.column(to_height).to_pylist()
            for k, (w, tw, th) in enumerate(zip(b.column("width").to_pylist(), wide, high, strict=True)):
                if tw <= 0 or th <= 0:
                    raise ValueError(refused)
                data.append(K.resize(K.pixels(b.column("data")[k].as_py(), w), tw, th).tobytes())
            sides = [pa.array(v, pa.int32()) for v in (wide, high)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *sides, pa.array(data, pa.binary())], [*keys, "width", "height", "data"])

    return frames.select(*keys, "width", "height", "data", to_width, to_height).mapInArrow(run, f"{kinds}, width int, height int, data binary")
