"""Layout S: a row a strip of lines (session_id, frame_id, y of its first line, width, data BINARY of interleaved RGB)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

#: Bytes of a strip, about: large enough to move at once, small enough to spread a frame over tasks.
STRIP_BYTES = 128 << 10


def lines_a_strip(width: int) -> int:
    return max(1, STRIP_BYTES // (3 * width))


def to_strips(lines: DataFrame, keys: tuple[str, ...] = ("session_id", "frame_id")) -> DataFrame:
    """Layout S of layout L, a line a strip: bytes are built where the line stands."""
    names = [*keys, "y", "width", "data"]
    at = len(keys)

    def pack(batches):
        for b in batches:
            channels = [b.column(at + i) for i in (1, 2, 3)]
            offsets = channels[0].offsets.to_numpy()
            flat = np.stack([c.flatten().to_numpy().astype(np.uint8) for c in channels], 1).reshape(-1)
            ends = (3 * (offsets - offsets[0])).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            width = pa.array(np.diff(offsets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: at + 1], width, data], names)

    kinds = "".join(f"{k} {lines.schema[k].dataType.simpleString()}, " for k in keys)
    rows = lines.select(*keys, F.col("y").cast("int"), *[F.col(c).cast("array<int>") for c in "rgb"])
    return rows.mapInArrow(pack, f"{kinds}y int, width int, data binary")


def texture_strips(frames: DataFrame, width: int, height: int, change: Column | None = None) -> DataFrame:
    """Strips of textured frames (session_id, frame_id, seed), each strip made where its row stands.

    change: which kind of change the frame has over its texture: none, sparse (a block of a fortieth of either side) or
    widespread (a checkerboard of 8 pixels in black).
    """
    step = lines_a_strip(width)
    rows = frames.withColumn("change", F.lit("none") if change is None else change)
    rows = rows.select("session_id", "frame_id", "seed", "change", F.explode(F.sequence(F.lit(0), F.lit(height - 1), F.lit(step))).alias("y"))

    def make(batches):
        for b in batches:
            data = []
            for seed, what, y in zip(*(b.column(c).to_pylist() for c in ("seed", "change", "y")), strict=True):
                n = min(step, height - y)
                v = ((7 * np.arange(width) + 13 * (y + np.arange(n))[:, None]) % 256 ^ seed).astype(np.uint8)
                rgb = np.stack([v, v * np.uint8(3), v + np.uint8(91)], 2)
                if what == "sparse":
                    rgb[max(0, height // 3 - y) : max(0, height // 3 + height // 40 - y), width // 3 : width // 3 + width // 40] = 255
                elif what == "widespread":
                    odd = (np.arange(width) // 8 + (y + np.arange(n))[:, None] // 8) % 2 == 1
                    rgb[odd] = 0
                data.append(rgb.tobytes())
            full = [b.column("session_id"), b.column("frame_id"), b.column("y"), pa.array([width] * b.num_rows, pa.int32()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(full, ["session_id", "frame_id", "y", "width", "data"])

    # few rows an Arrow batch: each stands for many bytes
    return rows.mapInArrow(make, f"session_id {frames.schema['session_id'].dataType.simpleString()}, frame_id long, y int, width int, data binary")


def texture_frames(seeds: DataFrame, width: int, height: int) -> DataFrame:
    """content, width, height, data of whole textured frames: seeds has content and seed."""
    def make(batches):
        for b in batches:
            data = [K.texture(width, height, s).tobytes() for s in b.column("seed").to_pylist()]
            sides = [pa.array([v] * b.num_rows, pa.int32()) for v in (width, height)]
            yield pa.RecordBatch.from_arrays([b.column("content"), *sides, pa.array(data, pa.binary())], ["content", "width", "height", "data"])

    return seeds.select("content", "seed").mapInArrow(make, "content long, width int, height int, data binary")
