"""Frames from image files: Spark's image source (PNG, JPEG), told apart by content, never by name."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import pixels
from ..functions.parsing import detect_format

#: Lines of an image that are spread to pixels at once.
LINES = 64


def _to_rgb(batches):
    """The image source's samples (b, g, r, then alpha, or grey alone) as interleaved RGB."""
    for b in batches:
        made = []
        for n, data in zip(b.column("channels").to_pylist(), b.column("data").to_pylist(), strict=True):
            samples = np.frombuffer(data, np.uint8).reshape(-1, n)
            made.append(np.ascontiguousarray(samples[:, [2, 1, 0] if n >= 3 else [0, 0, 0]]).tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.binary())], b.schema.names)


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, data (interleaved RGB), status of each file.

    The image source gives samples as b, g, r; grey is repeated, alpha dropped. Files of another format, or that
    can't be decoded, have status image_load_failed; Spark's readers skip files without a byte.
    """
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:///")  # noqa: E731  the two sources write it differently
    files = spark.read.format("binaryFile").load(path)
    files = files.select(plain("path").alias("path"), detect_format(F.col("content")).alias("format"))
    decoded = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    images = decoded.select(plain("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")
    images = images.mapInArrow(_to_rgb, images.schema)
    j = files.join(images, "path", "left")
    good = F.col("format").isNotNull() & F.col("data").isNotNull()
    return j.select("path", "format", "width", "height", "channels", "data", F.when(good, "ok").otherwise("image_load_failed").alias("status"))


def image_pixels(images: DataFrame) -> DataFrame:
    """Layout P of scan_images: path, x, y, r, g, b."""

    def spread(batches):
        for b in batches:
            for path, width, data in zip(*(b.column(c).to_pylist() for c in ("path", "width", "data")), strict=True):
                rgb = pixels(data, width)
                for low in range(0, len(rgb), LINES):
                    part = rgb[low : low + LINES]
                    n, flat = part.shape[0] * width, part.reshape(-1, 3).astype(np.int32)
                    y, x = np.divmod(np.arange(n, dtype=np.int32), np.int32(width))
                    columns = [pa.array([path] * n), pa.array(x), pa.array(y + np.int32(low)), *(pa.array(flat[:, k]) for k in range(3))]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "x", "y", "r", "g", "b"])

    good = images.filter("status = 'ok'").select("path", "width", "data")
    return good.mapInArrow(spread, "path string, x int, y int, r int, g int, b int")
