"""From frames to images: crop, resize, encode, base64 and the map back to the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codec, parsing
from ..functions import geometry as G
from .crop import crop_scanlines
from .resample import resize_box
from .strips import packed


def prepare_image(
    lines: DataFrame,
    keys: list[str],
    size: tuple[int, int],
    crop: tuple[int, int, int, int] | None = None,
    resize: tuple[int, int] | None = None,
    image_format: str = "png",
    quality: int = 80,
    effort: str = "default",
    origin: tuple[int, int] = (0, 0),
) -> DataFrame:
    """Layout L frames as images: keys, format, bytes, data, base64, and the transform (offset and scale).

    The selective steps come first: cropped lines are sliced before they are resized, resized before encoded.
    The format metadata yields no image.
    """
    x, y, width, height = crop or (0, 0, *size)
    if crop:
        lines = crop_scanlines(lines, x, y, width, height)
    to_width, to_height = resize or (width, height)
    rows = resize_box(lines, keys, width, height, to_width, to_height)
    images = packed(rows, keys).withColumns(
        {"format": F.lit(image_format), "quality": F.lit(quality), "effort": F.lit(effort)}
    )
    made = codec.encode(images, keys)
    t = G.transform(
        G.rect(*[F.lit(v) for v in (origin[0] + x, origin[1] + y, width, height)]), F.lit(to_width), F.lit(to_height)
    )
    return made.select(
        *keys,
        "format",
        F.octet_length("data").cast("long").alias("bytes"),
        "data",
        parsing.base64_line(F.col("data")).alias("base64"),
        *[t[c].alias(c) for c in ("offset_x", "offset_y", "scale_x", "scale_y")],
    )
