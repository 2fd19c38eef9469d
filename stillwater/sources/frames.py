"""Frames from tables and formulas.

Layout P: a row a pixel (session_id, frame_id, x, y, r, g, b). Layout L: a row a scanline (session_id, frame_id,
y, r, g, b as arrays), which joins on lines instead of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

#: Width and height of the frames made from embeddings.
SIDE = 8


def assign_frame_ids(df: DataFrame, session: str, *order: str) -> DataFrame:
    """frame_id 1, 2, 3 ... by session, in capture order; never reused."""
    ids = F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long")
    return df.withColumn("frame_id", ids)


def _channels(v: Column) -> list[Column]:
    return [v.alias("r"), ((v * 3) % 256).alias("g"), ((v + 91) % 256).alias("b")]


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, frame_id, v: the 64 values of an 8 x 8 frame, one frame an embedding, one session a label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("session_id"), "vec_id", "embedding")
    e = assign_frame_ids(e, "session_id", "vec_id")
    v = F.transform("embedding", lambda x: (F.floor(x.cast("double") * 128) + 128).cast("int"))
    return e.select("session_id", "frame_id", v.alias("v"))


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout P of embedding_frames."""
    p = embedding_frames(spark, sf_dir).select("session_id", "frame_id", F.posexplode("v").alias("pos", "v"))
    y = F.floor(F.col("pos") / SIDE).cast("int")
    return p.select("session_id", "frame_id", (F.col("pos") % SIDE).alias("x"), y.alias("y"), *_channels(F.col("v")))


def embedding_scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout L of embedding_frames."""
    lines = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda y: F.slice("v", y * SIDE + 1, F.lit(SIDE)))
    p = embedding_frames(spark, sf_dir).select("session_id", "frame_id", F.posexplode(lines).alias("y", "r"))
    return p.select(
        "session_id",
        "frame_id",
        "y",
        "r",
        F.transform("r", lambda v: (v * 3) % 256).alias("g"),
        F.transform("r", lambda v: (v + 91) % 256).alias("b"),
    )


def lineitem_pixels(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """Layout P of one session of monthly frames: x from suppliers, y from parts, channels from sums.

    The grid is dense: pixels without lines are black.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        (F.col("l_suppkey") % side).cast("int").alias("x"),
        (F.col("l_partkey") % side).cast("int").alias("y"),
        F.col("l_quantity").cast("long").alias("q"),
    )
    cells = li.groupBy("month", "x", "y").agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    months = assign_frame_ids(cells.select("month").distinct().withColumn("session_id", F.lit(1).cast("long")), "session_id", "month")
    span = F.sequence(F.lit(0), F.lit(side - 1))
    grid = months.select("*", F.explode(span).alias("x")).select("*", F.explode(span).alias("y"))
    full = grid.join(cells, ["month", "x", "y"], "left")
    q, n = F.coalesce("q", F.lit(0)), F.coalesce("n", F.lit(0))
    return full.select(
        "session_id",
        "frame_id",
        "x",
        "y",
        (q % 256).cast("int").alias("r"),
        ((n * 37) % 256).cast("int").alias("g"),
        ((q * 7 + n) % 256).cast("int").alias("b"),
    )


def to_scanlines(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Layout L of layout P: each line's channels in order of x."""
    line = F.array_sort(F.collect_list(F.struct("x", "r", "g", "b")))
    rows = pixels.groupBy(*keys, "y").agg(line.alias("line"))
    return rows.select(*keys, "y", *[F.col(f"line.{c}").alias(c) for c in "rgb"])


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, event_type, at_us, duration_us: one session a user, in order of time and event."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        "event_id",
        "ts",
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp_ltz")).alias("at_us"),
        F.round(F.col("value") * 1000).cast("long").alias("duration_us"),
    )
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id")).cast("long"))
    return e.select("session_id", "seq", "event_type", "at_us", "duration_us")


def texture(spark: SparkSession, width: int, height: int, seeds: list[int]) -> DataFrame:
    """Layout P of frames 1, 2 ... with n = ((7x + 13y) mod 256) xor seed and channels n, 3n, n + 91 mod 256."""
    pixels = spark.range(width * height).select(
        (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y")
    )
    frames = F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("frame_id"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)]))
    n = ((F.col("x") * 7 + F.col("y") * 13) % 256).bitwiseXOR(F.col("f.seed"))
    return pixels.select("*", frames.alias("f")).select(
        F.lit(1).cast("long").alias("session_id"), "f.frame_id", "x", "y", *_channels(n)
    )


def scripted_samples(frames: DataFrame, samples: int) -> DataFrame:
    """session_id, i, frame_id: sample i plays frame i + 1, the last frame again and again when they run out."""
    last = frames.groupBy("session_id").agg(F.max("frame_id").alias("last"))
    i = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i")
    return last.select("session_id", "last", i).select(
        "session_id", F.col("i").cast("long").alias("i"), F.least(F.col("i") + 1, "last").cast("long").alias("frame_id")
    )
