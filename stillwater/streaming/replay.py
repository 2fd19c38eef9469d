"""A batch Python data source that plays a formula's frames, in the place of a display."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Frames(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.frames, self.width, self.height = (int(options.get(k, d)) for k, d in (("frames", 4), ("width", 16), ("height", 12)))

    def partitions(self):
        step = max(1, self.frames // 8)
        return [_Frames(i, min(i + step, self.frames)) for i in range(0, self.frames, step)]

    def read(self, partition):
        for i in range(partition.first, partition.last):
            seed = 40 * i % 256
            for y in range(self.height):
                line = [((7 * x + 13 * y) % 256) ^ seed for x in range(self.width)]
                yield 1, i + 1, y, line, [n * 3 % 256 for n in line], [(n + 91) % 256 for n in line]


class ReplaySource(DataSource):
    """spark.read.format("replay"): scanlines (layout L) of textured frames; options frames, width, height."""

    @classmethod
    def name(cls):
        return "replay"

    def schema(self):
        return "session_id long, frame_id long, y int, r array<int>, g array<int>, b array<int>"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplaySource)
