"""Tables that are replaced whole."""

import os

import pytest
from pyspark.sql import functions as F

from stillwater.errors import EngineError
from stillwater.sources.versioned import current_version, read_version, write_version


def folders(path):
    return sorted(f for f in os.listdir(path) if f.startswith("v-"))


def test_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(EngineError):
        read_version(spark, path)
    first = write_version(spark.range(10), path)
    assert current_version(spark, path) == first and read_version(spark, path).count() == 10
    begun = read_version(spark, path)
    second = write_version(spark.range(20), path)
    assert second != first and read_version(spark, path).count() == 20
    assert begun.count() == 10  # a reader that has begun goes on
    write_version(spark.range(30), path)
    assert len(folders(path)) == 2 and read_version(spark, path).count() == 30


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    write_version(spark.range(10), path)
    before = folders(path)
    late = spark.range(0, 4_000, 1, 4).withColumn("x", F.when(F.col("id") == 3_999, F.raise_error(F.lit("broken"))).otherwise(F.lit("y")))
    with pytest.raises(EngineError, match="stays as it was"):
        write_version(late, path)
    assert folders(path) == before and read_version(spark, path).count() == 10
    assert not [f for f in os.listdir(path) if f.startswith("_v-")]
