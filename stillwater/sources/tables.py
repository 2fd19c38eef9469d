"""Tables of a data directory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which a cluster has to set; ours where Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (base or "/tmp/checkpoints").rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder once: later plans read it, and know how large it is."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
