"""A table in a folder that is replaced whole: readers see the old version or the new one, never a part of either.

Each write makes a version in a folder of its own; one rename of a small manifest publishes it. A write that fails leaves
the manifest, and with it the old version, as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError

_MANIFEST = "_current"


def _hadoop(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    return fs, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the published version; none before the first."""
    fs, system = _hadoop(spark, path)
    manifest = fs.Path(path, _MANIFEST)
    if not system.exists(manifest):
        return None
    opened = system.open(manifest)
    try:
        return f"{path}/{opened.readUTF()}"
    finally:
        opened.close()


def write_version(df: DataFrame, path: str, keep: int = 1) -> str:
    """Writes ``df`` as the new version of the table at ``path`` and publishes it; its folder.

    keep: earlier versions that stay for readers that have begun. A failed write removes what it wrote and raises
    output_failed.
    """
    spark = df.sparkSession
    fs, system = _hadoop(spark, path)
    before = current_version(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    made, draft = fs.Path(path, name), fs.Path(path, f"_{name}")
    try:
        df.write.parquet(f"{path}/{name}")
        out = system.create(draft, True)
        out.writeUTF(name)
        out.close()
        rename = fs.Options.Rename
        how = spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        fs.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, fs.Path(path, _MANIFEST), how)
    except Exception as e:
        for at in (made, draft):
            system.delete(at, True)
        raise EngineError("output_failed", f"{path} stays as it was: {type(e).__name__}") from e
    old = [s for s in system.listStatus(fs.Path(path)) if s.getPath().getName().startswith("v-")]
    old = sorted((s for s in old if s.getPath().getName() != name), key=lambda s: (f"{path}/{s.getPath().getName()}" == before, s.getModificationTime()))
    for s in old[: max(0, len(old) - keep)]:
        system.delete(s.getPath(), True)
    return f"{path}/{name}"


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The published version of the table at ``path``."""
    at = current_version(spark, path)
    if at is None:
        raise EngineError("image_load_failed", f"{path} has no version")
    return spark.read.parquet(at)
