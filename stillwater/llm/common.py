"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and normalisation rule here, as a regular expression class.
SPACE = r"\x20\x09-\x0D"
#: A word: a longest run of anything else.
WORD = rf"[^{SPACE}]+"


#: A way to remove each folder that this process has made, and, by thread, their order.
_removers: dict[str, object] = {}
_own = threading.local()


def shared_dir(spark: SparkSession, leave: bool = False) -> str:
    """A new folder, as a full URI, in the one all executors see: spark.checkpoint.dir, or ours where it is unset.

    On a cluster that setting is required. What operators write there belongs to one run: see ``forget``. A folder that
    a result points to is left there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if base.startswith("file:/") and not base.startswith("file://"):
        base = base.replace("file:/", "file:///", 1)
    made = f"{base}/stillwater-{uuid.uuid4().hex}"
    if leave:
        return made
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        at = jvm.org.apache.hadoop.fs.Path(made)
        at.getFileSystem(conf).delete(at, True)

    _removers[made] = remove
    _own.__dict__.setdefault("made", []).append(made)
    return made


def marked() -> int:
    """The folders that this thread has made so far, to forget later ones."""
    return len(_own.__dict__.get("made", []))


def forget(since: int = 0) -> None:
    """Removes the folders that this thread made after ``since`` (of ``marked``), once nothing reads them any more."""
    made = _own.__dict__.get("made", [])
    while len(made) > since:
        _removers.pop(made.pop())()


@atexit.register
def _at_exit() -> None:
    """Removes the folders of all threads."""
    with contextlib.suppress(Exception):  # the gateway may be gone
        for remove in _removers.values():
            remove()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and reread: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df``, whatever their names hold, less those of the names ``without`` in any case."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in without]


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as no column of ``df`` has, in any case."""
    lead = "__"
    taken = {c.lower() for c in df.columns}
    while any(f"{lead}{n}".lower() in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """16 bytes that stand for a row's id and whole text, null apart from anything else."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver has, whose number a parameter bounds."""
    return spark.createDataFrame(rows, schema)


def slices(batches, rows: int = 1_000):
    """The rows of Arrow batches, so many at a time: bounds what a task holds as Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def by_bytes(batches, column: str, most: int):
    """The rows of Arrow batches, as many at a time as hold about ``most`` bytes of a text column, one at least."""
    for batch in batches:
        offsets = np.asarray(pc.fill_null(pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0)), 0))
        low, held = 0, 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(offsets, held + most, "right")))
            yield batch.slice(low, high - low)
            low, held = high, int(offsets[high - 1])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text):
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")
