"""Exact deduplication by content sort.

Sampled splitters range-partition the rows by (first normalised bytes, digest of all, salt), keys of bounded
size whatever the texts' length; each partition is sorted externally, which puts equal contents side by side;
one pass compares each row with its neighbour in full.
The salt lets a group of copies of any size span as many partitions as it fills: only the first and the
last run of a partition can continue elsewhere, and those (two a partition at most) are joined up in
partition order, again by full comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

_RUNS = (
    "doc_id long, keep_id long, keep_cp long, group_size long, first boolean, text_sha256 string, "
    "pid int, edge int, edge_norm string"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("keep_id", pa.int64()),
        ("keep_cp", pa.int64()),
        ("group_size", pa.int64()),
        ("first", pa.bool_()),
        ("text_sha256", pa.string()),
        ("pid", pa.int32()),
        ("edge", pa.int32()),
        ("edge_norm", pa.string()),
    ]
)
_FLUSH = 8192
#: Characters of the normalised text that splitters hold.
HEAD = 128


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal contents of a sorted partition. edge: 1 for the first run, 2 the last, 3 both, 0 others."""
    pid = TaskContext.get().partitionId()
    out: list[list] = [[] for _ in _ARROW]
    norm, digest, ids, cp, seen = None, None, [], 0, 0

    def close(last: bool) -> None:
        edge = (1 if seen == 1 else 0) + (2 if last else 0)
        n = len(ids)
        for column, values in zip(
            out,
            (
                ids,
                [ids[0]] * n,
                [cp] * n,
                [n] * n,
                [True] + [False] * (n - 1),
                [digest] * n,
                [pid] * n,
                [edge] * n,
                [norm if edge else None] + [None] * (n - 1),
            ),
        ):
            column.extend(values)

    def emit() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _ARROW)], schema=_ARROW)
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in ("norm", "digest", "cp", "doc_id")))
        for text, sha256, length, doc_id in rows:
            if text != norm:
                if seen:
                    close(False)
                    if len(out[0]) >= _FLUSH:
                        yield emit()
                norm, digest, ids, cp, seen = text, sha256, [], length, seen + 1
            ids.append(doc_id)
    if seen:
        close(True)
        yield emit()


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space ``[\\x20\\x09-\\x0D]``. Of equal texts the row
    with the most code points in the original stays, then the smallest id.

    Null text: as the empty text. Null id: an id after all others; the row is kept only if no other ties.
    Repeated rows: each is a row of its own, one of them can be kept. Empty table: no rows. Other columns
    are neither read nor returned, so their names can't clash.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("__text")).select(
        "doc_id",
        F.char_length("__text").cast("long").alias("cp"),
        F.translate("__text", " \t\n\x0b\x0c\r", "").alias("norm"),
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("salt"),
    )
    rows = rows.withColumns({"head": F.substring("norm", 1, HEAD), "digest": F.sha2(F.encode("norm", "UTF-8"), 256)})
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "head", "digest", "salt").drop("salt")
    ordered = ranged.sortWithinPartitions("head", "digest", "norm", F.desc("cp"), F.asc_nulls_last("doc_id"))
    runs = written(ordered.mapInArrow(_runs, _RUNS), "runs")

    order = Window.orderBy("pid", "edge")  # over two rows a partition at most, without their texts
    slim = runs.filter(F.col("edge_norm").isNotNull()).select(
        "pid",
        "edge",
        "keep_id",
        "keep_cp",
        "group_size",
        F.lag("pid").over(order).alias("b_pid"),
        F.lag("edge").over(order).alias("b_edge"),
        (F.lag("text_sha256").over(order) == F.col("text_sha256")).alias("alike"),
    )
    # the texts are compared in full where their digests agree
    texts = runs.filter(F.col("edge_norm").isNotNull()).select("pid", "edge", "edge_norm")
    before = texts.select(F.col("pid").alias("b_pid"), F.col("edge").alias("b_edge"), F.col("edge_norm").alias("b_norm"))
    same = slim.filter("alike").select("pid", "edge", "b_pid", "b_edge").join(texts, ["pid", "edge"])
    same = same.join(before, ["b_pid", "b_edge"]).filter(F.col("edge_norm") == F.col("b_norm"))
    same = written(same.select("pid", "edge", F.lit(0).alias("same")), "same")
    ends = slim.join(same, ["pid", "edge"], "left").withColumn("fresh", F.coalesce("same", F.lit(1)))
    ends = ends.withColumn("group", F.sum("fresh").over(order))
    group = Window.partitionBy("group")
    best = F.min(F.struct(-F.col("keep_cp"), F.col("keep_id").isNull(), "keep_id", "pid", "edge")).over(group)
    # two rows a partition at most, so they can be broadcast
    ends = ends.select(
        F.col("pid").alias("e_pid"),
        F.col("edge").alias("e_edge"),
        F.sum("group_size").over(group).alias("e_size"),
        best["keep_id"].alias("e_keep"),
        ((best["pid"] == F.col("pid")) & (best["edge"] == F.col("edge"))).alias("e_wins"),
    )
    joined = runs.join(
        F.broadcast(ends), (F.col("pid") == F.col("e_pid")) & (F.col("edge") == F.col("e_edge")), "left"
    )
    at_edge = F.col("e_pid").isNotNull()
    return joined.select(
        "doc_id",
        F.when(at_edge, F.col("e_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(at_edge, F.col("e_size")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("first") & F.coalesce("e_wins", F.lit(True))).alias("kept"),
        "text_sha256",
    )
