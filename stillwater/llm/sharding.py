"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring; a key belongs to the next point clockwise. A shard takes its own
keys, in ring order, up to its capacity; keys that find it full continue clockwise to the next shard with
room. Only counts of (arc, cell) go to the driver, a number that shards, points and cells bound: it plans
which rank interval of each cell goes to which shard, and every row finds its interval by its rank.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free, utf8, written

#: Ring slots: a key's place is the top 16 bits of its hash.
SLOTS = 1 << 16
#: Points of each shard on the ring.
POINTS = 64
#: Cells into which an arc is dealt, so that an arc's ranks aren't counted in one task.
CELLS = 64
#: Rows of a cell, at least, from which it is looked at for rows that are all equal.
EQUAL = 8_192


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(slot, shard) of all points in ring order; of points on one slot the lowest shard's stays."""
    at: dict[int, int] = {}
    for shard in reversed(range(shards)):
        for p in range(points):
            at[int.from_bytes(hashlib.md5(f"{shard}/{p}".encode()).digest()[:2], "big")] = shard
    return sorted(at.items())


def capacities(n: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Rows that each shard may hold: with epsilon 0 exactly n in all, at most one apart."""
    if epsilon > 0:
        return [int((1 + epsilon) * n / shards) + 1] * shards
    return [n // shards + (1 if s < n % shards else 0) for s in range(shards)]


def plan(
    counts: dict[tuple[int, int], int], points: list[tuple[int, int]], room: list[int]
) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, cell, from rank, to rank, shard, slot of the first) for ``counts`` by (arc, cell)."""
    room, slot = list(room), [0] * len(room)
    by_arc = defaultdict(list)
    for (arc, cell), n in sorted(counts.items()):
        by_arc[arc].append((cell, n))
    out, over = [], []

    def put(arc: int, cell: int, low: int, high: int, shard: int) -> None:
        out.append((arc, cell, low, high, shard, slot[shard]))
        slot[shard] += high - low
        room[shard] -= high - low

    for arc in sorted(by_arc):
        shard = points[arc][1]
        for cell, n in by_arc[arc]:
            own = min(n, room[shard])
            if own:
                put(arc, cell, 0, own, shard)
            if own < n:
                over.append((arc, cell, own, n))
    for arc, cell, low, high in over:
        step = arc
        while low < high:
            step = (step + 1) % len(points)
            shard = points[step][1]
            if part := min(high - low, room[shard]):
                put(arc, cell, low, low + part, shard)
                low += part
            elif not any(room):
                raise ValueError("the shards' capacities are below the number of rows")
    return out


def shard_rows(
    df: DataFrame,
    shards: int = 24,
    points: int = POINTS,
    epsilon: float = 0.0,
    id_col: str = "doc_id",
    carry: list[str] | None = None,
) -> DataFrame:
    """``carry`` columns (all by default) with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0).

    With epsilon 0 counts of rows are at most one apart. Null keys hash alike and spread clockwise once
    their shard is full, as do repeated rows; which of fully equal rows gets which place is left open.
    Rows are ordered by key and content, whatever partitions they come in. Empty table: no rows. Columns named
    shard or slot, in any case, are replaced; all others keep their names and values.
    """
    spark = df.sparkSession
    given = [c for c in carry or df.columns if c.lower() not in ("shard", "slot")]
    kept = columns(df, tuple(c.lower() for c in df.columns if c not in given))
    at, arc, key, tie, cell, rid, rank, low, high, first = free(
        df, "at", "arc", "key", "tie", "cell", "rid", "rank", "low", "high", "first"
    )
    points_at = ring(shards, points)
    ends = [slot for slot, _ in points_at]
    starts, arcs = [0, *(e + 1 for e in ends)], [*range(len(ends)), 0]  # past the last point comes the first
    stretches = pa.table({arc: pa.array(arcs, pa.int32()), low: pa.array(starts, pa.int32()), high: pa.array([*ends, SLOTS - 1], pa.int32())})
    arc_of = spark.createDataFrame(stretches).filter(F.col(low) <= F.col(high))
    arc_of = arc_of.select(arc, F.explode(F.sequence(low, high)).alias(at))  # a row for each slot of the ring
    hashed = F.xxhash64(F.col("`" + id_col.replace("`", "``") + "`"))
    # maps have no hash of their own
    contents = [F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c
                for c, (name, kind) in zip(columns(df), df.dtypes) if name in given]
    rows = df.select(
        *kept,
        F.shiftrightunsigned(hashed, 48).cast("int").alias(at),
        hashed.alias(key),
        F.xxhash64(*contents).alias(tie),
        F.monotonically_increasing_id().alias(rid),
    )
    rows = rows.join(F.broadcast(arc_of), at).withColumn(cell, F.pmod(F.xxhash64(key, tie), F.lit(CELLS)).cast("int"))
    rows = written(rows, "ring")  # read once, for the counts and the ranks alike
    # a row for each cell
    counted = lambda rows: {(a, c): n for a, c, n in zip(*(x.to_pylist() for x in rows.groupBy(arc, cell).count().toArrow().columns))}
    counts = counted(rows)
    # equal rows that fill a cell are dealt to cells of their own: any of them can have any of their places
    usual = max(EQUAL, 2 * sum(counts.values()) // (len(points_at) * CELLS))
    if full := [c for c, n in counts.items() if n > usual]:
        crowded = pa.table({arc: pa.array([a for a, _ in full], pa.int32()), cell: pa.array([c for _, c in full], pa.int32())})
        inside = rows.select(arc, cell, key, tie).join(F.broadcast(spark.createDataFrame(crowded)), [arc, cell])
        equal = written(inside.groupBy(key, tie).count().filter(F.col("count") > usual // 2).drop("count"), "equal")
        [dealt] = free(rows, "dealt")
        # groups of at least a cell's usual rows, so as many as there are cells at most
        rows = rows.join(F.broadcast(equal.withColumn(dealt, F.lit(True))), [key, tie], "left")
        own = (CELLS * (1 + F.pmod(F.xxhash64(tie), F.lit(8))) + F.pmod(F.xxhash64(rid), F.lit(CELLS))).cast("int")
        rows = rows.withColumn(cell, F.when(F.col(dealt), own).otherwise(F.col(cell)))
        counts = counted(rows)
    places = plan(counts, points_at, capacities(sum(counts.values()), shards, epsilon))
    kinds = {arc: pa.int32(), cell: pa.int32(), low: pa.int64(), high: pa.int64(), "shard": pa.int32(), first: pa.int64()}
    filled = zip(*places) if places else [[]] * len(kinds)
    intervals = spark.createDataFrame(
        pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), filled)})
    )  # a row for each cell and, where it is split, each shard it goes to
    order = Window.partitionBy(arc, cell).orderBy(key, tie)
    ranked = rows.withColumn(rank, F.row_number().over(order).cast("long") - 1)
    placed = ranked.join(F.broadcast(intervals), [arc, cell]).filter(
        (F.col(rank) >= F.col(low)) & (F.col(rank) < F.col(high))
    )
    return placed.select(*kept, "shard", (F.col(first) + F.col(rank) - F.col(low)).alias("slot"))


def shard_digest(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row, under the law ``rows``.

    Null text: 8 bytes, the checksum of nothing. Other cases: see shard_rows.
    """
    raw = utf8(F.col(text_col))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 8).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    out = shard_rows(rows, shards)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
