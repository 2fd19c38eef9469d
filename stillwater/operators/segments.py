"""Scans over sessions of any length: hot sessions are cut into ranges of their order, and what a range needs of those
before it comes from a summary a range.

A session with more rows than a task's share is cut at approximate quantiles, so every window sorts a share of rows at
most, but for rows of one instant, which stay together. Sessions that are cut, and ranges, are bounded by twice the
number of shuffle partitions; so are the broadcasts of splitters and carries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: Rows of a session up to which it is never cut.
LEAST_ROWS = 100_000

_SEGMENT = "_segment"


def placed(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with its place in the whole order, from 1: ranges of the order, and how many rows those before hold.

    The ranges are written to the shared folder once, so that counts and places come from the same ones.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/placed-{uuid.uuid4().hex}"
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part, before, offsets = F.shiftright("_row", 33), 0, []
    for p, n in sorted(rows.groupBy(part.alias("p")).count().collect()):  # a row a range
        offsets.append((p, before))
        before += n
    counts = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    place = F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1) + 1
    return rows.withColumn("_part", part).join(counts, "_part").withColumn(name, place).drop("_part", "_before", "_row")


class Scan:
    """Ordered scans of ``df`` by session. order: the columns of the order, the first a number or a time."""

    def __init__(self, df: DataFrame, session: str, *order: str):
        self.session, self.order = session, order
        spark, tasks = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counts = df.groupBy(session).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        share = max(LEAST_ROWS, -(-total // tasks))
        hot = counts.filter(F.col("n") > share)  # total / share sessions at most
        ranges = F.greatest(F.lit(2), F.least(F.lit(2 * tasks), F.ceil(F.col("n") / share) * 2))
        self.hot = {r[session]: int(r["k"]) for r in hot.select(session, ranges.alias("k")).collect()} if total > share else {}
        self._hot = None
        if not self.hot:
            self.rows = df.withColumn(_SEGMENT, F.lit(0))
            return
        most = max(self.hot.values())
        at = [i / most for i in range(1, most)]
        kind = df.schema[session].dataType.simpleString()
        self._hot = F.broadcast(spark.createDataFrame([(s,) for s in self.hot], f"_hot {kind}"))
        cuts = self._of_hot(df).groupBy(session).agg(F.percentile_approx(order[0], at, 10_000).alias("cuts"))
        thinned = []
        for r in cuts.collect():
            k = self.hot[r[session]]
            thinned.append((r[session], sorted({r["cuts"][i * most // k - 1] for i in range(1, k) if i * most // k >= 1})))
        schema = f"_hot {kind}, _cuts array<{df.schema[order[0]].dataType.simpleString()}>"
        edges = F.broadcast(spark.createDataFrame(thinned, schema))
        j = df.join(edges, df[session].eqNullSafe(edges["_hot"]), "left")
        below = F.size(F.filter("_cuts", lambda c: c < F.col(order[0])))
        self.rows = j.withColumn(_SEGMENT, F.when(F.col("_cuts").isNotNull(), below).otherwise(0)).drop("_hot", "_cuts")

    def _of_hot(self, df: DataFrame) -> DataFrame:
        return df.join(self._hot, df[self.session].eqNullSafe(self._hot["_hot"])).drop("_hot")

    @property
    def window(self):
        """Within a range."""
        return Window.partitionBy(self.session, _SEGMENT).orderBy(*self.order)

    def with_carry(self, summary: dict[str, Column], carry) -> DataFrame:
        """``rows`` with, by range, what ``carry`` (a window over a session's ranges before: columns) makes of the
        ranges' ``summary`` (aggregates by name); null in a session's first range."""
        names = list(carry(Window.partitionBy(self.session)))
        if not self.hot:
            kinds = self.rows.groupBy(self.session, _SEGMENT).agg(*[v.alias(k) for k, v in summary.items()])
            types = kinds.select(*[c.alias(k) for k, c in carry(self._before()).items()]).schema
            return self.rows.withColumns({k: F.lit(None).cast(types[k].dataType) for k in names})
        by = self._of_hot(self.rows).groupBy(self.session, _SEGMENT).agg(*[v.alias(k) for k, v in summary.items()])
        by = by.select(F.col(self.session).alias("_s"), F.col(_SEGMENT).alias("_g"), *[c.alias(k) for k, c in carry(self._before()).items()])
        by = F.broadcast(by)  # a row a range of a hot session
        rows = self.rows
        return rows.join(by, rows[self.session].eqNullSafe(by["_s"]) & (rows[_SEGMENT] == by["_g"]), "left").drop("_s", "_g")

    def _before(self):
        return Window.partitionBy(self.session).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)

    def numbered(self, name: str = "frame_id") -> DataFrame:
        """``df`` with 1, 2, 3 ... by session, in order."""
        rows = self.with_carry({"_n": F.count("*")}, lambda w: {"_c": F.sum("_n").over(w)})
        local = F.row_number().over(self.window).cast("long")
        return rows.withColumn(name, local + F.coalesce("_c", F.lit(0))).drop("_c", _SEGMENT)

    def neighbours(self, value: str, before: str, first: str) -> DataFrame:
        """``df`` with the value of the row before (null for the first) and of the session's first row."""
        order = F.struct(*self.order)
        summary = {"_last": F.max_by(value, order), "_first": F.min_by(value, order)}
        rows = self.with_carry(summary, lambda w: {"_b": F.last("_last").over(w), "_f": F.first("_first").over(w)})
        edge = F.row_number().over(self.window) == 1
        return rows.withColumns(
            {
                before: F.when(edge, F.col("_b")).otherwise(F.lag(value).over(self.window)),
                first: F.coalesce("_f", F.first(value).over(self.window)),
            }
        ).drop("_b", "_f", _SEGMENT)

    def running_max(self, value: Column, name: str) -> DataFrame:
        """``df`` with the largest value so far, nulls left out."""
        self.rows = self.rows.withColumn("_v", value)
        rows = self.with_carry({"_m": F.max("_v")}, lambda w: {"_b": F.max("_m").over(w)})
        local = F.max("_v").over(self.window.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(name, F.greatest(local, F.col("_b"))).drop("_v", "_b", _SEGMENT)
