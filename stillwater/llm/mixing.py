"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 128-bit hash. A source's words are summed by nested prefixes of it: the first
level finds the bucket in which the budget runs out, each further level splits that one bucket, and the
last works on whole hashes. A document is then taken or not by one comparison with its source's threshold,
so the documents are never sorted, and a larger budget always takes a superset (thresholds are nested).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns, free, shuffle_partitions, written

#: Hexadecimal digits that each level of the histogram adds.
DIGITS = 3
#: Levels before the last, which works on whole hashes: 3 levels of 3 digits part a source into 2**36.
LEVELS = 3
#: Sources up to which their table is broadcast (under 200 bytes each); beyond, it is joined, each source in SALTS
#: places, so that a source that holds much of all rows is spread.
BROADCAST_SOURCES, SALTS = 20_000, 32


def source_key(source: Column) -> Column:
    """A name for each source; a null source is one like others, with a name that no other has."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank, from 0, by source, null last: counted within ranges, after the counts of those before."""
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("source"))
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "ranged")
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("range").count().collect())  # a row for each range
    before, ranges, firsts = 0, [], []
    for at, n in counts:
        ranges.append(at)
        firsts.append(before)
        before += n
    first = spark.createDataFrame(pa.table({"range": pa.array(ranges, pa.int32()), "first": pa.array(firsts, pa.int64())}))
    order = Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))
    ranged = ranged.withColumn("place", F.row_number().over(order)).join(F.broadcast(first), "range")
    return ranged.withColumn("rank", F.col("first") + F.col("place") - 1).drop("range", "first", "place")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, size).

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at
    ``most`` times its source's size and the excess is shared by weight among the rest until none is above:
    each turn is one aggregate over the table of sources. An empty table gives no rows, a source without words the
    target 0.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = _ranked(s).withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most).drop("rank")
    s = written(s, "sources")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    above, capped, rest, share = F.lit(False), -1, 0, 1
    while True:  # a turn caps one source more at least
        free_ones = F.when(~above, F.col("w"))
        got = s.agg(
            F.sum("source_size"), F.sum(F.when(above, F.col("cap"))), F.sum(free_ones), F.sum(above.cast("long")), F.count("*")
        ).first()
        if not got[4] or (got[3] or 0) == capped:
            break
        capped, rest, share = got[3] or 0, got[0] - (got[1] or 0), got[2] or 1
        above = wide("w") * F.lit(rest).cast("decimal(38,0)") > wide("cap") * F.lit(share).cast("decimal(38,0)")
    level = (F.col("w") * F.lit(rest)) / F.lit(share)
    return s.select("source", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(level).alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame, on: list[str], h: str, few: bool) -> DataFrame:
    """``rows`` (with a hash ``h``) joined to a table of sources."""
    if few:
        return rows.join(F.broadcast(sources), on)
    [salt] = free(rows, "salt")
    spread = sources.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(h), F.lit(SALTS)).cast("int")).join(spread, [*on, salt]).drop(salt)


def thresholds(hashed: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """k, source_size, target, times, cut: take each document ``times``, once more if hash <= cut.

    hashed: source, size, h. few: the sources are few enough to broadcast. The document at the edge is taken once
    more if that comes nearer the target. Where nothing is left over, cut is less than any hash.
    """
    t = targets.withColumn(
        "times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("extra", F.col("target") - F.col("times") * F.col("source_size"))
    t = t.withColumn("k", source_key(F.col("source")))
    rows = hashed.select(source_key(F.col("source")).alias("k"), "size", "h")
    edge = t.filter("extra > 0").select("k", "extra", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 2):
        last = level == LEVELS + 1
        n = DIGITS * (level - 1)
        part = F.col("h") if last else F.substring("h", 1, n + DIGITS)
        inside = _with_sources(rows.withColumn("prefix", F.substring("h", 1, n)), edge, ["k", "prefix"], "h", few)
        inside = inside.select("k", part.alias("prefix"), "size", "extra", "before")
        sums = inside.groupBy("k", "prefix", "extra", "before").agg(F.sum("size").alias("size"))
        order = Window.partitionBy("k").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        crossed = (F.col("before") <= F.col("extra")) & (F.col("before") + F.col("size") > F.col("extra"))
        if not last:
            edge = written(sums.filter(crossed).select("k", "extra", "prefix", "before"), f"edge{level}")
    nearer = F.col("before") + F.col("size") - F.col("extra") < F.col("extra") - F.col("before")
    full = F.col("before") + F.col("size") <= F.col("extra")
    cut = sums.filter(full | (crossed & nearer)).groupBy("k").agg(F.max("prefix").alias("cut"))
    # where the last bucket gave none, all buckets before it are in: hashes that start lower than its prefix
    low = edge.select("k", F.col("prefix").alias("low"))
    out = t.join(cut, "k", "left").join(low, "k", "left")
    return written(
        out.select("k", "source_size", "target", "times", F.coalesce("cut", "low", F.lit("")).alias("cut")), "cuts"
    )


def doc_hash(id_col: str = "doc_id", text_col: str = "text"):
    """The 32 hexadecimal digits that decide about a document: of its id and whole text."""
    return F.md5(
        F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))
    )


def mix(
    df: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: bool = False,
    times: str = "mix_times",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes).

    With ``keep``: all columns of ``df``, and ``times``, how often the mix takes the document, ``most`` times at most.

    Null text: size 0, taken 0. Null source: a source of its own, after all others. Null id: hashed as an
    empty id. Rows that are equal in id and text have one hash and are taken alike. Documents without words are taken
    as often as their source's others with their hash would be; never, if the source has no words at all. Empty table:
    no rows. Extra columns: ignored, or with ``keep`` passed on; the column ``times`` replaces one of that name, in
    any case.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    slim = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        doc_hash(id_col, text_col).alias("h"),
    )
    slim = written(slim, "sizes")
    targets = written(source_targets(slim, weights, most), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    cuts = thresholds(slim, targets, few)
    rows = df if keep else slim
    k, h, n, cut = free(rows, "k", "h", "n", "cut")
    side = cuts.select(F.col("k").alias(k), F.col("times").alias(n), F.col("cut").alias(cut), "source_size", "target")
    taken = F.col(n) + F.when(F.col(h) <= F.col(cut), 1).otherwise(0)
    if keep:
        rows = df.withColumns({k: source_key(F.col(source_col)), h: doc_hash(id_col, text_col)})
        out = _with_sources(rows, side.drop("source_size", "target"), [k], h, few)
        return out.select(*columns(df, (times.lower(),)), taken.cast("int").alias(times))
    rows = slim.withColumnsRenamed({"h": h}).withColumn(k, source_key(F.col("source"))).drop("source")
    out = _with_sources(rows, side, [k], h, few).withColumn("taken", (F.col("size") * taken).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
