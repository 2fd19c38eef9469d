"""Adaptive time partitions: Parquet files of a bounded number of rows, by calendar nodes that split where rows are many.

The years from the first to the last moment are siblings; a node with more rows than the limit splits into all its
months, days or hours. Siblings within the limit are joined into runs while a run stays within it. Only hours above the
limit and rows without a moment fill more than one part; where their parts end, distributed radix selection finds the
exact sort keys: each round counts digits of the rows that share a boundary's prefix, Spark keeps the digit that holds
each boundary, and the rows that go on become few. A boundary among equal rows gets an ordinal, so that so many of them
go before it. Every row then finds its file by a search in the boundaries; no window ranks rows.

The driver gets the counts of children of nodes above the limit and the boundaries. With a limit of a 650th of all
rows, both are bounded whatever the table's size.
"""

from __future__ import annotations

import datetime
import hashlib
from calendar import monthrange
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, DoubleType, FloatType, StructType

from .common import columns, local_rows, shared_dir, shuffle_partitions, written

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Bits of a digit of the radix selection.
DIGIT = 12
#: Copies of equal rows that are put out at a time.
COPIES = 10_000
#: Parts of a sort key: numbers that aren't null, nulls last. The last two are a digest of the whole row.
KEY = ("moment", "late_null", "late", "id_null", "id_high", "id_low", "digest_high", "digest_low")
_EPOCH = datetime.date(1970, 1, 1).toordinal()


@dataclass(frozen=True)
class Leaf:
    """A run of siblings with rows: its name, first and next moment in microseconds (null: neither), and rows."""

    name: str
    low: int | None
    high: int | None
    n: int


@dataclass(frozen=True)
class Bound:
    """The key of the row at a multiple of the limit in a leaf; of ``n`` equal rows, ``before`` go before the boundary."""

    key: tuple[int, ...]
    before: int
    n: int


@dataclass
class Layout:
    limit: int
    leaves: list[Leaf]
    bounds: dict[int, list[Bound]] = field(default_factory=dict)  # by leaf

    def files(self) -> list[tuple[str, int, int]]:
        """(leaf, part, rows) of all files in order."""
        out = []
        for leaf in self.leaves:
            out += [(leaf.name, p + 1, min(self.limit, leaf.n - p * self.limit)) for p in range(-(-leaf.n // self.limit))]
        return out

    def first_files(self) -> list[int]:
        """The number of the first file of each leaf."""
        return np.cumsum([0, *(-(-leaf.n // self.limit) for leaf in self.leaves)])[:-1].tolist()


def _div(x: Column, n: int) -> Column:
    """The whole quotient of a long, rounded down."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def micros(at: Column) -> Column:
    """Microseconds from 1970 to a timestamp as its clock shows it, in whatever time zone the session is."""
    since = at.cast("timestamp_ntz") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return F.call_function("div", since, F.expr("INTERVAL '0.000001' SECOND"))


def click_moment(at: Column, click_id: Column) -> Column:
    """Microseconds of a click's moment: some ids' are days earlier, some are at their week's begin. A null id moves nothing."""
    k, us = F.crc32(click_id.cast("string")) % 128, micros(at)
    back = F.pow(k + 6, F.lit(3)).cast("long") * DAY
    since_monday = F.pmod(us + 3 * DAY, F.lit(7 * DAY))  # 1970 began on a Thursday
    return us - F.when(k < 16, back).when(k > 111, since_monday).otherwise(0)


def _digest(row: StructType) -> Column:
    """A hash of every value of a row, nulls apart from others and -0.0 from 0.0."""
    parts: list[Column] = []
    for name, kind in ((f.name, f.dataType) for f in row):
        value = F.col("row").getField(name)
        if isinstance(kind, (FloatType, DoubleType)):
            parts.append((value == 0) & (F.atan2(value, F.lit(-1.0)) < 0))
        elif not isinstance(kind, AtomicType):
            value = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def keyed(rows: DataFrame, moment: Column) -> DataFrame:
    """``rows`` (row: a struct of a table's columns; any others) with timed and moment, the first part of KEY."""
    return rows.select("*", moment.isNotNull().alias("timed"), F.coalesce(moment, F.lit(0)).cast("long").alias("moment"))


def with_key(rows: DataFrame, late: str, id_col: str) -> DataFrame:
    """``rows`` (of ``keyed``) with the other parts of KEY."""
    at, number = F.col("row").getField(late), F.col("row").getField(id_col)
    digest, whole, low = _digest(rows.schema["row"].dataType), F.coalesce(number.cast("long"), F.lit(0)), F.lit(0xFFFFFFFF)
    return rows.select(
        "*",
        at.isNull().cast("long").alias("late_null"),
        F.coalesce(micros(at), F.lit(0)).cast("long").alias("late"),
        number.isNull().cast("long").alias("id_null"),
        F.shiftright(whole, 32).alias("id_high"),
        whole.bitwiseAND(low).alias("id_low"),
        F.shiftrightunsigned(digest, 32).alias("digest_high"),
        digest.bitwiseAND(low).alias("digest_low"),
    )


def _at(year: int, month: int = 1, day: int = 1) -> int:
    return (datetime.date(year, month, day).toordinal() - _EPOCH) * DAY


def _children(name: str) -> list[tuple[str, int, int]]:
    """(name, first moment, next moment) of all months, days or hours of a node such as 2024, 2024/03 or 2024/03/05."""
    at = [int(x) for x in name.split("/")]
    if len(at) == 1:
        lows = [(m, _at(*at, m), _at(*at, m) + monthrange(*at, m)[1] * DAY) for m in range(1, 13)]
    elif len(at) == 2:
        lows = [(d, _at(*at, d), _at(*at, d) + DAY) for d in range(1, monthrange(*at)[1] + 1)]
    else:
        lows = [(h, _at(*at) + h * HOUR, _at(*at) + (h + 1) * HOUR) for h in range(24)]
    return [(f"{name}/{k:02}", low, high) for k, low, high in lows]


def runs(siblings: list[tuple[str, int, int]], counts: dict[str, int], limit: int) -> tuple[list[Leaf], list[str]]:
    """The runs with rows of siblings in time order, and the siblings above the limit."""
    out: list[Leaf] = []
    above, members = [], None
    for name, low, high in siblings:
        n = counts.get(name, 0)
        if n > limit:
            above.append(name)
            members = None
        elif members and members.n + n <= limit:
            first, _, last = name.rpartition("/")
            members = Leaf(f"{members.name.rpartition('-')[0]}-{last}", members.low, high, members.n + n)
            out[-1] = members
        else:
            members = Leaf(f"{name}-{name.rpartition('/')[2]}", low, high, n)
            out.append(members)
    return [leaf for leaf in out if leaf.n], above


def find_leaves(rows: DataFrame, limit: int) -> list[Leaf]:
    """All leaves in time order, that of null moments last."""
    hour = F.when(F.col("timed"), _div(F.col("moment"), HOUR))
    hours = written(rows.groupBy(hour.alias("h")).agg(F.count("*").alias("n")), "hours")  # a row an hour at most
    date = F.date_add(F.lit(datetime.date(1970, 1, 1)), _div(F.col("h"), 24).cast("int"))
    parts = [F.lpad(F.year(date).cast("string"), 4, "0"), F.lpad(F.month(date).cast("string"), 2, "0")]
    parts += [F.lpad(F.dayofmonth(date).cast("string"), 2, "0"), F.lpad(F.pmod(F.col("h"), F.lit(24)).cast("string"), 2, "0")]
    out: list[Leaf] = []
    above: list[str] = []
    for level in range(4):
        of, parent = hours.filter("h is not null"), F.concat_ws("/", *parts[:level])
        if level:
            if not above:
                break
            of = of.filter(parent.isin(above))
        named = of.groupBy(F.concat_ws("/", *parts[: level + 1]).alias("node")).agg(F.sum("n").alias("n"))
        counts = dict(named.collect())
        if level:
            groups = [_children(name) for name in above]
        else:
            span = range(int(min(counts)), int(max(counts)) + 1) if counts else range(0)
            groups = [[(f"{y:04}", _at(y), _at(y, 12, 31) + DAY) for y in span]]
        above = []
        for siblings in groups:
            leaves, more = runs(siblings, counts, limit)
            out += leaves
            above += more
            if level == 3:
                out += [Leaf(f"{n}-{n.rpartition('/')[2]}", low, high, counts[n]) for n, low, high in siblings if n in more]
    out.sort(key=lambda leaf: leaf.low)
    null = hours.filter("h is null").first()
    return out + ([Leaf("null", None, None, null.n)] if null else [])


def _chosen(targets: dict[int, list[int]]):
    """For each bucket's digits: those that hold a target rank, with the rows before them."""

    def choose(key: tuple, digits: pd.DataFrame) -> pd.DataFrame:
        digits = digits.sort_values("digit")
        up_to = digits["n"].to_numpy().cumsum()
        digits["before"] = up_to - digits["n"]
        at = np.unique(np.searchsorted(up_to, targets[int(key[0])], "left"))
        return digits.iloc[at]

    return choose


def find_bounds(rows: DataFrame, leaves: list[Leaf], limit: int, key) -> dict[int, list[Bound]]:
    """The boundaries of the leaves with more rows than the limit, by leaf: radix selection over their rows."""
    spark = rows.sparkSession
    many = {i: leaf for i, leaf in enumerate(leaves) if leaf.n > limit}
    if not many:
        return {}
    hour = F.when(F.col("timed"), F.col("moment") - F.pmod(F.col("moment"), F.lit(HOUR))).otherwise(F.lit(-(1 << 62)))
    where = local_rows(spark, [(i, -(1 << 62) if x.low is None else x.low) for i, x in many.items()], "bucket int, hour long")
    live = key(rows.withColumn("hour", hour).join(F.broadcast(where), "hour")).select("bucket", *KEY)
    live = written(live, "live")  # the keys of the rows of these leaves alone: the table is read once
    # bucket: its leaf, the ranks to find in it, the part of the key that differs first, its least value, bits to leave out
    shift = max(0, HOUR.bit_length() - DIGIT)
    open_ = {
        i: (i, [k * limit for k in range(1, -(-x.n // limit))], 0, x.low or 0, shift if x.low is not None else 0) for i, x in many.items()
    }
    found: dict[int, list[tuple[int, Bound]]] = {i: [] for i in many}
    offset: dict[int, int] = dict.fromkeys(many, 0)  # rows of the leaf before the bucket
    while open_:
        state = local_rows(spark, [(b, j, lo, s) for b, (_, _, j, lo, s) in open_.items()], "bucket int, j int, lo long, bits int")
        digit = F.expr(f"shiftright(array({', '.join(KEY)})[j] - lo, bits)")
        digits = live.join(F.broadcast(state), "bucket").withColumn("digit", digit)
        sides = [f(c).alias(f"{side}_{c}") for c in KEY for side, f in (("least", F.min), ("most", F.max))]
        seen = digits.groupBy("bucket", "digit").agg(F.count("*").alias("n"), *sides)
        schema = "bucket int, digit long, n long, " + ", ".join(f"least_{c} long, most_{c} long" for c in KEY) + ", before long"
        picked = seen.groupBy("bucket").applyInPandas(_chosen({b: x[1] for b, x in open_.items()}), schema).collect()
        following, dealt, next_offset = {}, [], {}
        for r in sorted(picked, key=lambda r: (r.bucket, r.digit)):
            leaf, targets, *_ = open_[r.bucket]
            inside = [t - r.before for t in targets if r.before < t <= r.before + r.n]
            least, most = tuple(r[f"least_{c}"] for c in KEY), tuple(r[f"most_{c}"] for c in KEY)
            start = offset[r.bucket] + r.before
            if least == most:
                found[leaf] += [(start + t, Bound(least, t, r.n)) for t in inside]
                continue
            j = next(k for k in range(len(KEY)) if least[k] != most[k])
            b = len(following)
            following[b] = (leaf, inside, j, least[j], max(0, (most[j] - least[j]).bit_length() - DIGIT))
            next_offset[b] = start
            dealt.append((r.bucket, r.digit, b))
        if following:
            go_on = local_rows(spark, dealt, "bucket int, digit long, next int")
            live = digits.join(F.broadcast(go_on), ["bucket", "digit"]).select(F.col("next").alias("bucket"), *KEY)
            live = written(live, "live")
        open_, offset = following, next_offset
    return {leaf: [b for _, b in sorted(at, key=lambda x: x[0])] for leaf, at in found.items()}


def plan(rows: DataFrame, limit: int, key) -> Layout:
    """The layout of ``rows`` (of ``keyed``) in files of ``limit`` rows at most; ``key`` gives rows all parts of KEY."""
    leaves = find_leaves(rows, limit)
    return Layout(limit, leaves, find_bounds(rows, leaves, limit, key))


def search(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each row of ``key``, how many rows of the ascending ``bounds`` are below it: all rows step together."""
    low, high = np.zeros(len(key), np.int64), np.full(len(key), len(bounds), np.int64)
    for _ in range(int(len(bounds)).bit_length()):
        going = low < high
        middle = (low + high) // 2
        at = bounds[np.minimum(middle, len(bounds) - 1)]
        below, same = np.zeros(len(key), bool), np.ones(len(key), bool)
        for j in range(key.shape[1]):
            below |= same & (at[:, j] < key[:, j])
            same &= at[:, j] == key[:, j]
        low = np.where(going & below, middle + 1, low)
        high = np.where(going & ~below, middle, high)
    return low


def route(rows: DataFrame, layout: Layout) -> DataFrame:
    """row, the parts of KEY and the number of the file of each row."""
    spark, first = rows.sparkSession, layout.first_files()
    timed = [leaf for leaf in layout.leaves if leaf.low is not None]
    starts, first_of = np.array([leaf.low for leaf in timed], np.int64), np.array([*first, 0], np.int64)
    bounds = {i: np.array([b.key for b in at], np.int64) for i, at in layout.bounds.items()}
    cut = {i: np.array([b.before < b.n for b in at]) for i, at in layout.bounds.items()}
    null_leaf = len(timed)

    @F.pandas_udf("int")
    def file_of(timed: pd.Series, *key: pd.Series) -> pd.Series:
        moment = key[0].to_numpy()
        leaf = np.where(timed.to_numpy(bool), np.searchsorted(starts, moment, "right") - 1, null_leaf)
        out = first_of[leaf].copy()
        for i in np.unique(leaf):
            if i in bounds:
                at = np.flatnonzero(leaf == i)
                own = np.stack([k.to_numpy()[at] for k in key], axis=1)
                part, split = search(own, bounds[i]), np.concatenate([[0], np.cumsum(cut[i])])
                own[:, -1] += 1
                after = search(own, bounds[i])  # bounds that aren't above it
                out[at] = np.where(split[after] > split[part], -1, out[at] + part)
        return pd.Series(out.astype(np.int32))

    routed = rows.select("row", *KEY, file_of("timed", *KEY).alias("file"))
    # equal rows that a boundary divides: one of them stands for all, as often as each file takes it
    shares = []
    for i, at in layout.bounds.items():
        groups: dict[tuple[int, ...], list[int]] = {}
        for p, b in enumerate(at):
            groups.setdefault(b.key, []).append(p)
        for key, ps in groups.items():
            if any(at[p].before < at[p].n for p in ps):
                edges = [0, *(at[p].before for p in ps), at[ps[0]].n]
                shares += [(i, *key, first[i] + ps[0] + k, edges[k + 1] - edges[k]) for k in range(len(ps) + 1) if edges[k + 1] > edges[k]]
    if not shares:
        return routed
    kinds = ", ".join(f"{c} long" for c in KEY)
    shares_of = local_rows(spark, [s[1:] for s in shares], f"{kinds}, file int, copies long")
    one = routed.filter("file < 0").groupBy(*KEY).agg(F.first("row").alias("row"))
    ties = one.join(F.broadcast(shares_of), list(KEY))
    ties = ties.withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    ties = ties.withColumn("copy", F.explode(F.expr(f"sequence(1L, least({COPIES}L, copies - lot * {COPIES}))")))
    return routed.filter("file >= 0").unionByName(ties.select("row", *KEY, "file"))


def _folder_of(name: str, part: int) -> str:
    return f"{name.replace('/', '.')}_{part}"


def _dealt(df: DataFrame, files: int) -> DataFrame:
    """By file, the files spread evenly over tasks."""
    n = max(1, min(files, shuffle_partitions(df.sparkSession)))
    return df.repartitionById(n, F.col("file") % n)


def write_files(routed: DataFrame, files: list[tuple[str, int, int]], folder: str) -> None:
    """The rows of each file in order, as one Parquet file in a folder of its own below ``folder``."""
    of, taken = "of", {c.lower() for c in routed.schema["row"].dataType.names}
    while of in taken:
        of += "x"
    names = local_rows(routed.sparkSession, [(i, _folder_of(*f[:2])) for i, f in enumerate(files)], "file int, folder string")
    rows = routed.join(F.broadcast(names), "file").withColumn(of, F.coalesce("folder", F.lit("-")))  # not null: the writer sorts no more
    rows = _dealt(rows, len(files)).sortWithinPartitions(of, *KEY).select("row.*", of)
    rows.write.mode("append").option("maxRecordsPerFile", 0).partitionBy(of).parquet(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """row, path, place (of the row in its file) and name (leaf and part as in the folder) of all files below ``folder``."""
    df = spark.read.option("recursiveFileLookup", True).parquet(folder)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"/[^/=]*=([^/]*)/[^/]*$", 1)
    return df.select(F.struct(*columns(df)).alias("row"), path.alias("path"), F.col("_metadata.row_index").alias("place"), name.alias("name"))


def _signs(rows: DataFrame, by: str, *more: Column) -> dict:
    """By file, what its rows are, in whatever order: number and sums of digests."""
    signs = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum("digest_high").alias("a"), F.sum("digest_low").alias("b"), *more)
    return {r[by]: r for r in signs.collect()}


def _sha(batches):
    """Rows, SHA-256 of the ids and path of each file of a sorted partition, streaming."""
    current, n, sha, path = None, 0, None, None
    rows: list[tuple] = []
    for batch in batches:
        file, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(file)) + 1).tolist(), len(file)]
        for low, high in zip(edges, edges[1:], strict=False):
            if low == high:
                continue
            if file[low] != current:
                if sha:
                    rows.append((current, n, sha.hexdigest(), path))
                current, n, sha, path = int(file[low]), 0, hashlib.sha256(), batch.column(2)[low].as_py()
            text = ",".join("" if i is None else str(i) for i in ids[low:high])
            sha.update((("," if n else "") + text).encode())
            n += high - low
    if sha:
        rows.append((current, n, sha.hexdigest(), path))
    names = ["file", "n_rows", "ids_sha256", "path"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def rewrite(rows: DataFrame, folder: str, new: Column, limit: int, first, key) -> dict[str, tuple[str, int, int, bool, int]]:
    """Makes ``folder`` hold ``rows`` (row: a struct) in their layout. Files whose leaf, part and rows recur stay.

    ``first`` gives rows the first part of KEY, ``key`` the others. Returns, by the files' names in ``folder``: leaf, part, rows, rows of which ``new``
    holds, whether it was written. Other files go once the new ones are there. Empty tables leave no files.
    """
    spark, rows = rows.sparkSession, first(rows)
    layout = plan(rows, limit, key)
    files, stored = layout.files(), {}
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(folder)):
        stored = _signs(key(first(read_files(spark, folder))), "name", F.min("path").alias("path"))
    routed = route(key(rows), layout)
    signs = _signs(routed, "file", F.sum(new.cast("long")).alias("new"))
    out, wanted = {}, []
    for i, (leaf, part, n) in enumerate(files):
        name, sign = _folder_of(leaf, part), signs[i]
        if sign.n != n:
            raise RuntimeError(f"{name} has {sign.n} rows, not the {n} that were counted: the input changed meanwhile")
        old = stored.get(name)
        stays = old is not None and (old.n, old.a, old.b) == (sign.n, sign.a, sign.b)
        out[name] = (leaf, part, n, sign.new, not stays)
        if not stays:
            wanted.append((i,))
    if wanted:
        write_files(routed.join(F.broadcast(local_rows(spark, wanted, "file int")), "file"), files, folder)
    for name, old in stored.items():
        at = path(spark._jvm.java.net.URI(old.path))
        if name not in out:
            fs.delete(at.getParent(), True)
        elif out[name][-1]:
            fs.delete(at, False)
    return out


def partitioned_twice(
    table: DataFrame, cutoff: str = "2024-03-01 00:00:00", share: int = 650, at: str = "ts", late: str = "arrived_at", id_col: str = "click_id"
) -> DataFrame:
    """Writes the rows that arrived before ``cutoff`` to a new folder, then rewrites it for all, and lists the final files.

    leaf, columns, ids_sha256, path, part, n_rows, n_new, rewritten, by file. A file holds 1 + rows / ``share`` rows at
    most. Null moments have a leaf of their own; a null arrival is after the cutoff and sorts last, as a null id does,
    which adds an empty text to the list of ids. Rows that are equal in moment, arrival and id are ordered by a digest of
    all their columns; equal rows are all written. Other columns of any names go along. An empty table gives no rows.
    The folder is left where it is.
    """
    spark = table.sparkSession
    folder, limit = shared_dir(spark, leave=True), 1 + table.count() // share
    of = lambda name: F.col("row").getField(name)
    first = lambda df: keyed(df, click_moment(of(at), of(id_col)))
    key = lambda df: with_key(df, late, id_col)
    rows = table.select(F.struct(*columns(table)).alias("row"))
    old = F.coalesce(of(late) < F.lit(cutoff).cast(table.schema[late].dataType), F.lit(False))
    rewrite(rows.filter(old), folder, ~old, limit, first, key)
    files = rewrite(rows, folder, ~old, limit, first, key)
    schema = "file int, name string, leaf string, columns string, part long, n_new long, rewritten boolean"
    if not files:
        return local_rows(spark, [], "leaf string, columns string, ids_sha256 string, path string, part long, n_rows long, n_new long, rewritten boolean")
    stored = read_files(spark, folder)
    names = ",".join(stored.schema["row"].dataType.names)
    about = [(i, name, leaf, names, part, n_new, made) for i, (name, (leaf, part, _, n_new, made)) in enumerate(files.items())]
    listed = F.broadcast(local_rows(spark, about, schema))
    ids = stored.join(listed.select("file", "name"), "name").select("file", "place", "path", of(id_col).cast("string").alias("id"))
    in_order = _dealt(ids, len(files)).sortWithinPartitions("file", "place").select("file", "id", "path")
    shas = in_order.mapInArrow(_sha, "file int, n_rows long, ids_sha256 string, path string")
    return shas.join(listed, "file").select("leaf", "columns", "ids_sha256", "path", "part", "n_rows", "n_new", "rewritten")
