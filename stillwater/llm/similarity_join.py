"""N-gram Jaccard join by chosen paths.

The set of a document is its five-word shingles. Rows of equal sets are one class. Each class has a sketch:
its smallest shingle under each of POSITIONS hash functions, tokens that two sets share with probability
equal to their similarity. A run splits all classes on the token at one sampled position, splits buckets that
stay large again on another, and so on; small buckets are compared by brute force on their sketches. Runs are
repeated, in batches, for the classes that haven't reached the target recall at the least similarity.

Copies of one text share most tokens, so splitting hardly parts them. Before a large bucket is split, its classes are
compared to a few representatives: those that are like one are tied to it; those very like it leave the bucket, since
all that are similar to them are tied to it too (distances obey the triangle inequality).

Buckets give a graph of likely pairs, thinned to a star for each connected part, so a group of n similar
texts costs n edges. Its components are then verified exactly, all pairs within; also pairs that no bucket held, so
the recall is above the runs'. Small components are compared by brute force. The sets of a large one are described
by their difference from its leader, the shingles that most of a sample have: with x shingles in A or B but not both,

    similarity(A, B) >= 0.8  <=>  9 x <= |A| + |B|,  x = |dA| + |dB| - 2 |dA and dB|
                             <=>  w(A) + w(B) <= 18 |dA and dB|,  w(A) = 9 |dA| - |A|

so pairs with w(A) + w(B) <= 0 are similar whatever their differences, and are counted by a histogram of w; the
others alone are compared, block against block. Results are, for each class, its number of links and a star edge; pairs
are never emitted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, row_key, shuffle_partitions, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Tokens of a sketch, and how far below SIMILARITY its estimate may lie (5 standard deviations: 1 in 200,000 pairs of
#: the least similarity is lost).
POSITIONS, SLACK = 64, 0.25
#: Runs of a batch, and the recall to reach at the least similarity before no further batch is run.
RUNS, RECALL = 6, 0.9999
#: Classes up to which a bucket is compared as it is; larger ones are split, up to DEPTH times, then compared in
#: blocks of half as many.
LEAF, DEPTH = 2048, 5
#: Representatives of a large bucket; tokens shared with one from which a class is tied to it (similarity 0.3 at
#: least), and from which it leaves the bucket (0.9: whatever is similar to it has at least 0.55 with the other).
REPRESENTATIVES, LOOSE, TIGHT = 3, 19, 58
#: Classes, and shingles, of a component that are compared by brute force, and of a block of a larger one.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Classes of a sample that its leader is drawn from.
DRAWN = 48
#: Members of components up to which they are broadcast to fetch their texts (about 150 bytes each); beyond, joined.
BROADCAST_MEMBERS = 200_000
#: Words of which a worker remembers the hash.
CACHE = 300_000

_word = re.compile(WORD)
_rng = np.random.default_rng(11)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_hashes = _Hashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-case shingles; fewer than five words make up one shingle."""
    words = _word.findall((text or "").lower())
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out += h[j : n - size + 1 + j] * _PLACE[j]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The smallest shingle hash, its upper 32 bits, under each function."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 1 << 14):
        part = shingles[k : k + (1 << 14)]
        for t in range(POSITIONS):
            low[t] = min(low[t], (part * _MULTIPLY[t] + _ADD[t]).min())
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_SETS = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.binary()), ("set_id", pa.binary()), ("n", pa.int32()), ("sketch", pa.list_(pa.int32()))]
)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            ids.append(set_id(s) if len(s) else None)
            sketches.append(sketch(s) if len(s) else None)
        arrays = [batch.column("doc_id"), batch.column("key"), pa.array(ids, pa.binary()), pa.array(n, pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [*arrays, pa.array(sketches, pa.list_(pa.int32()))], names=_SETS.names
        )


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]):
    """(key, columns) of runs of equal keys in a sorted partition; columns as lists."""
    at, held = None, None
    for batch in batches:
        ks = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        values = [batch.column(c).to_pylist() for c in columns]
        low = 0
        for i in range(1, len(ks) + 1):
            if i < len(ks) and ks[i] == ks[low]:
                continue
            part = [v[low:i] for v in values]
            if at == ks[low]:
                for h, p in zip(held, part):
                    h.extend(p)
            else:
                if at is not None:
                    yield at, held
                at, held = ks[low], part
            low = i
    if at is not None:
        yield at, held


class _Parts:
    """Connected parts of few nodes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _stars(names: list[bytes], parts: _Parts) -> tuple[list[bytes], list[bytes]]:
    """Each node that isn't its part's smallest name, and that name."""
    least: dict[int, bytes] = {}
    roots = [parts.find(i) for i in range(len(names))]
    for r, name in zip(roots, names):
        if r not in least or name < least[r]:
            least[r] = name
    pairs = [(name, least[r]) for r, name in zip(roots, names) if name != least[r]]
    return [a for a, _ in pairs], [b for _, b in pairs]


def _leaf_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of the likely pairs in each bucket, or between the two blocks of a pair of them."""
    need = int(np.ceil((SIMILARITY - SLACK) * POSITIONS))
    out_a: list[bytes] = []
    out_b: list[bytes] = []
    for (_, i, j), (names, blocks, sketches) in _groups(batches, ["bucket", "i", "j"], ["set_id", "block", "sketch"]):
        if len(names) < 2:
            continue
        s, parts = np.array(sketches, np.int32), _Parts(len(names))
        side = np.array(blocks)
        for low in range(0, len(s), 32):
            same = (s[low : low + 32, None, :] == s[None, :, :]).sum(2, dtype=np.int16) >= need
            if i != j:
                same &= side[low : low + 32, None] != side[None, :]
            x, y = np.nonzero(same)
            for a, b in zip((x + low).tolist(), y.tolist()):
                if a < b:
                    parts.join(a, b)
        a, b = _stars(names, parts)
        out_a += a
        out_b += b
        if len(out_a) > 20_000:
            yield pa.record_batch([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], schema=_EDGE)
            out_a, out_b = [], []
    yield pa.record_batch([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], schema=_EDGE)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets."""
    m = len(sets)
    if m <= 3:
        out = np.zeros((m, m), np.int64)
        for a in range(m):
            for b in range(a + 1, m):
                out[a, b] = out[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(fresh) - 1
    often = np.bincount(column) > 1  # a shingle of one set adds to no intersection
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    out = np.zeros((m, m), np.float32)
    width = max(64, (1 << 22) // m)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(edges) - 1):
        low, high = edges[k], edges[k + 1]
        if low < high:
            slab = np.zeros((m, width), np.float32)
            slab[owner[low:high], column[low:high] - k * width] = 1
            out += slab @ slab.T
    return np.rint(out).astype(np.int64)


_LINKS = pa.schema([("set_id", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])
_LINKS_DDL = "set_id binary, links long, root binary"


def _shingled(columns: list[str]):
    """``columns`` and the shingles of the rows' texts; of equal classes in a task one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for k, name in enumerate(batch.column("set_id").to_pylist()):
                if name not in seen:
                    seen.add(name)
                    fresh.append(k)
            if not fresh:
                continue
            some = batch.take(pa.array(fresh))
            sets = [shingle_set(t).tobytes() for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in columns), pa.array(sets, pa.binary())], names=[*columns, "shingles"]
            )

    return run


def _linked(names: list[bytes], linked: np.ndarray, copies: list[int], rows: list[tuple]) -> None:
    """Adds (set_id, links, root) of each class with a link."""
    links = linked @ np.array(copies, np.int64)
    parts = _Parts(len(names))
    x, y = np.nonzero(np.triu(linked))
    for a, b in zip(x.tolist(), y.tolist()):
        parts.join(a, b)
    least: dict[int, bytes] = {}
    roots = [parts.find(k) for k in range(len(names))]
    for r, name in zip(roots, names):
        least[r] = min(least.get(r, name), name)
    rows += [(name, int(n), least[r]) for name, n, r in zip(names, links, roots) if n]


def _links_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINKS)], schema=_LINKS)


def _distinct(held: list[list]) -> list[list]:
    """The columns with one row of each name, the first column."""
    pick = list({name: k for k, name in enumerate(held[0])}.values())
    return [[c[k] for k in pick] for c in held]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, links, root) of each class with a link, of whole components."""
    rows: list[tuple] = []
    for _, held in _groups(batches, ["component"], ["set_id", "copies", "shingles"]):
        names, copies, shingles = _distinct(held)
        if len(names) < 2:
            continue
        sets = [np.frombuffer(s, np.uint64) for s in shingles]
        size = np.array([len(s) for s in sets], np.int64)
        common = common_counts(sets)
        # similarity >= 0.8 in integers: 5 * common >= 4 * union
        linked = common * 5 >= (size[:, None] + size[None, :] - common) * 4
        np.fill_diagonal(linked, False)
        _linked(names, linked, copies, rows)
        if len(rows) > 20_000:
            yield _links_batch(rows)
            rows = []
    if rows:
        yield _links_batch(rows)


def _lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, leader): the shingles that more than half of the drawn classes have."""
    for (component,), (shingles,) in _groups(batches, ["component"], ["shingles"]):
        values, counts = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in shingles]), return_counts=True)
        leader = values[counts * 2 > len(shingles)].tobytes()
        yield pa.record_batch([pa.array([component]), pa.array([leader], pa.binary())], names=["component", "leader"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, set_id, copies, w, cost, apart): the shingles in a class or its leader but not in both."""
    none = np.zeros(0, np.uint64)
    for batch in batches:
        w, cost, apart = [], [], []
        for own, leader in zip(batch.column("shingles").to_pylist(), batch.column("leader").to_pylist()):
            mine, lead = np.frombuffer(own, np.uint64), np.frombuffer(leader, np.uint64) if leader else none
            d = np.setxor1d(mine, lead, assume_unique=True)
            w.append(9 * len(d) - len(mine))
            cost.append(1 + len(d) * BLOCK // BLOCK_SHINGLES)
            apart.append(d.tobytes())
        kept = [batch.column(c) for c in ("component", "set_id", "copies")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(w, pa.int64()), pa.array(cost, pa.int64()), pa.array(apart, pa.binary())],
            names=["component", "set_id", "copies", "w", "cost", "apart"],
        )


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, links, root) for the links inside a block, or between two, that their w alone don't tell."""
    rows: list[tuple] = []
    columns = ["set_id", "copies", "block", "w", "apart"]
    for (_, i, j), held in _groups(batches, ["component", "i", "j"], columns):
        names, copies, blocks, w, apart = _distinct(held)
        if len(names) < 2:
            continue
        both = np.add.outer(w, w)
        common = common_counts([np.frombuffer(a, np.uint64) for a in apart])
        linked = (both > 0) & (both <= 18 * common)
        np.fill_diagonal(linked, False)
        if i != j:
            side = np.array(blocks)
            linked &= side[:, None] != side[None, :]
        _linked(names, linked, copies, rows)
        if len(rows) > 20_000:
            yield _links_batch(rows)
            rows = []
    if rows:
        yield _links_batch(rows)


def _large_links(sets: DataFrame) -> DataFrame:
    """Links (set_id, links, root; several rows a class) inside large components.

    sets: component, m and all_n (the component's classes and shingles), set_id, copies, shingles.
    """
    n = shuffle_partitions(sets.sparkSession)
    sets = written(sets, "large")
    drawn = F.greatest(F.lit(1), F.least(F.lit(DRAWN), F.floor(F.lit(BLOCK_SHINGLES) * F.col("m") / F.col("all_n"))))
    every = F.ceil(F.col("m") / drawn)
    sample = sets.filter(F.pmod(F.xxhash64("set_id"), every) == 0).select("component", "shingles")
    sample = sample.repartition(n, "component").sortWithinPartitions("component")
    leaders = written(sample.mapInArrow(_lead, "component binary, leader binary"), "leaders")
    # a leader for each 2,048 classes, so that a large component is spread
    salts = F.ceil(F.col("m") / 2048).cast("int")
    of = sets.select("component", salts.alias("salts")).distinct().join(leaders, "component")
    of = of.select("component", "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("set_id", F.lit(7)), salts).cast("int"))
    kind = "component binary, set_id binary, copies long, w long, cost long, apart binary"
    sides = salted.join(of, ["component", "salt"], "left").select("component", "set_id", "copies", "shingles", "leader")
    sides = written(sides.mapInArrow(_differ, kind).dropDuplicates(["set_id"]), "differences")

    by_w = sides.groupBy("component", "w").agg(F.sum("copies").alias("copies"), F.sum("cost").alias("cost"))
    by_w = written(by_w, "by_w")
    points = by_w.select("component", F.col("w").alias("v"), "copies", F.lit(0).alias("asks"), "w", "cost")
    asks = by_w.select("component", (-F.col("w")).alias("v"), F.lit(0).cast("long"), F.lit(1), "w", F.lit(0).cast("long"))
    order = Window.partitionBy("component").orderBy("v", "asks").rowsBetween(Window.unboundedPreceding, 0)
    # copies of all classes up to -w, and where the classes of w lie in the order of w
    run = points.union(asks).withColumns({"upto": F.sum("copies").over(order), "spent": F.sum("cost").over(order)})
    told = run.groupBy("component", "w").agg(
        F.max(F.when(F.col("asks") == 1, F.col("upto"))).alias("told"),
        F.max(F.when(F.col("asks") == 0, F.col("spent"))).alias("spent"),
        F.max("cost").alias("all_cost"),
    )
    least = sides.groupBy("component").agg(F.min(F.struct("w", "set_id")).alias("least"), F.max("w").alias("most"))
    told = written(told.join(least, "component"), "told")
    low, high = F.floor((F.col("spent") - F.col("all_cost")) / BLOCK), F.floor((F.col("spent") - 1) / BLOCK)
    block = (low + F.pmod(F.xxhash64("set_id", F.lit(5)), high - low + 1)).cast("int")
    sides = sides.join(told, ["component", "w"]).withColumn("block", block)
    sides = written(sides.drop("spent", "all_cost", "cost"), "sides")
    own = F.when(F.col("w") <= 0, F.col("copies")).otherwise(0)  # a class is similar to itself, too
    tied = F.when(F.col("w") + F.col("least.w") <= 0, F.col("least.set_id")).otherwise(F.col("set_id"))
    by_w = sides.select("set_id", (F.col("told") - own).alias("links"), tied.alias("root"))

    asked = sides.filter(F.col("w") + F.col("most") > 0)  # the others' links are all told
    blocks = written(asked.groupBy("component", "block").agg(F.max("w").alias("top")), "blocks")
    other = blocks.select("component", F.col("block").alias("j"), F.col("top").alias("top_j"))
    pairs = blocks.select("component", F.col("block").alias("i"), "top").join(other, "component")
    pairs = pairs.filter((F.col("i") <= F.col("j")) & (F.col("top") + F.col("top_j") > 0)).select("component", "i", "j")
    ends = pairs.withColumn("block", F.col("i")).union(pairs.filter("i < j").withColumn("block", F.col("j")))
    asked = asked.select("component", "block", "set_id", "copies", "w", "apart").join(ends, ["component", "block"])
    asked = asked.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")
    return by_w.filter("links > 0").unionByName(asked.mapInArrow(_verify_blocks, _LINKS_DDL))


def _in_blocks(rows: DataFrame, key: str, n_blocks: str) -> DataFrame:
    """Rows once for each pair of blocks (i <= j) that theirs belongs to; one block: once."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(5)), F.col(n_blocks)).cast("int"))
    other = F.explode(F.expr(f"sequence(0, cast({n_blocks} as int) - 1)")).alias("other")
    rows = rows.select("*", other)
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", n_blocks)


def _alike(a: str, b: str):
    """Tokens that two sketches share."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)")


def _tied(large: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Star edges of large buckets' classes (set_id, run, bucket, size, sketch) to their bucket's representatives, and
    the classes that stay in their bucket."""
    first = [F.min(F.struct(F.xxhash64("set_id", F.lit(k)), "set_id", "sketch")).alias(f"r{k}") for k in range(REPRESENTATIVES)]
    salts = F.ceil(F.col("size") / LEAF).cast("int")
    chosen = large.groupBy("bucket", "size").agg(*first)
    chosen = chosen.select("bucket", *[f"r{k}" for k in range(REPRESENTATIVES)], F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    chosen = written(chosen, f"chosen{name}")
    rows = large.withColumn("salt", F.pmod(F.xxhash64("set_id", F.lit(7)), salts).cast("int")).join(chosen, ["bucket", "salt"])
    like = F.array(*[F.struct(_alike("sketch", f"r{k}.sketch").alias("same"), F.col(f"r{k}.set_id").alias("b")) for k in range(REPRESENTATIVES)])
    rows = written(rows.select("set_id", "run", "bucket", "sketch", like.alias("like")), f"tied{name}")
    edges = rows.select(F.col("set_id").alias("a"), F.explode("like").alias("r")).filter(F.col("r.same") >= LOOSE)
    edges = edges.select("a", F.col("r.b").alias("b")).filter("a <> b")
    stay = rows.filter(~F.exists("like", lambda r: r["same"] >= TIGHT)).select("set_id", "run", "bucket", "sketch")
    return edges, stay


def _batch(classes: DataFrame, batch: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(leaves: set_id, bucket, size; edges to representatives; depths: set_id and its chance of missing a pair) of one
    batch of runs."""
    order = np.random.default_rng(100).permutation(POSITIONS).tolist()
    picks = [(run, order[run]) for run in range(batch * RUNS, (batch + 1) * RUNS)]
    keys = F.array(*[F.xxhash64(F.lit(run), F.element_at("sketch", p + 1)) for run, p in picks])
    rows = classes.select("set_id", F.posexplode(keys).alias("run", "bucket"))
    leaves = edges = deep = None
    for depth in range(1, DEPTH + 1):
        name, last = f"{batch}-{depth}", depth == DEPTH
        # the sizes stand in a table, so that Spark can split the join of a popular token
        sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), f"sizes{name}")
        sized = written(rows.join(sizes, "bucket"), f"bucket{name}")
        leaf = (sized if last else sized.filter(F.col("size") <= LEAF)).select("set_id", "bucket", "size")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        large = sized.filter(F.col("size") > LEAF)
        if last or large.isEmpty():
            break
        if depth == 1:
            large = large.join(classes, "set_id")
        more, rows = _tied(large, name)
        edges = more if edges is None else edges.unionByName(more)
        position = F.pmod(F.xxhash64("bucket", F.lit(3)), F.lit(POSITIONS)).cast("int") + 1
        token = F.xxhash64("bucket", F.element_at("sketch", position))
        rows = rows.select("set_id", "run", token.alias("bucket"), "sketch")
        here = rows.select("set_id", "run", F.lit(depth + 1).alias("depth"))
        deep = here if deep is None else deep.unionByName(here)
    if deep is None:
        return leaves, None, None
    deep = deep.groupBy("set_id", "run").agg(F.max("depth").alias("depth"))
    # log of the chance that a pair of the least similarity parts in all runs; at depth 1 it is log(1 - 0.8) a run
    at = F.log(1 - F.pow(F.lit(SIMILARITY), F.col("depth")))
    one = float(np.log(1 - SIMILARITY))
    missed = deep.groupBy("set_id").agg((F.sum(at) + (RUNS - F.count("*")) * one).alias("log_miss"))
    return leaves, edges, missed


def likely_pairs(classes: DataFrame) -> DataFrame:
    """Star edges (a, b) of likely similar classes (set_id, sketch)."""
    n = shuffle_partitions(classes.sparkSession)
    wanted, one = float(np.log(1 - RECALL)), float(np.log(1 - SIMILARITY))
    edges, missed, some = None, None, classes
    for batch in range(POSITIONS // RUNS):
        leaves, tied, more = _batch(some, batch)
        leaves = leaves.select("set_id", "bucket", F.when(F.col("size") <= LEAF, 1).otherwise(
            F.ceil(F.col("size") / (LEAF // 2))).alias("blocks"))
        rows = _in_blocks(leaves.join(some, "set_id"), "bucket", "blocks")
        rows = rows.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        found = rows.mapInArrow(_leaf_edges, "a binary, b binary")
        found = written((found.unionByName(tied) if tied is not None else found).distinct(), f"likely{batch}")
        edges = found if edges is None else edges.unionByName(found)
        if missed is not None:  # classes that no large bucket held in this batch have missed by its runs alone
            now = F.coalesce("log_miss", F.lit(RUNS * one)) if more is not None else F.lit(RUNS * one)
            joined = missed.join(more, "set_id", "left") if more is not None else missed
            more = joined.select("set_id", (F.col("before") + now).alias("log_miss"))
        if more is None:
            break
        missed = more.filter(F.col("log_miss") > wanted).withColumnRenamed("log_miss", "before")
        missed = written(missed, f"missed{batch}")
        if missed.isEmpty():
            break
        # a pair is parted only where both its classes are split, so those that have missed enough go on alone
        some = classes.join(missed.select("set_id"), "set_id", "left_semi")
    else:
        raise RuntimeError("the target recall needs more runs than the sketches have positions")
    return edges.distinct()


def _keyed_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """similarity_classes with key, that of id and text, and root, which names the class also where no row has an id."""
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")
    )
    kind = "doc_id long, key binary, set_id binary, n int, sketch array<int>"
    sets = written(rows.mapInArrow(_sets, kind), "sets")
    classes = sets.filter("n > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("least_id"),
        F.count("*").alias("copies"),
        F.min("key").alias("key"),
        F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    classes = written(classes, "classes")
    near = components(likely_pairs(classes.select("set_id", "sketch"))).withColumnRenamed("root", "component")
    members = near.join(classes.select("set_id", "copies", "key", "n"), near.node == F.col("set_id")).drop("node")
    members = written(members, "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("all_n"))
    members = written(members.drop("n").join(written(sizes, "components"), "component"), "sized")
    few = members.count() <= BROADCAST_MEMBERS
    texts = rows.select("key", "text").join(F.broadcast(members) if few else members, "key")
    kept = ["component", "m", "all_n", "set_id", "copies"]
    kind = "component binary, m long, all_n long, set_id binary, copies long, shingles binary"
    shingled = texts.select(*kept, "text").mapInArrow(_shingled(kept), kind)
    small = (F.col("m") <= BLOCK) & (F.col("all_n") <= BLOCK_SHINGLES)
    if members.filter(~small).isEmpty():
        part, large = shingled, None
    else:
        shingled = written(shingled, "shingled")
        part, large = shingled.filter(small), shingled.filter(~small)
    n = shuffle_partitions(spark)
    part = part.select("component", "set_id", "copies", "shingles").repartition(n, "component")
    links = part.sortWithinPartitions("component").mapInArrow(_verify, _LINKS_DDL)
    links = written(links if large is None else links.unionByName(_large_links(large)), "links")

    joined = components(links.filter("root <> set_id").select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    summed = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("set_id", "least_id", "copies")
        .join(summed, "set_id", "left")
        .join(joined.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
    )
    of_class = written(of_class, "rooted")
    least = written(of_class.groupBy("root").agg(F.min("least_id").alias("class_id")), "least")
    of_class = written(
        of_class.join(least, "root").select(
            "set_id", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        ),
        "of_class",
    )
    out = sets.select("doc_id", "key", "set_id").join(of_class, "set_id", "left")
    return out.select(
        "doc_id",
        "key",
        "root",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def similarity_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, n_links.

    n_links counts the other rows whose set has a Jaccard similarity of at least 0.8 with the row's, equal sets
    included; class_id is the smallest doc_id of all rows that chains of links connect.

    Null, empty and blank texts have no shingles: no links, and the row's own id as class. A null id is passed
    on, and is a class id only where a class has no other. Repeated rows link to each other. Empty table: no
    rows. Other columns are ignored.
    """
    return _keyed_classes(df, id_col, text_col).drop("key", "root")


def one_of_each(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text and any other columns) with one row of each class: that of the smallest doc_id.

    Of rows that are equal in id and text one stays. A row with a null id stays only if its class has no other.
    Rows without words are in no class and all stay.
    """
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    [key] = free(df, "key")
    classes = _keyed_classes(df.filter(~wordless), "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")
    kept = written(classes.groupBy("root").agg(first).select(F.col("first.key").alias(key)), "kept")
    keyed = df.filter(~wordless).withColumn(key, row_key())
    # the join leaves equal keys together, so the copies go without another shuffle
    stay = keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
    return stay.unionByName(df.filter(wordless))
