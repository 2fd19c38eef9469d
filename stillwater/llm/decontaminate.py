"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

DataFrame operations only. A window slides over every start. One of m shingles that is similar to an item of m shingles
holds at least 8/9 m of the item's (at a text's end, where windows are shorter, 4/9 of both's), so starts with fewer
shingles of items of that length can't match and get no fingerprint: counts of sorted places tell, without a look at
single items. Every other window gets a 128-bit SimHash of its shingles, which is looked up in an index of all items'
fingerprints by 16-bit blocks. Both sides add block values near theirs, together every value within RADIUS // BLOCKS
flips: by the pigeonhole principle no fingerprint within RADIUS is missed. Windows and items that meet there are compared
exactly: weighted Jaccard similarity, the weight of a shingle being its number of occurrences.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, columns, free, row_key, written

#: Words of a shingle, and the least similarity of a match.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits that matching fingerprints may differ in, of 128: at similarity 0.8 a window differs in 19.4 on average,
#: with a standard deviation of 4.1.
RADIUS, BLOCKS = 31, 8
#: Distinct benchmark shingles up to which they are tested in the scan; beyond, documents are joined to them.
IN_SCAN = 50_000
#: Items up to which their index (1,096 rows, about 60 kB, an item) is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ITEMS = 1_000


def words_of(text: Column) -> Column:
    """Lower-case words of a text; none for null or blank ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), lambda w: w != "")


def shingles_of(words: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array of words, in order.

    The words are bound to a variable: the optimizer may put their expression in place of the column's name.
    """
    items = ", ".join(f"w[i + {j}]" for j in range(k))
    return F.expr(
        f"""transform(array({words}), w ->
            transform(if(size(w) < {k}, array(), sequence(0, size(w) - {k})), i -> xxhash64({items})))[0]"""
    )


def _lanes(x: str) -> list[Column]:
    """The bits of a long, three to a long, 21 bits apart, so that sums of up to 2^21 - 1 such longs count each bit."""
    mask = 1 | 1 << 21 | 1 << 42
    return [F.expr(f"((shiftrightunsigned({x}, {3 * j}) & 7L) * {1 | 1 << 20 | 1 << 40}L) & {mask}L") for j in range(22)]


def simhash(rows: DataFrame, key: str, shingles: str, names: tuple[str, str]) -> DataFrame:
    """key and the 128 bits of the SimHash of the row's array of shingle hashes, repeated ones weighing by their number.

    The bits' votes are sums over the exploded hashes; a row's are added up where it stands, before the shuffle.
    """
    hashed = rows.select(key, F.explode(shingles).alias("h")).selectExpr(f"`{key}`", "xxhash64(h, 0) AS x0", "xxhash64(h, 1) AS x1")
    sums = [F.sum(lane).alias(f"{x}_{j}") for x in ("x0", "x1") for j, lane in enumerate(_lanes(x))]
    votes = hashed.groupBy(key).agg(F.count("*").alias("m"), *sums)

    def bits(x: str) -> Column:
        lanes = ", ".join(f"{x}_{j}" for j in range(22))
        ones = f"shiftrightunsigned(v[b div 3], cast(21 * (b % 3) as int)) & {(1 << 21) - 1}L"
        return F.expr(
            f"""transform(array(array({lanes})), v -> aggregate(sequence(0, 63), 0L,
                (f, b) -> f | shiftleft(cast(2 * ({ones}) > m as long), b)))[0]"""
        )

    return votes.select(key, bits("x0").alias(names[0]), bits("x1").alias(names[1]))


def fingerprint_blocks(a: str, b: str) -> Column:
    """(block, value) of the eight 16-bit blocks of a fingerprint."""
    blocks = [
        f"named_struct('block', {i}, 'value', cast(shiftrightunsigned({a if i < 4 else b}, {16 * (i % 4)}) & 65535L as int))"
        for i in range(BLOCKS)
    ]
    return F.expr(f"array({', '.join(blocks)})")


def _starts(need: str, low: str, high: str) -> str:
    """SQL of the starts from low to high of windows of m shingles that hold ``need`` of the sorted places p at least.

    A start belongs to the first place that its window holds, so none comes twice.
    """
    first = f"greatest({low}, p[i + {need} - 1] - m + 1, if(i = 0, 0, p[i - 1] + 1))"
    last = f"least({high}, p[i])"
    return f"""if(size(p) < {need}, array(), flatten(transform(
        filter(sequence(0, size(p) - {need}), i -> {first} <= {last}), i -> sequence({first}, {last}))))"""


def _one_of(values: list[int]):
    return lambda h: h.isin(values)


def _counts(rows: DataFrame, key: str, shingles: str) -> DataFrame:
    return rows.select(key, F.explode(shingles).alias("h")).groupBy(key, "h").agg(F.count("*").alias("n"))


def _flipped(at: str, most: int) -> Column:
    """All values of a 16-bit block that differ from ``at`` in ``most`` bits at most."""
    masks = [m for m in range(1 << 16) if m.bit_count() <= most]
    return F.explode(F.expr(f"transform(array({', '.join(map(str, masks))}), m -> {at} ^ m)"))


def _matches(docs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """Matches of the items: key, doc_id, item_id, start, similarity, hamming. sizes: the words of a shingle that occur."""
    of_size = " ".join(f"when least(n_words, {SHINGLE}) = {k} then s{k}" for k in sizes)
    for k in sizes:
        items = items.withColumn(f"s{k}", shingles_of("words", k))
    items = items.withColumn("shingles", F.expr(f"case {of_size} end"))
    items = items.join(simhash(items, "item", "shingles", ("i0", "i1")), "item")
    items = written(items.select("item", "item_id", "n_words", "shingles", "i0", "i1"), "items")
    k = F.least(F.col("n_words"), F.lit(SHINGLE)).alias("k")
    places = written(items.select(k, "n_words", F.posexplode("shingles").alias("q", "h")).distinct(), "places")
    known = places.select("k", "h").distinct()
    # through a generator, below which no filter on the shingles is pushed to compute them again
    sets = F.array(*[F.struct(F.lit(k).alias("k"), shingles_of("words", k).alias("s")) for k in sizes])
    docs = docs.select("key", "doc_id", F.explode(sets).alias("of")).select("key", "doc_id", "of.k", F.col("of.s").alias("shingles"))
    if known.count() <= IN_SCAN:
        here: dict[int, list[int]] = {}
        for k, h in known.collect():
            here.setdefault(k, []).append(h)
        hit = [(F.col("k") == k) & F.exists("shingles", _one_of(here[k])) for k in sorted(here)]
        near = docs.filter(reduce(or_, hit, F.lit(False)))
    else:
        hits = docs.select("key", "k", F.explode("shingles").alias("h")).join(written(known, "known"), ["k", "h"])
        near = docs.join(written(hits.select("key", "k").distinct(), "hits"), ["key", "k"], "left_semi")
    near = written(near.select("key", "doc_id", "k", "shingles", F.monotonically_increasing_id().alias("rid")), "near")

    hits = near.select("rid", "k", F.size("shingles").alias("n"), F.posexplode("shingles").alias("at", "h"))
    hits = hits.join(places, ["k", "h"]).groupBy("rid", "n", (F.col("n_words") - F.col("k") + 1).alias("m"))
    hits = hits.agg(F.array_sort(F.collect_set("at")).alias("p"))
    # similarity 0.8 of m and m' shingles takes 4/9 (m + m') common ones; m' is below m at a text's end alone
    whole = _starts("cast(ceil(8 * m / 9) as int)", "0", "n - m")
    cut = _starts("cast(ceil(4 * m / 5) as int)", "greatest(0, n - m + 1)", "n - 1")
    windows = hits.select("rid", "m", F.explode(F.expr(f"concat({whole}, {cut})")).alias("start"))
    windows = windows.join(near, "rid").withColumn("shingles", F.expr("slice(shingles, start + 1, m)"))
    # windows of equal content are looked up and verified once
    windows = windows.withColumn("window", F.unhex(F.sha1(F.expr("cast(array_join(shingles, ',') as binary)"))))
    windows = written(windows.select("key", "rid", "doc_id", "start", "window", "shingles"), "windows")
    contents = written(windows.groupBy("window").agg(F.first("shingles").alias("shingles")), "contents")
    prints = written(simhash(contents, "window", "shingles", ("w0", "w1")), "prints")

    # of the flips that a block of a pair may differ in, the items' side of the index has all but one
    index = items.select("item", "i0", "i1", F.explode(fingerprint_blocks("i0", "i1")).alias("at"))
    index = index.select("item", "i0", "i1", F.col("at.block").alias("block"), _flipped("at.value", RADIUS // BLOCKS - 1).alias("value"))
    probes = prints.select("window", "w0", "w1", F.explode(fingerprint_blocks("w0", "w1")).alias("at"))
    probes = probes.select("window", "w0", "w1", F.col("at.block").alias("block"), _flipped("at.value", 1).alias("value"))
    index = F.broadcast(index) if items.count() <= BROADCAST_ITEMS else index.hint("merge")
    hamming = F.expr("bit_count(w0 ^ i0) + bit_count(w1 ^ i1)")
    candidates = (
        probes.join(index, ["block", "value"])
        .withColumn("hamming", hamming)
        .filter(F.col("hamming") <= RADIUS)
        .select("window", "item", "hamming")
        .distinct()
    )
    of_window, of_item = _counts(contents, "window", "shingles"), _counts(items, "item", "shingles")
    both = (
        candidates.join(of_window.withColumnRenamed("n", "n_window"), "window")
        .join(of_item.withColumnRenamed("n", "n_item"), ["item", "h"])
        .groupBy("window", "item", "hamming")
        .agg(F.sum(F.least("n_window", "n_item")).alias("common"))
    )
    sized = both.join(contents.select("window", F.size("shingles").alias("s_window")), "window").join(
        items.select("item", "item_id", F.size("shingles").alias("s_item")), "item"
    )
    similarity = F.col("common") / (F.col("s_window") + F.col("s_item") - F.col("common"))
    verified = sized.withColumn("similarity", similarity).filter(F.col("similarity") >= SIMILARITY)
    found = windows.select("key", "rid", "doc_id", "start", "window").join(
        verified.select("window", "item", "item_id", "similarity", "hamming"), "window"
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("early"), (-F.col("hamming")).alias("close"))).alias("best")
    return found.groupBy("rid", "key", "doc_id", "item", "item_id").agg(best).select(
        "key",
        "doc_id",
        "item_id",
        (-F.col("best.early")).alias("start"),
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.close")).alias("hamming"),
    )


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Best match of each document row with each benchmark item that a window of it is similar to.

    key (of id and text), doc_id, item_id, start (the window's first word), similarity, hamming.
    Null, empty or blank texts, of documents or items, match nothing. Items of fewer than five words have one
    shingle of all their words. Null ids are passed on; repeated document rows each give their rows, equal items
    give a row for each item; empty tables give no rows. Other columns are ignored.
    """
    rows = docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words")
    )
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words"))
    items = items.withColumn("n_words", F.size("words")).filter("n_words > 0")
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "benchmark")
    size = F.least(F.col("n_words"), F.lit(SHINGLE))
    sizes = sorted(r[0] for r in items.select(size.alias("k")).distinct().collect())
    return _matches(rows, items, sizes or [SHINGLE])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) without the rows that match an item; cases as for matches."""
    [key] = free(docs, "key")
    bad = written(matches(docs, benchmark).select(F.col("key").alias(key)).distinct(), "bad")
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*columns(docs))
