"""Importance resampling towards a target distribution, by a vectorised automaton over the bytes of Arrow columns.

The automaton classifies the UTF-8 bytes of a batch by a table, finds where words begin and end by the differences of
neighbouring classes, and advances the CRC-32 of all words at once, a byte a step. Features are runs of words, hashed
into buckets. A bucket's gain is the logarithm of how much likelier the target (the benchmark) makes it than the corpus
does; a document's weight is the sum of its features' gains. Gumbel noise from the document's id is added, and the
documents of the largest sums are drawn: sampling without replacement in proportion to exp(weight / 1000).

Two passes over the texts: one counts buckets (a row a bucket and task, summed by Spark), one scores. Ranks come from a
range partitioning of the documents that can be drawn, by counts of its partitions, without a window over all rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_rows, slices, written

#: Buckets of hashed features, words of the longest feature, words of a document that can be drawn, percent drawn.
BUCKETS, RUN, LEAST_WORDS, PERCENT = 10_000, 1, 20, 10
#: Bytes that the automaton takes at once, but for words that are longer.
BLOCK = 1 << 20
#: Bytes of a word up to which all words advance together; the few longer ones go on alone.
TOGETHER = 256

_byte = np.arange(256, dtype=np.uint32)
#: A-Z become a-z; every other byte stays.
_LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of words: digits, letters and all bytes of characters beyond ASCII.
_IS_WORD = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


def _crc_table() -> np.ndarray:
    """The table of the CRC-32 with the reflected polynomial 0xEDB88320."""
    out = _byte.copy()
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out.astype(np.uint32)


_CRC = _crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each stretch of ``data``, all of them advanced together."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: those still running are a prefix
    at, length = starts[order], (ends - starts)[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    running = len(at)
    for k in range(min(TOGETHER, int(length[0]) if len(at) else 0)):
        running = int(np.searchsorted(-length[:running], -k, "left"))
        crc[:running] = _CRC[(crc[:running] ^ data[at[:running] + k]) & 0xFF] ^ (crc[:running] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > TOGETHER):
        crc[i] = zlib.crc32(data[at[i] + TOGETHER : at[i] + length[i]], int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the offset of each text; null ones are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about BLOCK bytes that end where a text does or outside of a word."""
    low, size = 0, len(data)
    while low < size:
        high = min(low + BLOCK, size)
        if high < size:
            inside = offsets[np.searchsorted(offsets, high, "right") - 1]  # the last text end up to there
            cut = int(inside) if inside > low else low
            gaps = np.flatnonzero(~_IS_WORD[_LOWER[data[max(cut, low) : high]]])
            high = max(cut, low) + int(gaps[-1]) + 1 if len(gaps) else cut
            if high <= low:  # one word fills the block: to its end
                high = min(low + BLOCK, size)
                end = int(offsets[np.searchsorted(offsets, high, "left")])
                while high < end and not len(gaps := np.flatnonzero(~_IS_WORD[_LOWER[data[high : min(high + BLOCK, end)]]])):
                    high = min(high + BLOCK, end)
                high += int(gaps[0]) if high < end else 0
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By stretches: the lower-case bytes, the starts and ends of the words in them, and the text of each word."""
    for low, high in _stretches(data, offsets):
        lower = _LOWER[data[low:high]]
        inside = _IS_WORD[lower]
        breaks = np.zeros(high - low + 1, bool)  # where a text ends, a word does
        marks = offsets[np.searchsorted(offsets, low, "left") : np.searchsorted(offsets, high, "right")] - low
        breaks[marks] = True
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | breaks[:-1]))
        ends = np.flatnonzero(inside & (~after | breaks[1:])) + 1
        yield lower, starts, ends, np.searchsorted(offsets, starts + low, "right") - 1


def _joined(data: np.ndarray, offsets: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By stretches: the text number and the CRC-32 of each feature. Runs of several words are joined by one space."""
    held: list[tuple[int, bytes]] = []  # words that runs of the next stretch begin with
    for lower, starts, ends, text in words(data, offsets):
        yield text, crc_of(lower, starts, ends)
        if run == 1 or not len(starts):
            continue
        # the words of the stretch after those held, each with one space behind it, in one buffer
        size = np.concatenate([[len(w) for _, w in held], ends - starts]).astype(np.int64)
        owner = np.concatenate([[t for t, _ in held], text]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        packed = np.full(int(begin[-1]), 32, np.uint8)
        for i, (_, w) in enumerate(held):
            packed[begin[i] : begin[i] + len(w)] = np.frombuffer(w, np.uint8)
        own = begin[len(held) : -1]
        inside = np.zeros(len(lower) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, ends, -1)
        taken = np.cumsum(inside[:-1]) > 0
        packed[np.repeat(own - starts, ends - starts) + np.flatnonzero(taken)] = lower[taken]
        for n in range(2, run + 1):
            last = np.arange(max(len(held), n - 1), len(size))  # a run counts where its last word stands
            first = last - n + 1
            last, first = last[owner[first] == owner[last]], first[owner[first] == owner[last]]
            if len(last):
                yield owner[last], crc_of(packed, begin[first], begin[last] + size[last])
        keep = range(max(0, len(size) - run + 1), len(size))
        held = [(int(owner[i]), packed[begin[i] : begin[i] + size[i]].tobytes()) for i in keep]


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Features in each bucket over all texts: one row a bucket and task is summed by Spark, ``buckets`` rows come back."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, crc in _joined(*_utf8(batch.column(0)), run):
                total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's likelihood in the target against the corpus, rounded down."""
    buckets, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)) for s, t in zip(corpus, target, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, n_features, n_words, weight of each document."""
    kind = docs.schema[id_col].dataType

    def weigh(batches):
        for batch in slices(batches):
            n = batch.num_rows
            features, weight, n_words = (np.zeros(n + 1, np.int64) for _ in range(3))
            texts = _utf8(batch.column(1))
            for text, crc in _joined(*texts, run):
                gain = np.concatenate([[0], np.cumsum(gains[crc % len(gains)])])
                at = np.searchsorted(text, np.arange(n + 1))  # features stand in the order of their texts
                features[:n] += np.diff(at)
                weight[:n] += np.diff(gain[at])
            if run == 1:
                n_words = features
            else:
                for *_, text in words(*texts):
                    n_words[:n] += np.diff(np.searchsorted(text, np.arange(n + 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x[:n], pa.int64()) for x in (features, n_words, weight))],
                ["doc_id", "n_features", "n_words", "weight"],
            )

    schema = f"doc_id {kind.simpleString()}, n_features long, n_words long, weight long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of standard Gumbel noise, from the SHA-256 of seed and id, rounded down. A null id is an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (a written table) with the rank of the documents that are drawn."""
    able = (F.col("n_words") >= least_words).alias("able")
    # a score that surely lies below the last one drawn spares most documents the sort; its count is checked
    about = F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.03), 10_000)
    n, low = scored.filter(able).agg(F.count("*"), about).first()
    drawn = percent * n // 100
    if low is None or scored.filter(able & (F.col("score") >= low)).count() < drawn:
        low = -(1 << 63)
    near = able & (F.col("score") >= low)
    # equal rows are dealt by their place in the written table, which every attempt of a task sees alike
    rows = scored.filter(near).withColumn("place", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("place")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("row", F.monotonically_increasing_id()), "dealt")
    part, row = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    before, parts = 0, []
    for p, count in sorted(dealt.groupBy(part.alias("p")).count().collect()):
        parts.append((p, before))
        before += count
    offsets = local_rows(scored.sparkSession, parts, "p long, before long")
    placed = dealt.withColumn("p", part).join(F.broadcast(offsets), "p").withColumn("rank", F.col("before") + row + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~near).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*names).unionByName(rest.select(*names))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    *,
    buckets: int = BUCKETS,
    run: int = RUN,
    seed: int = 2024,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, 3, ... by score, then id; null if not drawn) of every document.

    Null and empty texts have no features and weight 0; they are never drawn unless ``least_words`` is 0. A null id's
    noise is that of an empty text, and it comes last of equal scores. Repeated rows each count and are each ranked. An
    empty target or corpus gives its buckets equal likelihoods; empty tables give no rows. Texts of any length are
    taken in stretches of a megabyte. Other columns are ignored.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_col, buckets, run))
    scored = weighed(docs, gains, id_col, text_col, run)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    return ranked(scored, percent, least_words)
