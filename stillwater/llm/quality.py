"""Quality classifier: a factorisation machine over hashed words and structure statistics.

    y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so all pairwise interactions cost time linear in the features (the sum-of-squares identity). Features of a
document come from its whole text and its numeric metadata; the model is fitted on a bounded sample of labelled rows and shipped to
the scoring tasks; its size is fixed by DIM and RANK.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import WORD, columns, written

#: Buckets of hashed words, and rank of the interactions.
WORDS, RANK = 1 << 14, 8
#: Labelled rows that are fitted at most: those of the smallest hash of the id.
SAMPLE = 6_000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 1e-5
#: Words of which a worker remembers the bucket.
CACHE = 300_000

STATS = (
    "upper", "lower", "digit", "space", "newline", "ascii_punct", "high", "log_words", "mean_word", "unique",
    "top_word", "dup_lines", "symbol_words", "short_words", "word_length_spread", "exclaim", "run", "bias",
)
#: Numeric columns that are features, too, where a table has them: their logarithm.
META = ("n_chars",)
DIM = WORDS + len(STATS) + len(META)

_word = re.compile(WORD)
_CLASS = np.zeros(256, np.intp)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 6
_CLASS[128:] = 7


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return out


_buckets = _Buckets()


def features(text: str | None, meta: tuple[float | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text and its metadata; null counts as empty, empty texts have statistics of zero words, and
    metadata that is null, negative or not a number counts as 0."""
    text = text or ""
    words = _word.findall(text)
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=8) / max(1, len(raw))
    stats = dict(zip(("upper", "lower", "digit", "space", "newline", "ascii_punct", "high"), share[1:8]))
    stats["log_words"] = math.log1p(n) / 10
    stats["bias"] = 1.0
    if n:
        ids = np.fromiter(map(_buckets.__getitem__, words), np.int64, n)
        index, counts = np.unique(ids, return_counts=True)
        sizes = np.fromiter(map(len, words), np.int64, n)
        lines = [x for x in text.split("\n") if x.strip()]
        stats["mean_word"] = min(2.0, sizes.mean() / 10)
        stats["word_length_spread"] = min(2.0, sizes.std() / 10)
        stats["unique"] = len(set(words)) / n / (1 + math.log1p(n) / 10)
        stats["top_word"] = counts.max() / n
        stats["dup_lines"] = 1 - len(set(lines)) / max(1, len(lines))
        stats["symbol_words"] = sum(1 for w in words if not w[-1].isalnum()) / n
        stats["short_words"] = float((sizes <= 1).mean())
        stats["exclaim"] = float((raw == 33).mean()) * 5
        same = np.count_nonzero(ids[1:] == ids[:-1]) / n
        stats["run"] = same
        values = np.log1p(counts)
        values = values / np.sqrt((values**2).sum())
    else:
        index, values = np.zeros(0, np.int64), np.zeros(0)
    known = [(WORDS + i, stats.get(name, 0.0)) for i, name in enumerate(STATS)]
    known += [(WORDS + len(STATS) + i, math.log1p(min(v, 1e18)) / 12 if v is not None and v > 0 else 0.0) for i, v in enumerate(meta)]
    extra = np.array(known)
    return np.concatenate((index, extra[:, 0].astype(np.int64))), np.concatenate((values, extra[:, 1]))


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """y of each row, linear in its features."""
        starts = np.cumsum([0] + [len(i) for i, _ in rows[:-1]])
        index = np.concatenate([i for i, _ in rows])
        x = np.concatenate([v for _, v in rows])
        vx = self.v[index] * x[:, None]
        total = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[index] * x, starts) + 0.5 * (total**2 - squares).sum(1)

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))

    def scores_of(self, batch: pa.RecordBatch) -> np.ndarray:
        """The scores of a batch of inputs, a few texts' features at a time."""
        parts = (batch.slice(k, 64) for k in range(0, batch.num_rows, 64))
        return np.concatenate([np.zeros(0), *(self.scores(_features_of(p)) for p in parts)])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss, in mini-batches of a seeded order, both labels weighing alike.

    Without rows the model knows nothing and scores 0.5.
    """
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(0.0, np.zeros(DIM), rng.normal(0, 0.02, (DIM, RANK)))
    n = len(rows)
    if n == 0:
        return FactorisationMachine(0.0, np.zeros(DIM), np.zeros((DIM, RANK)))
    ones = float(labels.sum())
    # a rare label counts up to 4 times, but scores stay near probabilities of the sample
    weight = np.where(labels == 1, 1.0, min(4.0, max(1.0, ones / max(1.0, n - ones)) ** 0.5))
    gw0, gw, gv = 1e-6, np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            some = order[low : low + BATCH]
            batch = [rows[i] for i in some]
            sizes = np.array([len(i) for i, _ in batch])
            starts = np.cumsum(sizes) - sizes
            index = np.concatenate([i for i, _ in batch])
            x = np.concatenate([v for _, v in batch])
            vx = fm.v[index] * x[:, None]
            total = np.add.reduceat(vx, starts)
            y = fm.w0 + np.add.reduceat(fm.w[index] * x, starts)
            y += 0.5 * (total**2 - np.add.reduceat(vx * vx, starts)).sum(1)
            d = weight[some] * (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[some]) / len(some)
            dx = np.repeat(d, sizes) * x
            step_v = dx[:, None] * (np.repeat(total, sizes, 0) - vx)
            order_by = np.argsort(index, kind="stable")
            sorted_index = index[order_by]
            heads = np.flatnonzero(np.concatenate(([True], sorted_index[1:] != sorted_index[:-1])))
            at = sorted_index[heads]
            g = np.add.reduceat(dx[order_by], heads) + DECAY * fm.w[at]
            h = np.add.reduceat(step_v[order_by], heads) + DECAY * fm.v[at]
            gw[at] += g * g
            gv[at] += h * h
            fm.w[at] -= RATE * g / np.sqrt(gw[at])
            fm.v[at] -= RATE * 0.5 * h / np.sqrt(gv[at])
            gw0 += d.sum() ** 2
            fm.w0 -= RATE * d.sum() / math.sqrt(gw0)
    return fm


def _inputs(docs: DataFrame) -> list[Column]:
    """text and the metadata as columns m0, m1 and so on; null where the table has no numeric column of the name."""
    numbers = re.compile(r"(tinyint|smallint|int|bigint|float|double|decimal.*)")
    at = {c.lower(): col for (c, kind), col in zip(docs.dtypes, columns(docs)) if numbers.fullmatch(kind)}
    meta = [at.get(c, F.lit(None)).cast("double") for c in META]
    return [F.col("text"), *(m.alias(f"m{i}") for i, m in enumerate(meta))]


def _features_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    meta = zip(*(batch.column(f"m{i}").to_pylist() for i in range(len(META))))
    return [features(t, m) for t, m in zip(batch.column("text").to_pylist(), meta)]


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, limit: int = SAMPLE):
    """(features, labels) of the sample: labelled rows whose crc32(doc_id as text) mod folds isn't ``held``.

    Rows with a null id or label teach nothing; the smallest hashes of the id make up the sample. Of documents with
    the same id the text of the smallest digest teaches. Only features come to the driver: those of ``limit`` rows
    at most.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold != held))
        .dropDuplicates()
        .withColumn("h", F.xxhash64("doc_id"))
        .orderBy("h", "doc_id", "quality")
        .limit(limit)
        .drop("h")
    )
    picked = written(picked, "picked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _features_of(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("quality"),
                    pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32())),
                ],
                ["doc_id", "quality", "i", "x"],
            )

    # limit rows of two numbers are broadcast; copies of an id meet as their smallest within each task first
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).join(F.broadcast(picked), "doc_id")
    names = ["text", *(f"m{i}" for i in range(len(META)))]
    one = joined.groupBy("doc_id", "quality").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))), *names)).alias("r"))
    kind = "doc_id long, quality int, i array<int>, x array<float>"
    got = one.select("doc_id", "quality", "r.*").mapInArrow(run, kind).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    i, x = got.column("i").combine_chunks(), got.column("x").combine_chunks()
    rows = [(np.asarray(a.values), np.asarray(b.values).astype(float)) for a, b in zip(i, x)]
    return rows, got.column("quality").to_numpy().astype(float)


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null text: as the empty text, which has a score too. Null id: passed on, never held out. Repeated rows
    score alike; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))  # DIM * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = FactorisationMachine(*shared.value)
        for batch in batches:
            values = fm.scores_of(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), *_inputs(docs)
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows outside the held-out fold and scores all."""
    return score(docs, fit(*training_rows(docs, labels)))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns.

    Cases as for score; every copy of a row goes or stays. Without any labelled row nothing is rejected.
    """
    rows, marks = training_rows(docs, labels)
    if not rows:
        return docs
    model = fit(rows, marks)
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))
    at, given = [c.lower() for c in docs.columns].index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = FactorisationMachine(*shared.value)
        for batch in batches:
            inputs = [batch.column(at), *batch.columns[given:]]
            inputs = pa.RecordBatch.from_arrays(inputs, ["text", *(f"m{i}" for i in range(len(META)))])
            kept = pa.RecordBatch.from_arrays(batch.columns[:given], schema=pa.schema(list(batch.schema)[:given]))
            yield kept.filter(pa.array(fm.scores_of(inputs) >= threshold))

    # by number, as Python workers take no dots or backticks in names
    names = [f"c{i}" for i in range(given)]
    rows = docs.select(*(c.alias(n) for c, n in zip(columns(docs), names)), *_inputs(docs)[1:])
    kind = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema)])
    return rows.mapInArrow(run, kind).toDF(*docs.columns)
