"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by the scaled forward recursion.

Words are counted over all training documents. The most frequent words are emission classes of their own; all
others fall into classes by their ending, and within a class have probability (c + 1) / (sum of c + words + 1),
the last one for unknown words. So the states' tables are bounded, and every count still matters:

    P(text) = P(class sequence) * product of P(word | its class)

The states start at random around the corpus's frequencies. Training documents are dealt into blocks by a hash; a
round gathers the expected counts of one block, added up by class across partitions, puts them in place of that
block's former counts and maximises over the counts of all (incremental Baum-Welch, whose likelihood rises as that of
whole rounds does, in fewer passes). Passes over all blocks follow until the likelihood gains little. Counts of words
outside a bounded table in the workers are joined to the documents by a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, shared_dir, shuffle_partitions, written

#: Latent states, words with a class of their own, classes by ending (of so many bytes), words in the workers' table.
STATES, OWN, ENDINGS, ENDING, TABLE = 8, 16_384, 1_024, 3, 131_072
#: Blocks of training documents, and the gain, as a share of a pass's log likelihood, below which no pass follows.
BLOCKS, GAIN = 16, 1e-2
#: Tokens of prior that each state's table has, at the corpus's frequencies; and of each transition.
PRIOR, STAY = 200.0, 1.0
#: Distinct words after which a task hands on its counts; tokens worked on side by side, texts side by side, and
#: steps after which the forward and backward values are scaled.
FLUSH, SIDE, WIDE, SCALE = 200_000, 200_000, 512, 8
#: Bytes of text that are split into tokens at once.
BYTES = 4 << 20
#: The end of a text, a token that no word equals.
END = b""


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A to Z lower-cased, as one array, and how many each text has; without the ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = lists.flatten(), np.asarray(lists.offsets)
    there = np.asarray(pc.greater(pc.binary_length(words), 0))  # white space at either end leaves empty ones
    before = np.concatenate(([0], np.cumsum(there)))
    return words.filter(pa.array(there)), np.diff(before[offsets - offsets[0]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def emit() -> pa.RecordBatch:
        out = pa.record_batch(
            [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "c"]
        )
        held.clear()
        return out

    for batch in by_bytes(batches, "text", BYTES):
        words, sizes = split(batch.column("text"))
        got = pc.value_counts(words)
        for word, n in zip(got.field(0).cast(pa.binary()).to_pylist(), got.field(1).to_pylist()):
            held[word] += n
        held[END] += len(sizes)
        if len(held) >= FLUSH:
            yield emit()
    if held:
        yield emit()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % ENDINGS


def _endings(own: set[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                if word not in own:
                    j = ending(word)
                    c[j] += n
                    v[j] += 1
        at = np.flatnonzero(v)
        yield pa.record_batch([pa.array(at), pa.array(c[at]), pa.array(v[at])], names=["j", "c", "v"])

    return run


@dataclass
class Lexicon:
    """words of the table by descending count; the first ``own`` are classes of their own."""

    words: list[bytes]
    counts: np.ndarray
    own: int
    total: int
    distinct: int
    class_count: np.ndarray  # tokens by class
    class_words: np.ndarray  # distinct words by class, one more for unknown ones in classes by ending

    @property
    def classes(self) -> int:
        return self.own + ENDINGS

    def unigram(self) -> np.ndarray:
        p = self.class_count + self.class_words.astype(float)
        return p / p.sum()


def _table(counts: DataFrame) -> DataFrame:
    """The TABLE most frequent words; of those as frequent as the last ones, whole buckets of their hashes that fit."""
    held, least, rest = 0, 0, 0
    for c, n in counts.groupBy("c").count().orderBy(F.desc("c")).limit(TABLE).collect():
        if held + n > TABLE:
            least, rest = c, TABLE - held
            break
        held += n
    if not rest:
        return counts.filter(F.col("c") > least)
    bucket = F.pmod(F.xxhash64("word"), F.lit(4096))
    first = 4096
    for h, n in counts.filter(F.col("c") == least).groupBy(bucket.alias("h")).count().orderBy("h").collect():
        if n > rest:
            first = h
            break
        rest -= n
    return counts.filter((F.col("c") > least) | (F.col("c") == least) & (bucket < first))


def lexicon(counts: DataFrame) -> Lexicon:
    """From (word, c) over all training documents; only the table's words and the endings reach the driver."""
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    rows = _table(counts).toArrow()
    pairs = sorted(zip(rows.column("c").to_pylist(), rows.column("word").to_pylist()), key=lambda p: (-p[0], p[1]))
    words, number = [w for _, w in pairs], np.array([c for c, _ in pairs], np.int64)
    own = min(OWN, len(words))
    c, v = np.zeros(own + ENDINGS, np.int64), np.zeros(own + ENDINGS, np.int64)
    c[:own] = number[:own]
    v[own:] = 1
    sums_of = counts.mapInArrow(_endings(set(words[:own])), "j long, c long, v long")
    for j, n, k in sums_of.groupBy("j").agg(F.sum("c"), F.sum("v")).collect():
        c[own + j] += n
        v[own + j] += k
    return Lexicon(words, number, own, sums[0] or 0, sums[1], c, v)


def _encode(shared):
    """The kept columns, n_tokens, n_known, known_log and shared_log (sums of log10(c + 1) over words of the table,
    over those in classes by ending), ids and the words outside the table with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex: Lexicon = shared.value
        table = pa.array(lex.words, pa.binary())
        cls = np.array([i if i < lex.own else lex.own + ending(w) for i, w in enumerate(lex.words)] + [0], np.int32)
        logs = np.append(np.log10(lex.counts + 1.0), 0.0)
        end = lex.words.index(END) if END in lex.words else -1
        end_class = cls[end] if end >= 0 else lex.own + ending(END)
        for batch in by_bytes(batches, "text", BYTES):
            words, sizes = split(batch.column("text"))
            n, coded = len(sizes), words.dictionary_encode()
            distinct, index = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
            at = pc.fill_null(pc.index_in(distinct, value_set=table), -1).to_numpy(zero_copy_only=False)
            of = cls[at]
            new = np.flatnonzero(at < 0)
            of[new] = [lex.own + ending(w) for w in distinct.take(pa.array(new)).to_pylist()]
            at = at[index]
            doc = np.repeat(np.arange(n), sizes)
            known = logs[at]
            inside = at >= lex.own
            # the ids of each text, then the end's
            ends = np.cumsum(sizes + 1)
            ids, word = np.full(int(ends[-1]) if n else 0, end_class, np.int32), np.ones(int(ends[-1]) if n else 0, bool)
            word[ends - 1] = False
            ids[word] = of[index]
            rare = np.flatnonzero(at < 0)
            pairs, times = np.unique(doc[rare] * max(1, len(distinct)) + index[rare], return_counts=True)
            owner, which = pairs // max(1, len(distinct)), pairs % max(1, len(distinct))
            cuts = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
            made = {
                "n_tokens": pa.array(sizes + 1),
                "n_known": pa.array(sizes - np.bincount(doc[rare], minlength=n) + (end >= 0)),
                "known_log": pa.array(np.bincount(doc, known, n) + logs[end]),
                "shared_log": pa.array(np.bincount(doc[inside], known[inside], n) + (logs[end] if end >= lex.own else 0.0)),
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids)),
                "rare": pa.ListArray.from_arrays(cuts, distinct.take(pa.array(which))),
                "rare_n": pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
            }
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made.values()], [*kept, *made])

    return run


@dataclass
class Markov:
    start: np.ndarray  # (K,)
    step: np.ndarray  # (K, K)
    emit: np.ndarray  # (M, K): probability of the class in the state

    def side_by_side(self, ids: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(which, lengths, padded ids by step) of sequences of like length, longest first."""
        order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
        low = 0
        while low < len(order):
            longest = len(ids[order[low]])
            some = order[low : low + max(1, min(WIDE, SIDE // longest))]
            low += len(some)
            grid = np.zeros((longest, len(some)), np.int32)
            for column, i in enumerate(some):
                grid[: len(ids[i]), column] = ids[i]
            yield some, np.array([len(ids[i]) for i in some]), grid

    def _forward(self, grid: np.ndarray, active: np.ndarray, low: int, enter: np.ndarray | None, log: np.ndarray):
        """(emission probabilities, forward values) of a stretch of steps from ``low`` on; adds scales' logs to ``log``."""
        emitted, values = self.emit[grid], np.zeros((*grid.shape, len(self.start)))
        for t in range(len(grid)):
            a, at = active[low + t], values[t]
            if low + t == 0:
                np.multiply(self.start, emitted[0], out=at)
            else:
                np.matmul((values[t - 1] if t else enter)[:a], self.step, out=at[:a])
                at[:a] *= emitted[t, :a]
            if (low + t) % SCALE == 0:
                s = at[:a].sum(1)
                at[:a] /= s[:, None]
                log[:a] += np.log(s)
        return emitted, values

    def forward(self, lengths: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """Natural log likelihoods, by the forward recursion; a stretch of steps is held at a time."""
        n = len(lengths)
        active = np.searchsorted(-lengths, -np.arange(len(grid)), "left")  # sequences longer than each step
        log, enter, per = np.zeros(n), None, max(1, SIDE // n)
        for low in range(0, len(grid), per):
            _, values = self._forward(grid[low : low + per], active, low, enter, log)
            done = np.flatnonzero((lengths > low) & (lengths <= low + per))
            log[done] += np.log(values[lengths[done] - 1 - low, done].sum(1))
            enter = values[-1].copy()
        return log

    def expected(self, ids: list[np.ndarray]):
        """Expected counts (start, step, emit) over sequences."""
        return self.expected_and_log(ids)[:3]

    def expected_and_log(self, ids: list[np.ndarray]):
        """Expected counts and the natural log likelihood of all sequences.

        Values of SIDE tokens are held at a time: of longer sequences only those between stretches, from which the
        way back computes a stretch's values again.
        """
        k, m = len(self.start), len(self.emit)
        start, step, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros((m, k)), 0.0
        back = np.ascontiguousarray(self.step.T)
        for _, lengths, grid in self.side_by_side(ids):
            n = len(lengths)
            active = np.append(np.searchsorted(-lengths, -np.arange(len(grid)), "left"), 0)
            per = max(1, SIDE // n)
            lows, enters, log = list(range(0, len(grid), per)), [None], np.zeros(n)
            for low in lows:
                emitted, alpha = self._forward(grid[low : low + per], active, low, enters[-1], log)
                done = np.flatnonzero((lengths > low) & (lengths <= low + per))
                log[done] += np.log(alpha[lengths[done] - 1 - low, done].sum(1))
                enters.append(alpha[-1].copy() if low != lows[-1] else None)
            total += float(log.sum())
            after = None  # what the step after the stretch passes back
            for i, low in reversed(list(enumerate(lows))):
                part = grid[low : low + per]
                if low != lows[-1]:
                    emitted, alpha = self._forward(part, active, low, enters[i], np.zeros(n))
                size = len(part)
                beta, passed, scale = np.ones((size, n, k)), np.empty((size, n, k)), np.ones((size, n))
                for t in range(size - 1, -1, -1):
                    a = active[low + t + 1]
                    if not a:
                        continue
                    if t + 1 < size:
                        np.multiply(emitted[t + 1, :a], beta[t + 1, :a], out=passed[t, :a])
                    else:
                        passed[t, :a] = after[:a]
                    np.matmul(passed[t, :a], back, out=beta[t, :a])
                    if (low + t) % SCALE == 0:
                        s = scale[t, :a] = beta[t, :a].sum(1)
                        beta[t, :a] /= s[:, None]
                after = emitted[0] * beta[0]
                # stretches of steps that stay in the processor's memory
                few = max(1, 16_384 // n)
                for t in range(0, size, few):
                    at = low + np.arange(t, min(size, t + few))
                    inside = (at[:, None] < lengths[None, :]).ravel()
                    goes_on = (at[:, None] < lengths[None, :] - 1).ravel()
                    a = alpha[t : t + few].reshape(-1, k)
                    weight = a * beta[t : t + few].reshape(-1, k)
                    z = weight.sum(1)
                    weight = np.ascontiguousarray((weight[inside] / z[inside, None]).T)
                    flat = part[t : t + few].ravel()[inside]
                    for s in range(k):
                        emit[:, s] += np.bincount(flat, weight[s], m)
                    if low + t == 0:
                        start += weight[:, :n].sum(1)
                    z *= scale[t : t + few].ravel()
                    step += (a[goes_on] / z[goes_on, None]).T @ passed[t : t + few].reshape(-1, k)[goes_on]
        return start, step * self.step, emit, total


def maximised(start: np.ndarray, step: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Markov:
    start, step = start + 1.0, step + STAY
    emit = emit + PRIOR * unigram[:, None]
    return Markov(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def first_states(unigram: np.ndarray, seed: int = 5) -> Markov:
    """Seeded random states that tend to stay."""
    rng = np.random.default_rng(seed)
    k = STATES
    emit = unigram[:, None] * rng.uniform(0.5, 1.5, (len(unigram), k))
    return Markov(np.full(k, 1 / k), np.full((k, k), 0.3 / k) + 0.7 * np.eye(k), emit / emit.sum(0))


def _arrays(column) -> list[np.ndarray]:
    values, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _gather(shared):
    """Expected counts of a partition, a row for each class met; steps, starts and the log likelihood (in the first
    column) as classes -1 - i, -100 and -200."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Markov = shared.value
        k = len(model.start)
        start, step, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), np.zeros(k)
        for batch in batches:
            got = model.expected_and_log(_arrays(batch.column("ids")))
            start += got[0]
            step += got[1]
            emit += got[2]
            log[0] += got[3]
        met = np.flatnonzero(emit.sum(1))
        cls = np.concatenate(([-200, -100], -1 - np.arange(k), met))
        table = np.concatenate((log[None], start[None], step, emit[met]))
        yield pa.record_batch([pa.array(cls), *[pa.array(table[:, s]) for s in range(k)]], names=["m", *[f"s{s}" for s in range(k)]])

    return run


def expected_counts(encoded: DataFrame, model: Markov) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, step, emit) and the log likelihood of all rows of ``encoded`` (ids)."""
    k = len(model.start)
    shared = encoded.sparkSession.sparkContext.broadcast(model)  # classes * STATES numbers
    names = [f"s{s}" for s in range(k)]
    kind = "m long, " + ", ".join(f"{s} double" for s in names)
    rows = encoded.select("ids").mapInArrow(_gather(shared), kind)
    got = rows.groupBy("m").agg(*[F.sum(s).alias(s) for s in names]).toArrow()
    shared.unpersist()
    m, table = got.column("m").to_numpy(), np.stack([got.column(s).to_numpy() for s in names], 1)
    emit = np.zeros_like(model.emit)
    emit[m[m >= 0]] = table[m >= 0]
    step = np.zeros((k, k))
    low = (m < 0) & (m > -100)
    step[-1 - m[low]] = table[low]
    return table[m == -100].sum(0), step, emit, float(table[m == -200].sum())


def train(expected, blocks: int, unigram: np.ndarray, gain: float = GAIN) -> Markov:
    """Incremental Baum-Welch. expected(block, model): the block's expected counts and log likelihood."""
    model, last = first_states(unigram), -np.inf
    held: list[tuple | None] = [None] * blocks
    while True:
        log = 0.0
        for block in range(blocks):
            *held[block], more = expected(block, model)
            log += more
            model = maximised(*(sum(h[i] for h in held if h) for i in range(3)), unigram)
        if log - last <= gain * abs(log):
            return model
        last = log


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lex_own, denominators = shared.value
        for batch in batches:
            ids = _arrays(batch.column("ids"))
            log = np.zeros(len(ids))
            for some, lengths, grid in model.side_by_side(ids):
                log[some] = model.forward(lengths, grid)
            log /= np.log(10)
            inside = np.array([denominators[i[i >= lex_own] - lex_own].sum() for i in ids])
            keep = [batch.column(k) for k in ("rid", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "shared_log")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(log - inside)],
                ["rid", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "shared_log", "class_log"],
            )

    return run


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32(doc_id as text) mod folds is ``held`` teach nothing. Null text: only the end. Null id: never
    held out. Repeated rows count and score as often as they stand. Empty table: no rows; nothing to learn from:
    one probability for all unknown words. Other columns are ignored.
    """
    spark = df.sparkSession
    fold = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % folds
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(fold == held, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    counted = rows.filter(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, c long")
    counts = written(counted.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    lex = lexicon(counts)
    unigram = lex.unigram()
    shared = spark.sparkContext.broadcast(lex)  # TABLE words and their counts
    kind = (
        "rid long, doc_id long, held_out boolean, block int, n_tokens long, n_known long, known_log double, "
        "shared_log double, ids array<int>, rare array<binary>, rare_n array<int>"
    )
    # held-out rows are a block of their own; each block is spread evenly over the tasks
    block = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64("doc_id", "text"), F.lit(BLOCKS))).cast("int")
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", block.alias("block"), "text")
    n = shuffle_partitions(spark)
    spread = F.pmod(F.xxhash64("rid"), F.lit(max(1, 4 * n // BLOCKS)))
    dealt = numbered.mapInArrow(_encode(shared), kind).repartition(n, "block", spread)
    base = f"{shared_dir(spark)}/encoded"
    dealt.write.partitionBy("block").parquet(base)
    encoded = spark.read.schema(kind.replace("block int, ", "") + ", block int").parquet(base)
    there = {r[0] for r in encoded.select("block").distinct().collect()} - {-1}
    parts = [encoded.filter(F.col("block") == b) for b in sorted(there)]
    model = train(lambda b, now: expected_counts(parts[b], now), len(parts), unigram) if parts else first_states(unigram)

    denominators = np.log10((lex.class_count + lex.class_words)[lex.own :].astype(float))
    parts = spark.sparkContext.broadcast((model, lex.own, denominators))
    scored = encoded.drop("rare", "rare_n", "block").mapInArrow(
        _score(parts),
        "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, shared_log double, class_log double",
    )
    rare = encoded.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("r")).select(
        "rid", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("times")
    )
    c = F.coalesce("c", F.lit(0))
    rare = (
        rare.join(counts, "word", "left")
        .groupBy("rid")
        .agg(
            F.sum(F.col("times") * F.log10(c + 1)).alias("rare_log"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    return _combined(scored, rare, lex)


def _combined(scored: DataFrame, rare: DataFrame, lex: Lexicon) -> DataFrame:
    all_logs = F.col("known_log") + F.coalesce("rare_log", F.lit(0.0))
    base = float(np.log10(lex.total + lex.distinct + 1.0))
    return scored.join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (all_logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("class_log") + F.col("shared_log") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )
