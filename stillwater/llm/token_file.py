"""Token ids in binary shards, compressed by Re-Pair.

Documents in ascending id order are encoded, end id appended, and cut into shards. In each shard frequent
pairs of ids are replaced by nonterminals, round after round, every pair of a round at all its places that
don't overlap, until none is frequent. A shard stores its rules, the expansion length of each nonterminal and, by document, the
number of ids and the place in the compressed sequence, so any document, or any stretch of one, is decoded
without the rest.

File: header (magic, documents, rules, symbols), then document ids with a null flag, id counts and
sequence places by document, rules (two symbols each), expansion lengths, the sequence. Little-endian.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, shared_dir, shuffle_partitions

#: Ids after which a partition starts its next shard; a document is never split.
SHARD_IDS = 1 << 20
#: First nonterminal; symbols are 16 bits, so a shard has up to 2**16 less this many rules.
FIRST_RULE = 50_257
#: Occurrences from which a pair is replaced, and pairs that a round replaces at most. A round takes pairs at least a
#: sixteenth as frequent as its most frequent one, so rarer pairs are counted anew once frequent ones are gone.
LEAST_COUNT, RULES_A_ROUND, SHARE = 8, 3_500, 16
#: Pieces of text of which a worker remembers the ids; bytes of text that are encoded side by side.
CACHE, SIDE = 800_000, 16 << 20

_MAGIC = b"RPT1"
_HEAD = struct.Struct("<4sIIQ")
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _stretches(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one after the other."""
    ends = np.cumsum(length)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begin - ends + length).astype(kind), length)
    at += np.arange(n, dtype=kind)
    return flat[at]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint16, int(length.sum())), length


class Encoder:
    """Exact encodings by the tokenizers library; every distinct piece of text is encoded once and remembered.

    The byte-level pattern ends a match before a single space that precedes a non-space, and around a single line
    break between non-spaces, so texts are cut there. A run of letters, and a run of ASCII punctuation after
    it, are matches of their own, which the tokenizer's model encodes without its pipeline. Texts with the mark of
    special tokens, or a tokenizer of another kind, go whole. Pieces are told apart, looked up and put together in
    arrays; Python meets new runs of letters only.
    """

    _cut = re.compile(r" (?=\S)|(?<=\S)\n(?=\S)")
    #: two white space characters side by side
    _wide = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]{2}"
    #: a run of letters, in the range where all agree on what a letter is, after a space or not
    _letters = "^ ?[A-Za-z\\x{aa}\\x{b5}\\x{ba}\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]+$"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > FIRST_RULE:
            raise ValueError(f"ids from {FIRST_RULE} on are the shards' nonterminals; the vocabulary has more")
        before = self.tokenizer.pre_tokenizer
        before = json.loads(before.__getstate__()) if before else {}
        self.cuts = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not self.tokenizer.normalizer
            and not self.tokenizer.truncation
        )
        # the letters that stand for bytes in the vocabulary: printable ones for themselves, the rest from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.stands = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        # known pieces; where their ids begin in flat, and how many they are
        self.known = pa.array([], pa.string())
        self.begin, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _add(self, pieces: pa.Array, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The places among the known of new pieces, and their ids."""
        first = len(self.known)
        self.begin = np.append(self.begin, len(self.flat) + np.cumsum(length) - length)
        self.length, self.flat = np.append(self.length, length), np.append(self.flat, flat)
        self.known = pa.concat_arrays([self.known, pieces])
        return np.arange(first, len(self.known))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _words(self, words: pa.Array) -> np.ndarray:
        """Places of distinct runs of letters."""
        at = self._places(words)
        new = np.flatnonzero(at < 0)
        tokenize, stands, ids, some = self.tokenizer.model.tokenize, self.stands, [], words.take(pa.array(new))
        for word in some.to_pylist():
            if word.isascii():
                word = stands[32] + word[1:] if word[0] == " " else word
            else:
                word = "".join(map(stands.__getitem__, word.encode()))
            ids.append([t.id for t in tokenize(word)])
        at[new] = self._add(some, *_flat(ids))
        return at

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct new pieces: runs of letters with what punctuation follows, and others."""
        out = np.zeros(len(pieces), np.int64)
        words = pc.utf8_rtrim(pieces, characters=_PUNCTUATION)
        tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(words)).to_numpy()
        plain = pc.match_substring_regex(words, self._letters).to_numpy(zero_copy_only=False) & (tail < 8)
        table = words.filter(pa.array(plain)).dictionary_encode()
        at = out[plain] = self._words(table.dictionary)[table.indices.to_numpy()]
        marked = np.flatnonzero(plain & (tail > 0))
        if len(marked):
            at, tail = at[tail[plain] > 0], tail[marked]
            some = pieces.take(pa.array(marked))
            # the run of punctuation, up to 7 bytes before each piece's end, as a number
            raw = np.concatenate((np.zeros(8, np.uint8), np.frombuffer(some.buffers()[2], np.uint8)))
            ends = np.frombuffer(some.buffers()[1], np.int32)[1 : len(some) + 1].astype(np.int64) + 8
            runs = np.zeros(len(some), np.int64)
            for k in range(1, 8):
                runs = np.where(k <= tail, runs * 256 + raw[ends - np.maximum(tail - k + 1, 1)], runs)
            runs, of = np.unique(runs, return_inverse=True)
            ids = [self.tokenizer.encode(int(r).to_bytes(8, "big").lstrip(b"\0").decode(), add_special_tokens=False).ids for r in runs]
            marks, sizes = _flat(ids)
            places = len(self.flat) + np.cumsum(sizes) - sizes
            begin, length = (np.stack(c, 1).ravel() for c in ((self.begin[at], places[of]), (self.length[at], sizes[of])))
            flat = _stretches(np.append(self.flat, marks), begin, length)
            out[marked] = self._add(some, flat, self.length[at] + sizes[of])
        others = pieces.filter(pa.array(~plain))
        if len(others):
            got = self.tokenizer.encode_batch(others.to_pylist(), add_special_tokens=False)
            out[~plain] = self._add(others, *_flat([g.ids for g in got]))
        return out

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 16-bit integers."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring(texts, "\0"))
        if not self.cuts:
            whole = pa.array(np.ones(len(texts), bool))
        wide = pc.match_substring_regex(texts, self._wide)
        plain = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0")
        odd = np.flatnonzero(np.asarray(pc.or_(whole, wide))).tolist()
        apart: dict[int, bytes] = {}
        if odd:
            cut = plain.to_pylist()
            for i in odd:
                text = texts[i].as_py()
                if whole[i].as_py():
                    apart[i], cut[i] = self.encode_whole(text), ""
                else:
                    cut[i] = self._cut.sub(lambda m: "\0 " if m[0] == " " else "\0\n\0", text)
            plain = pa.array(cut, pa.string())
        split = pc.split_pattern(plain, "\0")
        table = split.flatten().dictionary_encode()
        pieces, index = table.dictionary, table.indices.to_numpy()
        at = self._places(pieces)
        new = at < 0
        if new.any():
            if len(self.known) > CACHE:  # keep those that this batch needs
                held = at[~new]
                self.known, flat = self.known.take(pa.array(held)), _stretches(self.flat, self.begin[held], self.length[held])
                self.flat, self.length = flat, self.length[held]
                self.begin = np.cumsum(self.length) - self.length
                at[~new] = np.arange(len(held))
            at[new] = self._learn(pieces.filter(pa.array(new)))
        at = at[index]
        sizes = self.length[at]
        out = _stretches(self.flat, self.begin[at], sizes).astype("<u2").tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        edges = (2 * ends[np.asarray(split.offsets) - split.offsets[0].as_py()]).tolist()
        return [apart[i] if i in apart else out[a:b] for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0]


def re_pair(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, sequence, starts in the sequence): pairs never reach over a document's start.

    Rounds follow until no pair occurs LEAST_COUNT times or the symbols run out.
    """
    sequence, rules, made = ids.astype(np.uint32), [], 0
    barrier = np.zeros(len(sequence) + 1, bool)
    barrier[starts] = True
    none = np.uint32(0xFFFFFFFF)  # a pair of the last symbol, which comes into being in the last round
    held, number = np.full(1 << 18, none), np.zeros(1 << 18, np.uint16)
    recent = 0  # once all frequent pairs of a round are replaced, only pairs with a newer symbol can be frequent
    while len(sequence) > 1 and made < (1 << 16) - FIRST_RULE:
        pairs = (sequence[:-1] << 16) | sequence[1:]
        inside = ~barrier[1 : len(sequence)]
        if recent:
            new = sequence >= recent
            inside &= new[:-1] | new[1:]
        ordered = np.sort(pairs[inside])
        cuts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(cuts, len(ordered)))
        if not len(ordered) or (most := int(counts.max())) < LEAST_COUNT:
            break
        least = max(LEAST_COUNT, most // SHARE)
        often = np.flatnonzero(counts >= least)
        often = often[np.argsort(-counts[often], kind="stable")]
        chosen = ordered[cuts[often]]
        slot = (chosen * np.uint32(2654435761)) >> np.uint32(14)
        _, best = np.unique(slot, return_index=True)  # of pairs in one slot the rarer wait for the next round
        chosen = chosen[np.sort(best)][: min(RULES_A_ROUND, (1 << 16) - FIRST_RULE - made)]
        recent = FIRST_RULE + made if least == LEAST_COUNT and len(chosen) == len(often) else 0
        slot = (chosen * np.uint32(2654435761)) >> np.uint32(14)
        held[slot], number[slot] = chosen, FIRST_RULE + made + np.arange(len(chosen))
        at = (pairs * np.uint32(2654435761)) >> np.uint32(14)
        found = np.flatnonzero((held[at] == pairs) & inside)
        # of touching pairs take every other, from the left
        fresh = np.concatenate(([True], np.diff(found) > 1))
        found = found[(found - found[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
        rules.append(np.stack([chosen >> 16, chosen & 0xFFFF], 1))
        made += len(chosen)
        sequence[found] = number[at[found]]
        held[slot] = none
        stay = np.ones(len(sequence), bool)
        stay[found + 1] = False
        barrier = np.append(barrier[:-1][stay], barrier[-1])
        sequence = sequence[stay]
    places = np.flatnonzero(barrier[:-1])
    rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return rules.astype("<u2"), sequence.astype("<u2"), places


def lengths_of(rules: np.ndarray) -> np.ndarray:
    """Expansion lengths of all symbols up to the last rule."""
    lengths = np.ones(FIRST_RULE + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[FIRST_RULE + i] = lengths[a] + lengths[b]
    return lengths


def pack_shard(doc_ids: list[int | None], encoded: list[bytes]) -> bytes:
    """A shard of documents; ``encoded`` are their ids with the end id, 16 bits each."""
    counts = np.array([len(e) // 2 for e in encoded], "<u4")
    starts = np.concatenate(([0], np.cumsum(counts[:-1], dtype=np.int64))).astype(np.int64)
    rules, sequence, places = re_pair(np.frombuffer(b"".join(encoded), "<u2"), starts)
    lengths = lengths_of(rules)[FIRST_RULE:].astype("<u4")
    return b"".join(
        (
            _HEAD.pack(_MAGIC, len(doc_ids), len(rules), len(sequence)),
            np.array([i is None for i in doc_ids], np.uint8).tobytes(),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            counts.tobytes(),
            places.astype("<u8").tobytes(),
            rules.tobytes(),
            lengths.tobytes(),
            sequence.tobytes(),
        )
    )


class Shard:
    """A shard, from which documents are decoded one by one. Its bytes, or an open file, of which the tables are read
    once and of the sequence only what is asked for."""

    def __init__(self, raw):
        if isinstance(raw, bytes):
            raw = pa.BufferReader(raw)
        magic, docs, rules, symbols = _HEAD.unpack(raw.read_at(_HEAD.size, 0))
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        sizes = (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u8", docs), ("<u2", 2 * rules), ("<u4", rules))
        self.source, self.symbols = raw, symbols
        self.at = _HEAD.size + sum(np.dtype(kind).itemsize * n for kind, n in sizes)
        tables, at, got = raw.read_at(self.at - _HEAD.size, _HEAD.size), 0, []
        for kind, n in sizes:
            got.append(np.frombuffer(tables, kind, n, at))
            at += got[-1].nbytes
        null, ids, self.counts, places, self.rules, lengths = got
        self.doc_ids = [None if z else i for z, i in zip(null.tolist(), ids.tolist())]
        self.places, self.rules = np.append(places.astype(np.int64), symbols), self.rules.reshape(-1, 2)
        self.lengths = np.concatenate((np.ones(FIRST_RULE, np.int64), lengths.astype(np.int64)))
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.flat = np.empty(int(self.lengths.sum()), "<u4")
        self.flat[:FIRST_RULE] = np.arange(FIRST_RULE)
        flat, begin, end = self.flat, self.begin, self.begin + self.lengths
        for i, (a, b) in enumerate(self.rules.tolist(), FIRST_RULE):
            middle = begin[i] + self.lengths[a]
            flat[begin[i] : middle] = flat[begin[a] : end[a]]
            flat[middle : end[i]] = flat[begin[b] : end[b]]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.lengths[symbols]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.begin[symbols] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def _symbols(self, k: int) -> np.ndarray:
        low, high = self.places[k], self.places[k + 1]
        return np.frombuffer(self.source.read_at(int(2 * (high - low)), int(self.at + 2 * low)), "<u2")

    def document(self, k: int) -> np.ndarray:
        """All ids of document k of the shard."""
        return self.expand(self._symbols(k))

    def documents(self, side: int = 1 << 18) -> Iterator[np.ndarray]:
        """All ids of every document in turn; stretches of about ``side`` symbols are expanded at once."""
        low, n = 0, len(self.counts)
        while low < n:
            high = max(low + 1, int(np.searchsorted(self.places, self.places[low] + side, "right")) - 1)
            at, end = self.places[low], self.places[high]
            raw = self.source.read_at(int(2 * (end - at)), int(self.at + 2 * at))
            yield from np.split(self.expand(np.frombuffer(raw, "<u2")), np.cumsum(self.counts[low : high - 1].astype(np.int64)) if high - low > 1 else [])
            low = high

    def stretch(self, k: int, low: int, high: int) -> np.ndarray:
        """Ids low to high of document k: only the symbols over them are expanded."""
        symbols = self._symbols(k)
        ends = np.cumsum(self.lengths[symbols])
        first = int(np.searchsorted(ends, low, "right"))
        last = int(np.searchsorted(ends, high, "left")) + 1
        skipped = int(ends[first - 1]) if first else 0
        return self.expand(symbols[first:last])[low - skipped : high - skipped]


_encoders: dict[str, Encoder] = {}


def _encode(path: str, base: str, end_id: int):
    kind = pa.schema([("shard", pa.string()), ("pid", pa.int32()), ("part", pa.int32()), ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        task, end = TaskContext.get(), struct.pack("<H", end_id)
        store, root = pafs.FileSystem.from_uri(base)
        docs, encoded, held, part = [], [], 0, 0

        def close() -> pa.RecordBatch:
            # each attempt has names of its own; the table of shards lists those of the one that succeeded
            name = f"{task.partitionId():06d}-{part:05d}-{task.taskAttemptId()}.ids"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
                sink.write(pack_shard(docs, encoded))
            values = (f"{base}/{name}", task.partitionId(), part, held)
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, kind)], schema=kind)

        for batch in by_bytes(batches, "text", SIDE):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.batch(batch.column("text"))):
                docs.append(doc_id)
                encoded.append(ids + end)
                held += len(ids) // 2 + 1
                if held >= SHARD_IDS:
                    yield close()
                    docs, encoded, held, part = [], [], 0, part + 1
        if docs:
            yield close()

    return run


def write_shards(
    df: DataFrame, base: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> DataFrame:
    """Shards under ``base`` in ascending id order; a table of them: shard, pid, part, ids.

    Null text: only the end id. Null ids come first; repeated rows are documents of their own. Empty table:
    no shards. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    kind = "shard string, pid int, part int, ids long"
    rows.mapInArrow(_encode(tokenizer, base, end_id), kind).write.parquet(f"{base}/shards")
    return df.sparkSession.read.schema(kind).parquet(f"{base}/shards")


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
            store, name = pafs.FileSystem.from_uri(path)
            with store.open_input_file(name) as source:
                shard = Shard(source)
                n, crc = [], []
                for ids in shard.documents():
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids))
            at = start + np.cumsum(n) - np.array(n)
            yield pa.record_batch(
                [pa.array(c, f.type) for c, f in zip((shard.doc_ids, at, n, crc), _DOCS)], schema=_DOCS
            )


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``shards``."""
    # ids before each partition, over a row a partition, then before each of its shards
    before = lambda order: F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("pid").agg(F.sum("ids").alias("ids"))
    parts = parts.select(F.col("pid").alias("of"), before(Window.orderBy("pid")).alias("first"))
    placed = shards.withColumn("start", before(Window.partitionBy("pid").orderBy("part")))
    placed = placed.join(F.broadcast(parts), F.col("pid") == F.col("of"))  # a row for each writing task
    placed = placed.select("shard", (F.col("first") + F.col("start")).cast("long").alias("start"))
    n = shuffle_partitions(shards.sparkSession)
    return placed.repartition(n, "shard").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(df: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Every document written to shards and decoded from them."""
    base = shared_dir(df.sparkSession)
    return read_shards(write_shards(df, f"{base}/tokens", tokenizer, end_id=end_id))
