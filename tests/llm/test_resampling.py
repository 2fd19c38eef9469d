import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.cases import awkward

from stillwater.llm import resampling as R

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def expected(docs, target, run=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) by the rules, a word at a time."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, run)[1])
    t = Counter(bucket(f) for x in target for f in features(x, run)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text, run)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = percent * len(able) // 100
    return Counter((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)) + Counter((*r[:4], None) for r in rows if not r[4])


def test_automaton(monkeypatch):
    rng = random.Random(1)
    parts = ["word", "Zé", "漢字", "\U0001f600", "x" * 300, "9a", " ", "\n", "--", "\x00", "A", "{", "`", "ÄB"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(200)] + [None, "", "  ", "z" * 5_000, "end"]
    data, offsets = R._utf8(pa.array(texts).slice(3))
    for block in (1 << 20, 64, 7):
        monkeypatch.setattr(R, "BLOCK", block)
        for run in (1, 2, 3):
            got = Counter()
            for text, crc in R._joined(data, offsets, run):
                got.update(zip(text.tolist(), crc.tolist(), strict=True))
            assert got == Counter((k, zlib.crc32(f.encode())) for k, t in enumerate(texts[3:]) for f in features(t, run)[1])
    assert R._joined(*R._utf8(pa.array([None, ""], pa.string())), 1) and not list(R.words(*R._utf8(pa.array([], pa.string()))))
    assert R.crc_of(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9])).tolist() == [0xCBF43926]


@pytest.mark.parametrize("run", [1, 2])
def test_awkward_rows_and_ties(spark, run):
    docs = awkward(spark)
    many = [(i % 40 if i % 7 else None, " ".join(f"w{j % (3 + i % 5)}" for j in range(15 + i % 12))) for i in range(400)]
    many += [(5, " ".join(["hot"] * 25))] * 150
    docs = docs.unionByName(spark.createDataFrame(many, "doc_id long, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([("alpha w1 w2 w1",), (None,), ("",)], "text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = R.resample(docs, target, run=run)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == expected(rows, [r.text for r in target.collect()], run)


def test_empty_tables_and_all_drawn(spark):
    docs = awkward(spark)
    none = docs.limit(0)
    assert R.resample(none, docs).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = R.resample(docs, none, percent=100, least_words=0)
    assert Counter(map(tuple, got.collect())) == expected(rows, [], percent=100, least=0)
