import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.cases import awkward, table

from stillwater.llm import markov_lm as M
from stillwater.llm import quality as Q


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 2


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = Q.FactorisationMachine(0.3, rng.normal(size=Q.DIM), rng.normal(size=(Q.DIM, Q.RANK)))
    rows = [Q.features(t) for t in ("one two three two", "", "A!! B!! | x")]
    for (index, x), y in zip(rows, fm.margins(rows)):
        direct = fm.w0 + sum(fm.w[i] * v for i, v in zip(index, x))
        direct += sum(fm.v[index[a]] @ fm.v[index[b]] * x[a] * x[b] for a in range(len(x)) for b in range(a + 1, len(x)))
        assert abs(direct - y) < 1e-8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf), table(spark, sf, "labels")
    scores = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    held = [(scores[r.doc_id], r.quality) for r in labels.collect() if fold(r.doc_id, 4)]
    assert all(r.held_out for r, _ in held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scores.values())
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    pairs = [(a.score > b.score) for a, p in held for b, q in held if p > q]
    assert np.mean(pairs) > 0.98


def plain_fit(rows, labels):
    """The machine of fit(), one feature after the other."""
    rng = np.random.default_rng(7)
    w0, w, v = 0.0, np.zeros(Q.DIM), rng.normal(0, 0.02, (Q.DIM, Q.RANK))
    g0, gw, gv = 1e-6, np.full(Q.DIM, 1e-6), np.full((Q.DIM, Q.RANK), 1e-6)
    n, ones = len(rows), labels.sum()
    rare = min(4.0, max(1.0, ones / max(1.0, n - ones)) ** 0.5)
    for _ in range(Q.EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, Q.BATCH):
            some = order[low : low + Q.BATCH]
            dw, dv, d0 = {}, {}, 0.0
            for r in some:
                feats = [(int(i), float(x)) for i, x in zip(*rows[r])]
                total = sum(v[i] * x for i, x in feats)
                y = w0 + sum(w[i] * x for i, x in feats) + 0.5 * float((total**2 - sum((v[i] * x) ** 2 for i, x in feats)).sum())
                d = (1.0 if labels[r] == 1 else rare) * (1 / (1 + math.exp(-min(30, max(-30, y)))) - labels[r]) / len(some)
                d0 += d
                for i, x in feats:
                    dw[i] = dw.get(i, 0.0) + d * x
                    dv[i] = dv.get(i, 0.0) + d * x * (total - v[i] * x)
            for i in dw:
                g, h = dw[i] + Q.DECAY * w[i], dv[i] + Q.DECAY * v[i]
                gw[i] += g * g
                gv[i] += h * h
                w[i] -= Q.RATE * g / math.sqrt(gw[i])
                v[i] -= Q.RATE * 0.5 * h / np.sqrt(gv[i])
            g0 += d0**2
            w0 -= Q.RATE * d0 / math.sqrt(g0)
    return Q.FactorisationMachine(w0, w, v)


def test_scores_against_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(Q, "EPOCHS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 40, 3 + i % 20)), 9 * i) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150)], "doc_id long, quality int")
    train = [(i, t, n) for i, t, n in rows if i < 150 and not fold(i, 4)]
    float32 = lambda f: (f[0], f[1].astype(np.float32).astype(float))  # noqa: E731  as they reach the driver
    model = plain_fit([float32(Q.features(t, (n,))) for _, t, n in train], np.array([i % 2 for i, *_ in train], float))
    got = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    for i, text, n in rows:
        y = 1 / (1 + math.exp(-float(np.clip(model.margins([Q.features(text, (n,))]), -30, 30)[0])))
        assert abs(got[i] - y) < 1e-6


def test_one_text_of_an_id_teaches(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, quality int")
    rows, marks = Q.training_rows(docs, labels)
    assert len(rows) == 3 - (fold(3, 4)) - 2 * fold(1, 4) and sorted(marks) == sorted([1, 0] * (not fold(1, 4)) + [0] * (not fold(3, 4)))


def test_classifier_awkward_rows(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (9, None), (1, 1)], "doc_id long, quality int")
    assert Q.classify(df, labels).count() == df.count()
    none = Q.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert Q.accepted(df, labels.limit(0)).count() == df.count() and Q.accepted(df, labels).columns == df.columns
    assert Q.classify(df.limit(0), labels).count() == 0


def test_base_score_and_known_words(spark, sf_dir):
    docs = table(spark, sf_dir)
    words = {r.doc_id: r.text.encode().lower().split() + [b""] for r in docs.collect()}
    c = Counter(w for i, ws in words.items() if not fold(i, 7) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = M.score_documents(docs).collect()
    assert len(rows) == len(words)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7), len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * abs(r.base_score)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_likelihood(model, ids):
    """Sum over all state paths."""
    k, total = len(model.start), 0.0
    for path in np.ndindex(*[k] * len(ids)):
        p = model.start[path[0]] * model.emit[ids[0], path[0]]
        for t in range(1, len(ids)):
            p *= model.step[path[t - 1], path[t]] * model.emit[ids[t], path[t]]
        total += p
    return math.log(total)


@pytest.fixture
def model():
    rng = np.random.default_rng(6)
    norm = lambda a, axis: a / a.sum(axis, keepdims=True)
    return M.Markov(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))


def test_forward_is_exact(model):
    rng = np.random.default_rng(7)
    ids = [rng.integers(0, 7, n).astype(np.int32) for n in (1, 2, 6, 6, 3)]
    for some, lengths, grid in model.side_by_side(ids):
        for i, log in zip(some, model.forward(lengths, grid)):
            assert abs(log - brute_likelihood(model, ids[i])) < 1e-9


def test_expected_counts_and_likelihood_rises(model):
    rng = np.random.default_rng(8)
    ids = [rng.integers(0, 7, n).astype(np.int32) for n in (40, 1, 17, 40, 300)]
    start, step, emit = model.expected(ids)
    n = sum(map(len, ids))
    assert abs(start.sum() - 5) < 1e-9 and abs(step.sum() - (n - 5)) < 1e-6 and abs(emit.sum() - n) < 1e-6
    whole = lambda m: sum(m.forward(lengths, grid).sum() for _, lengths, grid in m.side_by_side(ids))
    better = M.Markov(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    assert whole(better) > whole(model)


def test_probabilities_sum_to_one(model):
    """Over all class sequences of a length."""
    total = sum(math.exp(brute_likelihood(model, s)) for s in np.ndindex(7, 7, 7))
    assert abs(total - 1) < 1e-9


def test_language_model_awkward_rows(spark):
    df = awkward(spark)
    rows = M.score_documents(df).collect()
    assert len(rows) == df.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert M.score_documents(df.limit(0)).count() == 0


def test_language_model_learns_from_all_documents_however_dealt(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{a}" for a in rng.integers(0, 30, 12) + 30 * (i % 2))) for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = ({r.doc_id: r.score for r in M.score_documents(d).collect()} for d in (df.coalesce(1), df.repartition(4, "text")))
    assert max(abs(one[i] - other[i]) for i in one) < 1e-6


def plain_scores(rows, blocks):
    """Scores by id, of (id, text) and each training row's block: unscaled recursions in logarithms, a token at a time."""
    words = {i: text.encode().lower().split() + [b""] for i, text in rows}
    c = Counter(w for i in blocks for w in words[i])
    order = sorted(c, key=lambda w: (-c[w], w))
    own = {w: j for j, w in enumerate(order[: M.OWN])}
    cls = lambda w: own.get(w, len(own) + M.ending(w))
    tokens_of, kinds = np.zeros(len(own) + M.ENDINGS), np.zeros(len(own) + M.ENDINGS)
    for w in c:
        tokens_of[cls(w)] += c[w]
        kinds[cls(w)] += w not in own
    kinds[len(own) :] += 1  # the words that training never met
    unigram = (tokens_of + kinds) / (tokens_of + kinds).sum()
    ids = {i: [cls(w) for w in ws] for i, ws in words.items()}

    def passes(m, seq):
        with np.errstate(divide="ignore"):
            a = [np.log(m.start) + np.log(m.emit[seq[0]])]
            for t in seq[1:]:
                a.append(np.logaddexp.reduce(a[-1][:, None] + np.log(m.step), axis=0) + np.log(m.emit[t]))
            b = [np.zeros(len(m.start))]
            for t in reversed(seq[1:]):
                b.append(np.logaddexp.reduce(np.log(m.step) + np.log(m.emit[t]) + b[-1], axis=1))
        return a, b[::-1], np.logaddexp.reduce(a[-1])

    def expected(block, m):
        k = len(m.start)
        start, step, emit, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit), 0.0
        for i, at in blocks.items():
            if at != block:
                continue
            a, b, log = passes(m, ids[i])
            total += log
            for t, token in enumerate(ids[i]):
                gamma = np.exp(a[t] + b[t] - log)
                emit[token] += gamma
                if t == 0:
                    start += gamma
                else:
                    step += np.exp(a[t - 1][:, None] + np.log(m.step) + np.log(m.emit[token]) + b[t] - log)
        return start, step, emit, total

    there = sorted(set(blocks.values()))
    model = M.train(lambda j, m: expected(there[j], m), len(there), unigram)
    out = {}
    for i, ws in words.items():
        inside = sum(math.log10((c[w] + 1) / (tokens_of[cls(w)] + kinds[cls(w)])) for w in ws if w not in own)
        out[i] = passes(model, ids[i])[2] / math.log(10) + inside
    return out


def test_scores_against_plain_recursions(spark, monkeypatch):
    for name, value in (("OWN", 20), ("TABLE", 30), ("SIDE", 64)):
        monkeypatch.setattr(M, name, value)
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{a}x" for a in rng.geometric(0.06, 3 + i % 40))) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    at = {r[0]: r[1] for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(M.BLOCKS))).collect()}
    expected = plain_scores(rows, {i: b for i, b in at.items() if not fold(i, 7)})
    got = {r.doc_id: r.score for r in M.score_documents(df).collect()}
    assert got.keys() == expected.keys() and max(abs(got[i] - expected[i]) for i in got) < 1e-6
    more = {r.doc_id: (r.score, r.n_known) for r in M.score_documents(df.repartition(7)).collect()}
    assert all(abs(more[i][0] - got[i]) < 1e-9 for i in got)


def test_a_long_text_goes_by_stretches(model, monkeypatch):
    ids = [np.random.default_rng(3).integers(0, 7, n).astype(np.int32) for n in (900, 31, 2)]
    whole, log = model.expected_and_log(ids), {}
    for some, lengths, grid in model.side_by_side(ids):
        log |= dict(zip(some, model.forward(lengths, grid)))
    monkeypatch.setattr(M, "SIDE", 50)
    parts = model.expected_and_log(ids)
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(whole, parts))
    for some, lengths, grid in model.side_by_side(ids):
        assert all(abs(log[i] - x) < 1e-9 for i, x in zip(some, model.forward(lengths, grid)))
