from collections import defaultdict

import pytest
from llm.cases import awkward, table

from stillwater.llm import mixing as X
from stillwater.llm.mixing import mix, source_targets


def water(sizes, weights=(1, 2, 3), most=3):
    """Excess reshared by weight until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(w[s] for s in free)
        target = {s: rest * w[s] / share for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return {**fixed, **target}
        for s in above:
            fixed[s] = most * sizes[s]


def test_targets(spark):
    sizes = {"a": 10, "b": 5000, "c": 3, "d": 700, "e": 700, None: 90, "f": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    expected = water(sizes)
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-6 for k in got)


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir)
    rows = mix(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix(docs.repartition(5)).collect()))


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = mix(df).collect()
    assert len(rows) == df.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
    kept = mix(df, keep=True)
    assert set(df.columns) < set(kept.columns) and kept.count() == df.count()
    assert mix(df.limit(0)).count() == 0


def test_wordless_documents_of_a_capped_source(spark):
    rows = [(i, "one two" if i % 2 else " ", "small") for i in range(40)] + [(100 + i, "a b c d e f g h " * 20, "large") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = {r.doc_id: r.mix_times for r in mix(df, keep=True).collect()}
    assert {times[i] for i in range(40)} == {3} and max(times.values()) <= 3


@pytest.mark.parametrize("keep", [False, True])
def test_many_sources_by_a_join(spark, monkeypatch, keep):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3 and i % 97}") for i in range(2_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(tuple, mix(df, keep=keep).collect()))
    monkeypatch.setattr(X, "BROADCAST_SOURCES", 5)
    assert sorted(map(tuple, mix(df, keep=keep).collect())) == few
