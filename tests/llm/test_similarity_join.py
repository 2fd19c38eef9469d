import random
from collections import Counter, defaultdict

import pytest
from llm.cases import awkward, table

from stillwater.llm import similarity_join as J
from stillwater.llm.components import components


def brute(rows):
    """(id, class, links) of rows (id, text) with unique ids."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a + 1, len(ids)):
                common[ids[a], ids[b]] += 1
    up, links = {i: i for i in sets}, Counter()

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for (a, b), c in common.items():
        if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted((i, find(i), links[i]) for i in sets)


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir)
    got = sorted(map(tuple, J.similarity_classes(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def near_copies(n, seed=1, words=240, edits=4):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("edits, few", [(4, 10**6), (30, 10**6), (12, 0)])
def test_large_group_in_blocks(spark, monkeypatch, edits, few):
    """Near copies, close ones and loose ones, over several buckets and blocks, and documents that share one passage."""
    for name, value in (("LEAF", 32), ("BLOCK", 16), ("DEPTH", 3), ("DRAWN", 5), ("BROADCAST_MEMBERS", few)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = near_copies(150, edits=edits) + [(1000 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(60)) + " " + passage) for i in range(150)]
    rows += [(2000 + i, rows[i % 7][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.similarity_classes(df).collect()))
    assert got == brute(rows) and max(r[2] for r in got) > 20


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = sorted((tuple(r) for r in J.similarity_classes(df).collect()), key=repr)
    alpha = [r for r in rows if r[1] == 1]
    assert len(alpha) == 4 and all(r[2] == 3 for r in alpha)  # the copies, one with a null id
    assert (3, 3, 0) in rows and (4, 4, 0) in rows and (None, None, 0) in rows and len(rows) == df.count()
    kept = J.one_of_each(df)
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 3, 4, 5, 6, None, 7, 8, 9], key=repr) and kept.columns == df.columns
    assert J.similarity_classes(df.limit(0)).count() == 0 and J.one_of_each(df.limit(0)).count() == 0


def test_classes_without_ids_stay_apart(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey"]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2])]
    kept = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2])], key=repr)


def test_components(spark):
    edges = [("a", "b"), ("c", "b"), ("x", "y"), ("z", "y"), ("q", "q")] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["c"] == got["b"] == "a" and got["z"] == "x" and set(got.values()) == {"a", "x", "n00"} and len(got) == 47


def test_common_counts():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (50, 80, 1, 200, 120, 60)]
    got = J.common_counts(sets)
    for a in range(6):
        for b in range(6):
            if a != b:
                assert got[a, b] == len(np.intersect1d(sets[a], sets[b]))
