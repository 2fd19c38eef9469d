from collections import Counter

from llm.cases import awkward, table

from stillwater.llm import decontaminate as D


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def best(text, item):
    """Largest weighted similarity of an item-sized window with the item."""
    w, v = (text or "").lower().split(), (item or "").lower().split()
    if not v:
        return 0
    k, n = min(5, len(v)), len(v)
    b, most = shingles(v, k), 0
    for s in range(max(1, len(w) - k + 1)):
        a = shingles(w[s : s + n], k)
        union = sum((a | b).values())
        most = max(most, sum((a & b).values()) / union if union else 0)
    return most


def test_documents(spark, sf_dir):
    docs, items = table(spark, sf_dir), table(spark, sf_dir, "benchmark")
    got = {(r.doc_id, r.item_id): r.similarity for r in D.matches(docs, items).collect()}
    expected = {}
    for d in docs.collect():
        for i in items.collect():
            if (s := best(d.text, i.text)) >= 0.8:
                expected[d.doc_id, i.item_id] = s
    assert expected and got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    kept = {r.doc_id for r in D.decontaminated(docs, items).collect()}
    assert kept == {d.doc_id for d in docs.collect()} - {d for d, _ in expected}


def test_edited_passages_and_the_join_path(spark, monkeypatch):
    words = [f"q{i}" for i in range(40)]
    item = " ".join(words)
    edit = lambda at: " ".join(words[:at] + ["new"] + words[at + 1 :])
    rows = [(1, f"some text {item} more"), (2, f"x {edit(0)} y"), (3, f"a b {edit(39)}"), (4, " ".join(words[:20])), (5, f"A {item.upper()}"),
            (6, " ".join(words[:12] + ["k"] * 40)), (7, f"{item} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, "two words"), (4, None), (5, "  ")], "item_id long, text string")
    expected = {(d, i) for d, t in rows for i in (1, 2) if best(t, item) >= 0.8}
    found = lambda: {(r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()}
    assert found() == expected and {d for d, _ in expected} == {1, 2, 3, 5, 7}
    for name in ("IN_SCAN", "BROADCAST_ITEMS"):
        monkeypatch.setattr(D, name, 0)
        assert found() == expected


def edited(rng, words):
    """The words with random insertions, deletions and changes, few enough that many stay similar."""
    words = list(words)
    for _ in range(rng.randrange(4)):
        at, kind = rng.randrange(len(words)), rng.random()
        new = [f"n{rng.randrange(999)}" for _ in range(rng.choice([1, 1, 2, 4, 8]))]
        if kind < 0.5:
            words[at:at] = new
        elif kind < 0.75:
            del words[at : at + len(new)]
        else:
            words[at : at + len(new)] = new
        if len(words) < 10:
            break
    for end in (0, 1):
        if rng.random() < 0.3:
            n = rng.randrange(1, 4)
            words = words[n:] if end else words[:-n]
    return words


def test_insertions_deletions_and_changes(spark):
    """Every item-sized window counts, not those alone that a shared shingle aligns."""
    import random

    rng = random.Random(11)
    items = [[f"i{k}w{rng.randrange(40)}" for _ in range(rng.choice([6, 20, 40, 40, 61, 80, 120]))] for k in range(12)]
    items.append(items[3][:30] + [f"z{j}" for j in range(10)])  # shares shingles with another
    rows = []
    for d in range(400):
        filler = lambda most: [f"f{rng.randrange(500)}" for _ in range(rng.randrange(most))]
        words = filler(30) + edited(rng, rng.choice(items)) + filler(30)
        if d % 9 == 0:
            words += edited(rng, rng.choice(items))
        rows.append((d, " ".join(words)))
    # an insertion in the middle and changed ends: similar from a start that no shared shingle aligns
    w = items[-1][:0] + [f"q{j}" for j in range(80)]
    items.append(w)
    rows.append((5_000, " ".join(["a", "b", *w[2:40], "k", "l", "m", "n", *w[40:78], "c", "d"])))
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.matches(docs, bench).collect()}
    by_word = {}
    for k, t in enumerate(items):
        for x in t:
            by_word.setdefault(x, set()).add(k)
    expected = {}
    for d, text in rows:
        for k in set().union(*(by_word.get(x, set()) for x in text.split())):
            if (s := best(text, " ".join(items[k]))) >= 0.8:
                expected[d, k] = s
    assert len(expected) > 150 and (5_000, 13) in expected
    assert got.keys() <= expected.keys()
    lost = expected.keys() - got.keys()
    # a fingerprint may be outside the radius where the similarity is close to the least
    assert len(lost) <= 0.01 * len(expected) and all(expected[k] < 0.83 for k in lost)
    less = [k for k in got if got[k].similarity < expected[k] - 1e-9]
    assert len(less) <= 0.01 * len(expected) and all(got[k].similarity <= expected[k] + 1e-9 for k in got)
    kept = {r.doc_id for r in D.decontaminated(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_short_items_and_awkward_rows(spark):
    df = awkward(spark)
    bench = spark.createDataFrame([(1, "one", "x"), (None, "epsilon zeta", "y"), (3, None, "z")], "item_id long, text string, key string")
    got = D.matches(df, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted([(6, 1), (1, None), (2, None), (2, None), (None, None)], key=repr)
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == df.count() - 5
    assert D.matches(df.limit(0), bench).count() == 0 and D.matches(df, bench.limit(0)).count() == 0


def test_pigeonhole(spark):
    """The index meets every fingerprint within the radius: any 31 flips leave a block of at most 3, two for the items'
    side and one for the windows'."""
    import random

    rng = random.Random(4)
    for _ in range(200):
        bits = rng.sample(range(128), D.RADIUS)
        per = Counter(b // 16 for b in bits)
        assert min(per.get(i, 0) for i in range(D.BLOCKS)) <= D.RADIUS // D.BLOCKS

    rows = spark.createDataFrame([(0x1234,)], "v int").select(D._flipped("v", 1).alias("a")).crossJoin(
        spark.createDataFrame([(0,)], "w int").select(D._flipped("w", D.RADIUS // D.BLOCKS - 1).alias("b")))
    met = {r.a ^ r.b ^ 0x1234 for r in rows.collect()}
    assert met == {m for m in range(1 << 16) if m.bit_count() <= D.RADIUS // D.BLOCKS}
