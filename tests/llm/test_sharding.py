import zlib
from collections import defaultdict

from llm.cases import awkward, table

from stillwater.llm import sharding as H


def check(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s, slots in by.items():
        assert sorted(slots) == list(range(len(slots))) and 0 <= s < shards


def test_laws_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir)
    got = H.shard_digest(docs).collect()
    check(got, 24)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    again = {(r.doc_id, r.shard) for r in H.shard_digest(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.shard) for r in got}


def test_awkward_rows(spark):
    df = awkward(spark)
    got = H.shard_rows(df, 5)
    check(got.collect(), 5)
    assert got.count() == df.count() and set(got.columns) == set(df.columns)
    assert H.shard_rows(df.limit(0), 5).count() == 0
    nulls = H.shard_digest(df).filter("doc_id is null and text_crc32 = 0").collect()
    assert [r.size for r in nulls] == [8]


def test_a_hot_key_spreads(spark):
    df = spark.range(3000).selectExpr("cast(if(id % 3 = 0, 7, id) as long) AS doc_id", "'x' AS text")
    check(H.shard_rows(df, 24).collect(), 24)


def test_plan_against_one_by_one():
    """The plan puts each cell's rows where a walk around the ring, own keys first, would."""
    points = H.ring(4, 8)
    counts = {(a, c): (a * 7 + c * 3) % 5 for a in range(len(points)) for c in range(3)}
    counts = {k: n for k, n in counts.items() if n}
    room = H.capacities(sum(counts.values()), 4)
    out = H.plan(counts, points, room)
    left, expected, over = list(room), defaultdict(int), []
    for (arc, cell), n in sorted(counts.items()):
        for _ in range(n):
            s = points[arc][1]
            if left[s]:
                left[s] -= 1
                expected[arc, cell, s] += 1
            else:
                over.append((arc, cell))
    for arc, cell in over:
        step = arc
        while not left[points[step][1]]:
            step = (step + 1) % len(points)
        left[points[step][1]] -= 1
        expected[arc, cell, points[step][1]] += 1
    got = defaultdict(int)
    for arc, cell, low, high, shard, _ in out:
        got[arc, cell, shard] += high - low
    assert got == expected


def test_limited_movement(spark):
    df = spark.range(5000).selectExpr("id AS doc_id")
    a = {r.doc_id: r.shard for r in H.shard_rows(df, 10, epsilon=0.25).collect()}
    b = {r.doc_id: r.shard for r in H.shard_rows(df, 11, epsilon=0.25).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)
    assert max(list(b.values()).count(s) for s in range(11)) <= 1.25 * 5000 / 11 + 1


def test_equal_rows_are_dealt_to_cells_of_their_own(spark, monkeypatch):
    """The same places of every content, however the rows are dealt out."""
    monkeypatch.setattr(H, "EQUAL", 64)
    df = spark.createDataFrame([(7 if i % 3 else i, "x" if i % 3 else f"y{i}") for i in range(3_000)], "doc_id long, text string")
    outs = [H.shard_rows(d, 24).collect() for d in (df.repartition(3), df.coalesce(1))]
    check(outs[0], 24)
    assert sorted(map(tuple, outs[0])) == sorted(map(tuple, outs[1]))
