import zlib

import corpus_pipeline as P
from llm.cases import clashing, whole
from llm.test_decontaminate import best
from llm.test_similarity_join import brute

from stillwater.llm import quality
from stillwater.llm.mixing import mix


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, outs = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(docs.collect())
        assert k == len(P.STAGES) - 1 or docs.columns == columns
    start = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.classify(start, labels).collect() if r.predicted}
    assert {r.doc_id for r in outs[0]} == good
    classes = brute([(r.doc_id, r.text) for r in outs[0]])
    assert sorted(r.doc_id for r in outs[1]) == sorted({c for _, c, _ in classes})
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in outs[1] if any(i.split()[7] in r.text and best(r.text, i) >= 0.8 for i in items)}
    assert {r.doc_id for r in outs[2]} == {r.doc_id for r in outs[1]} - dirty
    ids = [r.doc_id for r in outs[3]]
    assert set(ids) <= {r.doc_id for r in outs[2]} and max(map(ids.count, set(ids))) <= 3
    assert sorted(ids) == sorted(r.doc_id for r in outs[4])
    sizes = [sum(r.shard == s for r in outs[4]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and zlib.crc32(b"") == 0


def test_run_over_the_smallest(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.count() > 0 and {"shard", "slot", "text"} <= set(out.columns)


def test_awkward_rows_keep_all_their_values(spark, tmp_path, monkeypatch):
    """Every stage on rows with nulls, repeats and clashing names: what stays is unchanged in every column."""
    item = " ".join(f"q{i}" for i in range(30))
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(None, text(1), "s"), (None, text(2), "s"), (None, text(2), "t"), (4, text(3), None), (5, text(3) + " more", "s"), (6, item, "s"),
            (7, None, "t"), (7, "", None), (None, None, None), (8, text(4), "u"), (8, text(4), "u"), (9, "one", "u"), (10, text(5), "u")]
    df = clashing(spark, rows)
    base = f"{tmp_path}/sf"
    spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    monkeypatch.setattr(quality, "fit", lambda rows, marks: quality.FactorisationMachine(5.0, quality.np.zeros(quality.DIM), quality.np.zeros((quality.DIM, 8))))
    given, by_name = whole(df.collect()), dict(P.STAGES)
    for name, stage in list(by_name.items())[:4]:
        out = stage(spark, df, base)
        assert out.schema.simpleString() == df.schema.simpleString(), name
        got = whole(out.collect())
        assert set(got) <= set(given), name
        texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        if name == "quality classifier":
            assert got == given
        elif name == "n-gram Jaccard join":
            assert texts == sorted([(None, text(1)), (None, text(2)), (4, text(3)), (6, item), (7, None), (7, ""), (None, None), (8, text(4)), (9, "one"), (10, text(5))], key=repr)
        elif name == "benchmark decontamination":
            assert got == [g for g in given if ("doc_id", "6") not in g]
        else:
            times = whole(mix(df, keep=True, times="MIX_times").collect(), ("MIX_times",))
            n = {r.asDict()["__k"]: r.asDict()["taken_times"] for r in mix(df, keep=True, times="taken_times").collect()}
            assert len(times) == len(given) and max(n.values()) <= 3
            assert sorted(r.asDict()["__k"] for r in out.collect()) == sorted(k for k, t in n.items() for _ in range(t))
    out = by_name["sharding"](spark, df, base)
    dropped = [c for c in df.columns if c.lower() in ("shard", "slot")]
    assert whole(out.collect(), ("shard", "slot")) == whole(df.drop(*dropped).collect())
    empty = df.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, base).count() == 0, name


def test_a_thread_forgets_its_own_folders(spark):
    import threading
    from pathlib import Path

    from stillwater.llm import common

    kept, other = common.marked(), []
    mine = common.written(spark.range(3), "mine")
    thread = threading.Thread(target=lambda: other.append(common.written(spark.range(4), "other")))
    thread.start()
    thread.join()
    common.forget(kept)
    assert other[0].count() == 4
    assert not any(Path(f.removeprefix("file://")).exists() for f in mine.inputFiles())
