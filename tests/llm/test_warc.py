import base64
import gzip
import hashlib
import random

from llm.cases import table

from stillwater.llm import warc


def expected(rows):
    payloads = {}
    for page_id, html in rows:
        payloads.setdefault((html or "").encode(), []).append(page_id)
    out = []
    for page_id, html in rows:
        raw = (html or "").encode()
        first = min((i for i in payloads[raw] if i is not None), default=None)
        revisit = first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def digest_rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    assert digest_rows(warc.warc_round_trip(pages)) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_awkward_rows(spark, tmp_path):
    rows = [(3, "u\r\nv", "dup"), (1, None, "dup"), (1, "a", "dup"), (2, "b", None), (4, "c", ""), (None, "d", "dup"), (None, "e", "solo"),
            (5, "f", "é漢\r\n\r\nWARC/1.1\r\n"), (6, "g", "x" * 3_000_000)]
    df = spark.createDataFrame([r + (1, "s") for r in rows], "page_id long, url string, html string, again int, sha1 string")
    assert digest_rows(warc.warc_round_trip(df)) == expected([(r[0], r[2]) for r in rows])
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_files_and_selected_reads(spark, sf_dir, tmp_path):
    pages = table(spark, sf_dir, "pages")
    index = warc.write_archives(pages, f"file://{tmp_path}/w", roll=50_000)
    raw = {str(p): p.read_bytes() for p in (tmp_path / "w").glob("*.warc.gz")}
    assert len(raw) > 1
    for r in index.limit(20).collect():
        part = raw[r.archive.removeprefix("file://")][r.offset : r.offset + r.length]
        record = warc.parse_record(gzip.decompress(part))
        assert record["warc-payload-digest"] == f"sha1:{r.digest}" and gzip.decompress(part).endswith(b"\r\n\r\n")
    assert all(gzip.decompress(b).startswith(b"WARC/1.1\r\n") for b in raw.values())
    some = index.filter("page_id % 7 = 3")
    html = {r.page_id: r.html for r in pages.collect()}
    got = warc.read_records(some).collect()
    assert {r.page_id for r in got} == {i for i in html if i % 7 == 3}
    assert all(bytes(r.payload).decode() == html[r.page_id] for r in got if r.record_type == "response")


def test_a_hot_payload_is_spread(spark, tmp_path, monkeypatch):
    """Half of the pages are equal: their records lie in as many archives as others, also where the join shuffles."""
    letters = random.Random(2)
    page = lambda: "".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=40_000))
    same = page()
    rows = [(i, "u", same if i % 2 else page()) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        index = warc.write_archives(df, f"file://{tmp_path}/w")
        sizes = sorted(r["count"] for r in index.groupBy("archive").count().collect())
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(sizes) == 400 and sizes[-1] < 100
    assert digest_rows(warc.read_records(index)) == expected([(r[0], r[2]) for r in rows])
