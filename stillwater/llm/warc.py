"""WARC archives: write with an index, then read selected records by coalesced byte ranges.

Writing: a partition's records go to archives of their own (one gzip member a record), named by the task's attempt, so
attempts never write to each other's files. The index (archive, offset, length, URL, digest) is a table in the shared
folder that lists the archives of the attempts that succeeded, and what readers start from: they take the index rows they
want, sorted by place, and merge neighbouring ranges into one read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, utf8, written

#: Compressed bytes after which a partition starts its next archive.
ROLL = 256 << 20
#: Unwanted bytes that a read may span, and the most bytes of one read of several records.
GAP, SPAN = 64 << 10, 8 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("digest", pa.string()),
        ("record_type", pa.string()),
    ]
)
_INDEX_DDL = "page_id long, url string, archive string, offset long, length long, digest string, record_type string"
_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_READ_DDL = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary"
)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a null or multi-line URL is written without its line breaks."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.replace(chr(13), '').replace(chr(10), '')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [
            f"WARC-Profile: {_PROFILE}",
            f"WARC-Refers-To: {_record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) of a record, its HTTP headers under ``http`` and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    out["payload"] = payload
    return out


def _writer(base: str, level: int, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(base)
        sink, at, files, rows = None, 0, 0, []

        def close():
            nonlocal sink
            if sink:
                sink.close()
                sink = None

        def emit():
            batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
            rows.clear()
            return batch

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "sha1", "refers_to", "again"))
            for page_id, url, payload, sha1, refers_to, again in zip(*columns):
                if sink and at >= roll:
                    close()
                if not sink:
                    name = f"{task.partitionId():06d}-{files:04d}-{task.taskAttemptId()}.warc.gz"
                    store.create_dir(root, recursive=True)
                    sink, at, files = store.open_output_stream(f"{root}/{name}", compression=None), 0, files + 1
                digest = base32(bytes.fromhex(sha1))
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                record = packer.compress(build_record(page_id, url, payload, digest, refers_to, again)) + packer.flush()
                sink.write(record)
                kind = "revisit" if again else "response"
                rows.append((page_id, url, f"{base}/{name}", at, len(record), digest, kind))
                at += len(record)
            if rows:
                yield emit()
        close()

    return write


def write_archives(
    df: DataFrame,
    base: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    revisit_bytes: int = 0,
    level: int = 3,
    roll: int = ROLL,
) -> DataFrame:
    """Archives under ``base``, a URI of the shared store, and the index of their records as a table there.

    Of payloads equal in at least ``revisit_bytes`` bytes the smallest id's record is a response, the others
    are revisits of it. Null html: an empty payload. Null id: never the smallest unless all are null, when all
    are responses. Repeated rows with the smallest id are all responses. Empty table: an empty index.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), utf8(F.col(html_col)).alias("payload")
    ).withColumn("sha1", F.sha1("payload"))
    # only digests that occur twice matter; they stand in a table, so that Spark broadcasts them if they are few, and
    # else can split the join where one payload has a large part of the rows
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").drop("n"), "repeated")
    again = (F.octet_length("payload") >= revisit_bytes) & F.coalesce(
        F.col("first_id") != F.coalesce("page_id", F.col("first_id") - 1), F.lit(False)
    )
    rows = rows.join(first, "sha1", "left").withColumn("again", again)
    rows = rows.withColumn("refers_to", F.when(F.col("again"), F.col("first_id"))).drop("first_id")
    rows.mapInArrow(_writer(base, level, roll), _INDEX_DDL).write.parquet(f"{base}/index")
    return spark.read.schema(_INDEX_DDL).parquet(f"{base}/index")


def _reader(with_payload: bool):
    def parse(raw: bytes) -> tuple:
        record = parse_record(zlib.decompress(raw, 31))
        digest = record["warc-payload-digest"].removeprefix("sha1:")
        payload, revisit = record["payload"], record["warc-type"] == "revisit"
        if not revisit and base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError(f"digest mismatch in record {record['warc-record-id']}")
        page_id, refers_to = record.get("x-page-id"), record.get("x-refers-to-page-id")
        return (
            int(page_id) if page_id else None,
            record.get("warc-target-uri"),
            int(record["http"]["content-length"]),
            digest,
            record["warc-type"],
            int(refers_to) if refers_to else None,
            payload if with_payload and not revisit else None,
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length"))))
            i = 0
            while i < len(places):
                archive, start, length = places[i]
                end, j = start + length, i + 1
                while (
                    j < len(places)
                    and places[j][0] == archive
                    and places[j][1] - end <= GAP
                    and places[j][1] + places[j][2] - start <= SPAN
                ):
                    end, j = max(end, places[j][1] + places[j][2]), j + 1
                if archive != opened:
                    store, path = pafs.FileSystem.from_uri(archive)
                    source, opened = store.open_input_file(path), archive
                span = source.read_at(end - start, start)
                rows = [parse(span[at - start : at - start + n]) for _, at, n in places[i:j]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)
                i = j

    return read


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of ``selected`` index rows: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, payload. Of a revisit, payload_bytes and the digest are the full payload's and payload is null."""
    places = selected.select("archive", "offset", "length")
    n = shuffle_partitions(selected.sparkSession)
    ordered = places.repartitionByRange(n, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(_reader(with_payload), _READ_DDL)


def warc_round_trip(df: DataFrame) -> DataFrame:
    """Every row of ``df`` (page_id, url, html) written to archives and read back, without the payloads."""
    base = shared_dir(df.sparkSession)
    index = write_archives(df, f"{base}/warc")
    return read_records(index, with_payload=False).drop("payload")
