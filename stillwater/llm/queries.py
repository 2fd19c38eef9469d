"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    exact_dedup,
    html_extract,
    markov_lm,
    mixing,
    personal_data,
    quality,
    resampling,
    sharding,
    similarity_join,
    time_partitions,
    token_file,
    warc,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_indexed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op2_re_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_file.token_round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0
    )


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), 24)


def op4_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.similarity_classes(table(spark, sf_dir, "documents"))


def op6_hash_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov_lm.score_documents(table(spark, sf_dir, "documents"))


def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("key")


def op11_byte_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.summary(personal_data.personal_data(table(spark, sf_dir, "documents")))


def op13_radix_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_partitions.partitioned_twice(table(spark, sf_dir, "clicks"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_indexed_warc,
        op2_re_pair,
        op3_bounded_ring,
        op4_tree_scoring,
        op5_chosen_path,
        op6_hash_thresholds,
        op7_content_sort,
        op8_factorisation_machine,
        op9_hidden_markov,
        op10_simhash_windows,
        op11_byte_automaton,
        op12_bilstm_crf,
        op13_radix_partitions,
    )
}

_OP6 = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s0),
s2 AS (SELECT *, (source_size * 3)::DOUBLE / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS wall FROM s1),
s3 AS (
  SELECT *, (total - coalesce(sum(source_size * 3) OVER before, 0))::BIGINT AS rem,
         (wall - coalesce(sum(w) OVER before, 0))::BIGINT AS wsum,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place
  FROM s2 WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rem, wsum, place FROM s3 WHERE w * rem <= source_size * 3 * wsum ORDER BY place LIMIT 1),
t AS (
  SELECT s3.source, source_size,
         CASE WHEN s3.place >= level.place THEN (w * level.rem)::DOUBLE / level.wsum
              ELSE (source_size * 3)::DOUBLE END AS target
  FROM s3 LEFT JOIN level ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
x AS (SELECT *, target - times * source_size AS extra FROM b),
g AS (SELECT source, h, sum(size)::BIGINT AS size FROM d GROUP BY source, h),
c AS (
  SELECT source, h, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM g),
cut AS (
  SELECT c.source, max(c.h) AS cut
  FROM c JOIN x ON c.source IS NOT DISTINCT FROM x.source
  WHERE before + c.size <= extra OR (before <= extra AND before + c.size > extra AND before + c.size - extra < extra - before)
  GROUP BY c.source)
SELECT d.doc_id, d.size, x.source_size, x.target,
       (d.size * (x.times + CASE WHEN d.h <= coalesce(cut.cut, '') THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, row_number() OVER g AS place, first_value(doc_id) OVER g AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW g AS (PARTITION BY norm ORDER BY cp DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

_OP11 = r"""
WITH bytes AS (SELECT unnest(range(256))::UBIGINT AS b),
steps AS (
  SELECT b, list_reduce(list_prepend(b, range(8)::UBIGINT[]),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM bytes),
crc_table AS (SELECT list(v ORDER BY b) AS t FROM steps),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT 'b', NULL, NULL, text FROM benchmark),
listed AS (
  SELECT side, rid, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
spread AS (SELECT side, rid, unnest(words) AS word FROM listed),
known AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM spread),
hashed AS (
  SELECT word, (xor(list_reduce(list_prepend(4294967295::UBIGINT,
             list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::UBIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000)::BIGINT AS bucket
  FROM known, crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM spread JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
           / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (
  SELECT rid, sum(gain)::BIGINT AS weight FROM spread JOIN hashed USING (word) JOIN gains USING (bucket)
  WHERE side = 'd' GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln(((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT)::DOUBLE + 0.5)
           / 4294967296))))::BIGINT AS score
  FROM listed LEFT JOIN weights USING (rid) WHERE side = 'd'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
         10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place::BIGINT END AS rank
FROM placed
"""

ORACLE_SQL: dict[str, str] = {
    "op6_hash_thresholds": _OP6,
    "op7_content_sort": _OP7,
    "op11_byte_automaton": _OP11,
}
