"""SQL of the frames that queries use, for DuckDB: common table expressions and comparison fragments."""

from __future__ import annotations

#: emb(session_id, frame_id, x, y, r, g, b)
EMB = """
emb_f AS (
  SELECT label::BIGINT AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_id, embedding
  FROM embeddings),
emb_v AS (
  SELECT session_id, frame_id, pos, (floor(embedding[pos + 1]::DOUBLE * 128) + 128)::INT AS v
  FROM emb_f, (SELECT unnest(range(64)) AS pos)),
emb AS (
  SELECT session_id, frame_id, (pos % 8)::INT AS x, (pos // 8)::INT AS y, v AS r, (v * 3) % 256 AS g, (v + 91) % 256 AS b
  FROM emb_v)"""

#: li(session_id, frame_id, x, y, r, g, b)
LI = """
li_c AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS month, (l_suppkey % 32)::INT AS x, (l_partkey % 32)::INT AS y,
         sum(l_quantity::BIGINT)::BIGINT AS q, count(*) AS n
  FROM lineitem GROUP BY ALL),
li_m AS (SELECT month, row_number() OVER (ORDER BY month) AS frame_id FROM (SELECT DISTINCT month FROM li_c)),
li AS (
  SELECT 1::BIGINT AS session_id, frame_id, gx.x, gy.y, coalesce(q, 0) % 256 AS r, (coalesce(n, 0) * 37) % 256 AS g,
         (coalesce(q, 0) * 7 + coalesce(n, 0)) % 256 AS b
  FROM li_m CROSS JOIN (SELECT unnest(range(32))::INT AS x) gx CROSS JOIN (SELECT unnest(range(32))::INT AS y) gy
  LEFT JOIN li_c ON li_c.month = li_m.month AND li_c.x = gx.x AND li_c.y = gy.y)"""


def comparison(pairs: str, keys: str, mode: str, threshold: int, area: float) -> str:
    """SELECT of comparison rows over ``pairs`` (keys, x, y, r1, g1, b1, r2, g2, b2)."""
    t = 0 if mode == "exact" else threshold
    hit = f"greatest(abs(r1 - r2), abs(g1 - g2), abs(b1 - b2)) > {t}"
    return f"""
SELECT {keys}, '{mode}' AS mode, {t} AS pixel_threshold, {area}::DOUBLE AS area_threshold,
       changed_pixels > 0 AND changed_pixels::DOUBLE / total_pixels >= {area}::DOUBLE AS changed,
       changed_pixels, total_pixels, changed_pixels::DOUBLE / total_pixels AS changed_fraction,
       x0 AS bbox_x, y0 AS bbox_y, x1 - x0 + 1 AS bbox_w, y1 - y0 + 1 AS bbox_h
FROM (
  SELECT {keys}, count(*) FILTER (WHERE {hit}) AS changed_pixels, count(*) AS total_pixels,
         min(x) FILTER (WHERE {hit}) AS x0, max(x) FILTER (WHERE {hit}) AS x1,
         min(y) FILTER (WHERE {hit}) AS y0, max(y) FILTER (WHERE {hit}) AS y1
  FROM ({pairs}) AS pairs GROUP BY {keys})"""


def consecutive_pairs(frames: str) -> str:
    return f"""SELECT a.session_id, a.frame_id, a.x, a.y, b.r AS r1, b.g AS g1, b.b AS b1, a.r AS r2, a.g AS g2, a.b AS b2
FROM {frames} a JOIN {frames} b ON b.session_id = a.session_id AND b.frame_id = a.frame_id - 1 AND b.x = a.x AND b.y = a.y"""


def baseline_pairs(frames: str) -> str:
    return f"""SELECT a.session_id, a.frame_id, a.x, a.y, b.r AS r1, b.g AS g1, b.b AS b1, a.r AS r2, a.g AS g2, a.b AS b2
FROM {frames} a JOIN {frames} b ON b.session_id = a.session_id AND b.frame_id = 1 AND b.x = a.x AND b.y = a.y
WHERE a.frame_id > 1"""


KEYS = "session_id, frame_id"


def emb_consecutive(mode: str, threshold: int, area: float) -> str:
    return comparison(consecutive_pairs("emb"), KEYS, mode, threshold, area)


def emb_baseline(mode: str, threshold: int, area: float) -> str:
    return comparison(baseline_pairs("emb"), KEYS, mode, threshold, area)
