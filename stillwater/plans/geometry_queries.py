"""Queries of the rectangle and coordinate functions, over rectangles made from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.tables import table
from .registry import scalar

_COLUMNS = {
    "id": "o_orderkey",
    "x": "o_custkey % 2400 - 200",
    "y": "o_orderkey % 1300 - 100",
    "w": "CASE WHEN o_custkey % 13 = 0 THEN 0 ELSE o_orderkey % 800 END",
    "h": "o_orderkey % 600",
    "x2": "o_orderkey % 2000 - 100",
    "y2": "o_custkey % 1100 - 50",
    "w2": "o_custkey % 700 + 1",
    "h2": "o_orderkey % 500 + 1",
    "pad": "o_custkey % 40",
}
_SQL = "SELECT " + ", ".join(f"{text} AS {c}" for c, text in _COLUMNS.items()) + " FROM orders"
_SCREEN = (0, 0, 1920, 1080)


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{text} AS {c}" for c, text in _COLUMNS.items()])


def _r(*names: str):
    return G.rect(*[F.col(n) for n in names])


class _Lazy:
    """Columns that several queries use, made when they run: there is no session at import."""

    a = property(lambda self: _r("x", "y", "w", "h"))
    b = property(lambda self: _r("x2", "y2", "w2", "h2"))
    bounds = property(lambda self: G.rect(*[F.lit(v) for v in _SCREEN]))
    local = property(lambda self: G.to_local(self.a, F.col("x2"), F.col("y2")))
    source = property(lambda self: G.to_source(self.a, F.col("x2"), F.col("y2")))
    t = property(lambda self: G.transform(self.b, F.col("pad") + 1, F.col("pad") * 2 + 1))
    wh = property(lambda self: (F.col("w2"), F.col("h2")))
    kind = property(lambda self: F.element_at(F.array(*[F.lit(k) for k in ("none", "width", "height", "scale")]), (F.col("id") % 4 + 1).cast("int")))
    seen = property(lambda self: G.intersect(self.b, self.bounds))


L = _Lazy()
_INSIDE = "x >= 0 AND y >= 0 AND x + w <= 1920 AND y + h <= 1080"
_CROSS = "least(x + w, x2 + w2) - greatest(x, x2) > 0 AND least(y + h, y2 + h2) - greatest(y, y2) > 0"


def _of(column, names: str = "x y width height", prefix: str = ""):
    return {prefix + n: column[n] for n in names.split()}


def _add(name: str, columns, texts: dict) -> None:
    scalar(name, _rects, _SQL, ["id"], columns, texts)


_add(
    "rect_new",
    lambda: {"ok": G.rect_new(*[F.col(c) for c in "xywh"]).isNotNull(), "width": G.rect_new(*[F.col(c) for c in "xywh"])["width"]},
    {"ok": "w > 0 AND h > 0", "width": "CASE WHEN w > 0 AND h > 0 THEN w END"},
)
_add(
    "rect_edges",
    lambda: {"right_edge": G.right(L.a), "bottom_edge": G.bottom(L.a), "pixels": G.area(L.a), "is_empty": G.is_empty(L.a)},
    {"right_edge": "x + w", "bottom_edge": "y + h", "pixels": "w * h", "is_empty": "w = 0 OR h = 0"},
)
_add("rect_within", lambda: {"inside": G.within(L.a, L.bounds)}, {"inside": _INSIDE})
_add(
    "rect_intersect",
    lambda: _of(G.intersect(L.a, L.b)),
    {
        "x": f"CASE WHEN {_CROSS} THEN greatest(x, x2) END",
        "y": f"CASE WHEN {_CROSS} THEN greatest(y, y2) END",
        "width": f"CASE WHEN {_CROSS} THEN least(x + w, x2 + w2) - greatest(x, x2) END",
        "height": f"CASE WHEN {_CROSS} THEN least(y + h, y2 + h2) - greatest(y, y2) END",
    },
)
_add(
    "rect_pad_clamp",
    lambda: _of(G.pad_clamp(L.b, F.col("pad"), L.bounds)),
    {
        "x": "greatest(x2 - pad, 0)",
        "y": "greatest(y2 - pad, 0)",
        "width": "greatest(least(x2 + w2 + pad, 1920) - greatest(x2 - pad, 0), 1)",
        "height": "greatest(least(y2 + h2 + pad, 1080) - greatest(y2 - pad, 0), 1)",
    },
)
_add("rect_to_local", lambda: _of(L.local), {"x": "x - x2", "y": "y - y2", "width": "w", "height": "h"})
_add("rect_to_source", lambda: _of(L.source), {"x": "x + x2", "y": "y + y2", "width": "w", "height": "h"})
_SX, _SY = "w2::DOUBLE / (pad + 1)", "h2::DOUBLE / (pad * 2 + 1)"
_add(
    "make_transform",
    lambda: _of(L.t, "origin offset_x offset_y scale_x scale_y"),
    {"origin": "'top-left'", "offset_x": "x2", "offset_y": "y2", "scale_x": _SX, "scale_y": _SY},
)
_add(
    "image_to_source",
    lambda: _of(G.image_to_source(L.t, F.col("w"), F.col("h")), "x y"),
    {"x": f"round(x2::DOUBLE + w * ({_SX}))::BIGINT", "y": f"round(y2::DOUBLE + h * ({_SY}))::BIGINT"},
)
_add(
    "source_to_image",
    lambda: _of(G.source_to_image(L.t, F.col("x"), F.col("y")), "x y"),
    {"x": f"round((x - x2)::DOUBLE / ({_SX}))::BIGINT", "y": f"round((y - y2)::DOUBLE / ({_SY}))::BIGINT"},
)
_add(
    "resize_dims_width",
    lambda: _of(G.dims_for_width(*L.wh, F.col("pad") + 1), "width height"),
    {"width": "pad + 1", "height": "greatest(round(h2::DOUBLE * (pad + 1) / w2)::BIGINT, 1)"},
)
_add(
    "resize_dims_height",
    lambda: _of(G.dims_for_height(*L.wh, F.col("pad") + 1), "width height"),
    {"width": "greatest(round(w2::DOUBLE * (pad + 1) / h2)::BIGINT, 1)", "height": "pad + 1"},
)
_add(
    "resize_dims_scale",
    lambda: _of(G.dims_for_scale(*L.wh, (F.col("pad") + 1) / F.lit(16.0)), "width height"),
    {
        "width": "greatest(round(w2 * ((pad + 1) / 16.0::DOUBLE))::BIGINT, 1)",
        "height": "greatest(round(h2 * ((pad + 1) / 16.0::DOUBLE))::BIGINT, 1)",
    },
)
_add(
    "effective_width",
    lambda: {
        "kind": L.kind,
        "value": G.effective_width(*L.wh, L.kind, F.when(L.kind == "scale", (F.col("pad") + 1) / 16.0).otherwise(F.col("pad") + 1)),
    },
    {
        "kind": "['none', 'width', 'height', 'scale'][id % 4 + 1]",
        "value": "CASE id % 4 WHEN 1 THEN pad + 1 WHEN 2 THEN greatest((w2 * (pad + 1)) // h2, 1) "
        "WHEN 3 THEN greatest(round(w2 * ((pad + 1) / 16.0::DOUBLE))::BIGINT, 1) ELSE w2 END",
    },
)
_add("age", lambda: {"age_us": G.age(F.col("x"), F.col("x2"))}, {"age_us": "greatest(x - x2, 0)"})
_add("byte_len", lambda: {"bytes": G.byte_len(*L.wh)}, {"bytes": "w2 * h2 * 3"})
_add(
    "frame_rect",
    lambda: {**_of(G.rect(F.lit(0), F.lit(0), *L.wh), prefix="frame_"), **_of(L.b, prefix="source_")},
    {
        "frame_x": "0", "frame_y": "0", "frame_width": "w2", "frame_height": "h2",
        "source_x": "x2", "source_y": "y2", "source_width": "w2", "source_height": "h2",
    },
)
_add(
    "capture_region",
    lambda: {"status": F.when(G.is_empty(L.a) | ~G.within(L.a, L.bounds), "invalid_region").otherwise("ok")},
    {"status": f"CASE WHEN w = 0 OR h = 0 OR NOT ({_INSIDE}) THEN 'invalid_region' ELSE 'ok' END"},
)
_VISIBLE = "least(x2 + w2, 1920) - greatest(x2, 0) > 0 AND least(y2 + h2, 1080) - greatest(y2, 0) > 0"
_add(
    "capture_window",
    lambda: {"status": F.when(L.seen.isNull(), "capture_failed").otherwise("ok"), **_of(L.seen)},
    {
        "status": f"CASE WHEN {_VISIBLE} THEN 'ok' ELSE 'capture_failed' END",
        "x": f"CASE WHEN {_VISIBLE} THEN greatest(x2, 0) END",
        "y": f"CASE WHEN {_VISIBLE} THEN greatest(y2, 0) END",
        "width": f"CASE WHEN {_VISIBLE} THEN least(x2 + w2, 1920) - greatest(x2, 0) END",
        "height": f"CASE WHEN {_VISIBLE} THEN least(y2 + h2, 1080) - greatest(y2, 0) END",
    },
)
_add(
    "capture_size_guard",
    lambda: {"status": F.when((F.col("w") == 0) | (F.col("h") == 0) | (G.area(L.a) * 50_000 > 1 << 32), "capture_failed").otherwise("ok")},
    {"status": "CASE WHEN w = 0 OR h = 0 OR w * h * 50000 > 4294967296 THEN 'capture_failed' ELSE 'ok' END"},
)
_add(
    "source_geometry_constructors",
    lambda: {
        "kind": F.when(F.col("id") % 3 == 0, "desktop").when(F.col("id") % 3 == 1, "region").otherwise("window"),
        "window_id": F.when(F.col("id") % 3 == 2, F.concat(F.lit("0x"), F.lower(F.hex("id")))),
        "source_x": F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("x2")),
        "source_y": F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("y2")),
    },
    {
        "kind": "CASE id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'region' ELSE 'window' END",
        "window_id": "CASE WHEN id % 3 = 2 THEN '0x' || lower(printf('%x', id)) END",
        "source_x": "CASE WHEN id % 3 = 0 THEN 0 ELSE x2 END",
        "source_y": "CASE WHEN id % 3 = 0 THEN 0 ELSE y2 END",
    },
)
_add("hex_window_id", lambda: {"text": F.concat(F.lit("0x"), F.lower(F.hex("id")))}, {"text": "'0x' || lower(printf('%x', id))"})
