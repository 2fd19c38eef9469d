"""Queries of parsers, formatters and codec arithmetic, over texts made from orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec_math as M
from ..functions import parsing as P
from ..sources.tables import table
from .registry import query, scalar

_INPUTS = {
    "id": "o_orderkey",
    "region": "CASE WHEN o_custkey % 9 = 0 THEN 'x,1,2,3' WHEN o_custkey % 9 = 1 THEN '1,2,3' WHEN o_custkey % 9 = 2 THEN '' "
    "ELSE concat(' ', CAST(o_custkey % 300 - 50 AS STRING), ' ,', CAST(o_orderkey % 200 AS STRING), ', ', CAST(o_orderkey % 50 AS STRING), ',', "
    "CAST(o_custkey % 60 AS STRING)) END",
    "suffix": "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '@all' WHEN 2 THEN '@newest' WHEN 3 THEN '@older,!17' WHEN 4 THEN '@!300' "
    "WHEN 5 THEN '@newest!180' ELSE '@!7,!9,all' END",
    "name": "CASE WHEN o_custkey % 11 = 0 THEN '' ELSE concat('hud', CAST(o_custkey % 5 AS STRING)) END",
    "number": "CASE o_custkey % 8 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN '-4' WHEN 4 THEN ' 7 ' "
    "ELSE CAST(o_orderkey % 400 AS STRING) END",
    "window": "CASE o_custkey % 6 WHEN 0 THEN '0x1f' WHEN 1 THEN '0X00A' WHEN 2 THEN 'zz' WHEN 3 THEN '0' WHEN 4 THEN '0xg' ELSE CAST(o_orderkey AS STRING) END",
    "decimal": "CASE o_custkey % 6 WHEN 0 THEN 'nan' WHEN 1 THEN '-0.5' WHEN 2 THEN '0.25' WHEN 3 THEN '1e-3' WHEN 4 THEN '1.5' ELSE concat('0.', CAST(o_orderkey % 97 AS STRING)) END",
    "duration": "CASE o_custkey % 7 WHEN 0 THEN '5' WHEN 1 THEN '' WHEN 2 THEN concat(CAST(o_orderkey % 900 AS STRING), 'ms') WHEN 3 THEN '-1s' "
    "WHEN 4 THEN concat(CAST(o_orderkey % 9 AS STRING), '.25s') WHEN 5 THEN 'fasts' ELSE ' 1.5 s ' END",
    "kind": "CASE o_orderkey % 6 WHEN 0 THEN 'PNG' WHEN 1 THEN 'jpg' WHEN 2 THEN 'Jpeg' WHEN 3 THEN 'gif' WHEN 4 THEN 'exact' ELSE 'rgb' END",
    "quality": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 100 + 1 AS INT) END",
    "flag1": "o_custkey % 2 = 0",
    "flag2": "o_orderkey % 3 = 0",
    "flag3": "o_custkey % 5 < 2",
    "k": "CAST(o_orderkey % 4096 AS BIGINT)",
    "k2": "CAST(o_custkey % 1000 AS BIGINT)",
}
_SQL = "SELECT " + ", ".join(f"{t} AS {c}" for c, t in _INPUTS.items()).replace("AS STRING", "AS VARCHAR") + " FROM orders"


def _inputs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{t} AS {c}" for c, t in _INPUTS.items()])


def _add(name, columns, texts):
    scalar(name, _inputs, _SQL, ["id"], columns, texts)


_c = lambda name: F.col(name)
_REGION = "regexp_matches(region, '^ *[+-]?[0-9]+ *, *[+-]?[0-9]+ *, *\\+?[0-9]+ *, *\\+?[0-9]+ *$') AND TRY_CAST(trim(split_part(region, ',', 3)) AS BIGINT) > 0 AND TRY_CAST(trim(split_part(region, ',', 4)) AS BIGINT) > 0"
_PART = lambda i: f"CASE WHEN {_REGION} THEN CAST(trim(split_part(region, ',', {i})) AS BIGINT) END"
_add(
    "parse_region",
    lambda: {c: P.parse_region(_c("region"))[c] for c in ("x", "y", "width", "height")},
    {"x": _PART(1), "y": _PART(2), "width": _PART(3), "height": _PART(4)},
)
_GOOD = f"name <> '' AND ({_REGION}) AND suffix NOT IN ('@!300', '@newest!180')"
_add(
    "parse_region_policy",
    lambda: (lambda r: {"name_": r["name"], "x": r["rect"]["x"], "scope": r["scope"], "priority": r["priority"]})(
        P.parse_region_policy(F.concat("name", F.lit("="), "region", "suffix"))
    ),
    {
        "name_": f"CASE WHEN {_GOOD} THEN name END",
        "x": f"CASE WHEN {_GOOD} THEN {_PART(1)} END",
        "scope": f"CASE WHEN {_GOOD} THEN CASE suffix WHEN '@all' THEN 'all' WHEN '@newest' THEN 'newest' WHEN '@older,!17' THEN 'older' WHEN '@!7,!9,all' THEN 'all' END END",
        "priority": f"CASE WHEN {_GOOD} THEN CASE suffix WHEN '@older,!17' THEN 17 WHEN '@!7,!9,all' THEN 9 END END",
    },
)
_add(
    "parse_window_id",
    lambda: {"window_id": P.parse_window_id(_c("window"))},
    {"window_id": "CASE \"window\" WHEN '0x1f' THEN 31 WHEN '0X00A' THEN 10 WHEN 'zz' THEN NULL WHEN '0' THEN NULL WHEN '0xg' THEN NULL ELSE TRY_CAST(\"window\" AS BIGINT) END"},
)
_COUNT = "TRY_CAST(CASE WHEN regexp_matches(trim(number), '^[0-9]+$') THEN trim(number) END AS BIGINT)"
for _name, _most in (("parse_frame_id", None), ("parse_frame_count", 8), ("parse_history_capacity", 256)):
    _add(
        _name,
        (lambda most: lambda: {"value": P.parse_count(_c("number"), most)})(_most),
        {"value": f"CASE WHEN {_COUNT} >= 1" + (f" AND {_COUNT} <= {_most}" if _most else "") + f" THEN {_COUNT} END"},
    )
_DECIMAL = "TRY_CAST(CASE WHEN decimal <> 'nan' THEN decimal END AS DOUBLE)"
_add("parse_scale", lambda: {"value": P.parse_scale(_c("decimal"))}, {"value": f"CASE WHEN {_DECIMAL} > 0 THEN {_DECIMAL} END"})
_add(
    "parse_area_threshold",
    lambda: {"value": P.parse_area_threshold(_c("decimal"))},
    {"value": f"CASE WHEN {_DECIMAL} BETWEEN 0 AND 1 THEN {_DECIMAL} END"},
)
_add(
    "parse_duration",
    lambda: {"nanos": P.parse_duration(_c("duration"))},
    {
        "nanos": "CASE WHEN regexp_matches(trim(duration), '^[0-9.]+ *ms$') THEN round(CAST(trim(replace(duration, 'ms', '')) AS DOUBLE) * 1e6)::BIGINT "
        "WHEN regexp_matches(trim(duration), '^[0-9.]+ *s$') THEN round(CAST(trim(replace(duration, 's', '')) AS DOUBLE) * 1e9)::BIGINT END"
    },
)
_FORMAT = "CASE lower(kind) WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'jpeg' THEN 'jpeg' END"
_add("format_name", lambda: {"format": P.format_name(_c("kind"))}, {"format": _FORMAT})
_add(
    "mode_name",
    lambda: {"mode": P.mode_name(_c("kind"))},
    {"mode": "CASE WHEN kind = 'exact' THEN 'exact' WHEN kind IN ('rgb', 'rgb_threshold', 'threshold') THEN 'rgb' END"},
)
_add(
    "media_type",
    lambda: {"media": P.media_type(P.format_name(_c("kind")))},
    {"media": f"CASE {_FORMAT} WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' END"},
)
_add(
    "resolve_format",
    lambda: {"format": P.resolve_format(F.when(_c("flag1"), _c("kind")), F.when(_c("flag2"), F.lit("-")).otherwise(F.concat(F.lit("a/b."), "kind")))},
    {"format": f"CASE WHEN flag1 THEN {_FORMAT} WHEN flag2 THEN 'png' ELSE coalesce({_FORMAT}, 'png') END"},
)
_add(
    "resolve_quality",
    lambda: (lambda r: {"value": r["quality"], "status": r["status"]})(P.resolve_quality(_c("quality"), F.when(_c("flag1"), "png").otherwise("jpeg"))),
    {
        "value": "CASE WHEN quality IS NULL THEN 80 WHEN flag1 THEN NULL ELSE quality END",
        "status": "CASE WHEN quality IS NOT NULL AND flag1 THEN 'invalid_arguments' ELSE 'ok' END",
    },
)
_EFFORT = "CASE k2 % 5 WHEN 0 THEN 'fast' WHEN 1 THEN 'default' WHEN 2 THEN 'best' WHEN 3 THEN 'slow' END"
_add(
    "resolve_compression",
    lambda: (lambda r: {"effort": r["effort"], "status": r["status"]})(P.resolve_compression(F.expr(_EFFORT), F.when(_c("flag1"), "png").otherwise("jpeg"))),
    {
        "effort": f"CASE WHEN k2 % 5 = 4 THEN 'default' WHEN flag1 AND k2 % 5 < 3 THEN {_EFFORT} END",
        "status": "CASE WHEN k2 % 5 = 4 OR flag1 AND k2 % 5 < 3 THEN 'ok' ELSE 'invalid_arguments' END",
    },
)
_add(
    "resolve_resize",
    lambda: {"kind_": P.resolve_resize(F.when(_c("flag1"), 1), F.when(_c("flag2"), 1), F.when(_c("flag3"), 1))},
    {"kind_": "CASE WHEN flag1 AND flag2 THEN NULL WHEN flag1 THEN 'width' WHEN flag2 THEN 'height' WHEN flag3 THEN 'scale' ELSE 'none' END"},
)
_add(
    "resolve_target",
    lambda: {"target": P.resolve_target(F.when(_c("flag1"), 1), F.when(_c("flag2"), 1))},
    {"target": "CASE WHEN flag1 THEN 'window' WHEN flag2 THEN 'region' ELSE 'desktop' END"},
)
_add(
    "resolve_display",
    lambda: {"display": P.resolve_display(F.when(_c("flag1"), F.lit(":1")), F.when(_c("flag2"), F.lit(":0")))},
    {"display": "CASE WHEN flag1 THEN ':1' WHEN flag2 THEN ':0' END"},
)
_add(
    "resolve_temporal",
    lambda: {
        "interval_ms": F.coalesce(F.when(_c("flag1"), _c("k")), F.lit(100)),
        "timeout_ms": F.coalesce(F.when(_c("flag2"), _c("k")), F.lit(5000)),
        "stable_ms": F.coalesce(F.when(_c("flag3"), _c("k")), F.lit(300)),
    },
    {
        "interval_ms": "CASE WHEN flag1 THEN k ELSE 100 END",
        "timeout_ms": "CASE WHEN flag2 THEN k ELSE 5000 END",
        "stable_ms": "CASE WHEN flag3 THEN k ELSE 300 END",
    },
)
_add(
    "base64_encode",
    lambda: {"text": P.base64_line(F.encode(F.repeat("region", F.lit(12)), "UTF-8")), "length": P.base64_length(F.octet_length(F.repeat("region", F.lit(12))))},
    {"text": "to_base64(encode(repeat(region, 12)))", "length": "length(to_base64(encode(repeat(region, 12))))"},
)
_add(
    "base64_decode",
    lambda: {"text": F.decode(F.unbase64(P.base64_line(F.encode("region", "UTF-8"))), "UTF-8")},
    {"text": "region"},
)
_BODY = "CASE WHEN flag1 THEN '{\"request_id\":\"r' || k || '\",\"method\":\"ping\"}' WHEN flag2 THEN '{\"method\":\"ping\"}' ELSE 'not json' END"


def _body():
    return F.when(_c("flag1"), F.concat(F.lit('{"request_id":"r'), "k", F.lit('","method":"ping"}'))).when(_c("flag2"), F.lit('{"method":"ping"}')).otherwise("not json")


_add("salvage_request_id", lambda: {"request_id": P.salvage_request_id(_body())}, {"request_id": "CASE WHEN flag1 THEN 'r' || k ELSE '' END"})
_add(
    "frame_message",
    lambda: {"wire": F.hex(P.frame_message(F.when(_c("flag3"), F.lit("")).otherwise(_body())))},
    {"wire": f"CASE WHEN NOT flag3 THEN upper(printf('%08x', strlen({_BODY})) || hex({_BODY})) END"},
)
def _wire():
    """What a connection may hold: nothing, half a length, a length of zero, too long a one, half a body, or a message."""
    head, kind = P.frame_message(_body()), F.pmod(_c("k"), F.lit(8))
    return (
        F.when(kind == 0, F.unhex(F.lit("")))
        .when(kind == 1, F.unhex(F.lit("0000")))
        .when(kind == 2, F.unhex(F.lit("00000000")))
        .when(kind == 3, F.unhex(F.lit("04000001")))
        .when(kind == 4, F.substring(head, 1, 7))
        .otherwise(F.concat(head, F.unhex(F.lit("FF"))))  # and the start of the next
    )


_add(
    "read_incoming",
    lambda: {c: P.incoming(_wire())[c] for c in ("status", "request_id", "detail")},
    {
        "status": "CASE WHEN k % 8 = 0 THEN 'closed' WHEN k % 8 > 4 AND (flag1 OR flag2) THEN 'ok' ELSE 'service_protocol_error' END",
        "request_id": "CASE WHEN k % 8 > 4 AND flag1 THEN 'r' || k ELSE '' END",
        "detail": "CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'could not read a message length' WHEN 2 THEN 'a message length of zero' "
            "WHEN 3 THEN 'message of 67108865 bytes exceeds the 67108864 byte limit' WHEN 4 THEN 'could not read a message body' "
            "ELSE CASE WHEN NOT flag1 AND NOT flag2 THEN 'could not decode a message' END END",
    },
)


def _envelope():
    """A request without a version, or with one of 0 to 2."""
    version = F.when(_c("flag3"), F.concat(F.lit(',"protocol_version":'), (_c("k2") % 3).cast("string"))).otherwise("")
    return F.concat(F.lit('{"request_id":"r'), _c("k").cast("string"), F.lit('","method":"ping"'), version, F.lit("}"))


_add(
    "handle_envelope",
    lambda: {c: P.handled(_envelope())[c] for c in ("request_id", "ok", "code", "message")},
    {
        "request_id": "'r' || k",
        "ok": "NOT flag3 OR k2 % 3 = 1",
        "code": "CASE WHEN flag3 AND k2 % 3 <> 1 THEN 'service_protocol_error' END",
        "message": "CASE WHEN flag3 AND k2 % 3 <> 1 THEN 'service protocol error: protocol version ' || k2 % 3 || ' is not supported; "
            "this service speaks version 1. The client and the service are probably different builds.' END",
    },
)
_add(
    "route_output",
    lambda: (lambda r: {c: r[c] for c in ("status", "write_image_bytes", "metadata")})(P.route_output(_c("flag1"), _c("flag2"), _c("flag3"))),
    {
        "status": "CASE WHEN flag2 AND NOT flag1 THEN 'invalid_arguments' ELSE 'ok' END",
        "write_image_bytes": "CASE WHEN flag2 AND NOT flag1 THEN NULL ELSE NOT (flag1 AND flag2 AND flag3) END",
        "metadata": "CASE WHEN flag2 AND NOT flag1 THEN NULL WHEN NOT flag1 THEN 'none' WHEN flag3 AND NOT flag2 THEN 'stderr' ELSE 'stdout' END",
    },
)
_add(
    "derived_floors",
    lambda: (lambda r: {"min_width": r["min_width"], "min_quality": r["min_quality"]})(
        P.derived_floors(F.expr("CASE k % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'width' WHEN 2 THEN 'height' ELSE 'scale' END"), _c("k"), _c("quality"), 0.75, 10)
    ),
    {
        "min_width": "CASE WHEN k % 4 IN (1, 2) THEN greatest(floor(k * 0.75::DOUBLE)::BIGINT, 16) END",
        "min_quality": "CASE WHEN quality IS NULL THEN 40 ELSE greatest(quality - 10, 10) END",
    },
)
_add(
    "detect_format_by_content",
    lambda: {"format": P.detect_format(F.unhex(F.expr("CASE k % 4 WHEN 0 THEN '89504E470D0A1A0A00' WHEN 1 THEN 'FFD8FFE0' WHEN 2 THEN '' ELSE '474946' END")))},
    {"format": "CASE k % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END"},
)
_add("wire_conversions", lambda: {"ms": P.wire_ms(_c("k") * 777)}, {"ms": "k * 777 // 1000"})
_MASK = "CASE WHEN k2 % 5 = 0 THEN 0 WHEN k2 % 5 = 1 THEN 10 ELSE ((1 << (k2 % 9 + 1)::INT) - 1) << (k % 16)::INT END"
_add(
    "decode_channel_masks",
    lambda: (lambda r: {"shift": r["shift"], "bits": r["bits"]})(
        P.mask_info(F.expr("CASE WHEN k2 % 5 = 0 THEN 0L WHEN k2 % 5 = 1 THEN 10L ELSE shiftleft(shiftleft(1L, CAST(k2 % 9 + 1 AS INT)) - 1, CAST(k % 16 AS INT)) END"))
    ),
    {"shift": "CASE WHEN k2 % 5 > 1 THEN k % 16 END", "bits": "CASE WHEN k2 % 5 > 1 THEN k2 % 9 + 1 END"},
)
_add(
    "scale_channel_to_u8",
    lambda: {"five": P.scale_channel(_c("k") % 32, 5), "six": P.scale_channel(_c("k") % 64, 6), "eight": P.scale_channel(_c("k") % 256, 8)},
    {"five": "round((k % 32) * 255.0::DOUBLE / 31)::INT", "six": "round((k % 64) * 255.0::DOUBLE / 63)::INT", "eight": "k % 256"},
)
_add(
    "unpack_native_pixels",
    lambda: {
        **{f"t_{c}": P.unpack_pixel(_c("k") * 4093, (16, 8), (8, 8), (0, 8))[c] for c in "rgb"},
        **{f"h_{c}": P.unpack_pixel(_c("k") * 13, (11, 5), (5, 6), (0, 5))[c] for c in "rgb"},
    },
    {
        "t_r": "(k * 4093) // 65536 % 256", "t_g": "(k * 4093) // 256 % 256", "t_b": "(k * 4093) % 256",
        "h_r": "round(((k * 13) // 2048 % 32) * 255.0::DOUBLE / 31)::INT", "h_g": "round(((k * 13) // 32 % 64) * 255.0::DOUBLE / 63)::INT",
        "h_b": "round(((k * 13) % 32) * 255.0::DOUBLE / 31)::INT",
    },
)
_add(
    "normalise_to_rgb8",
    lambda: (lambda r: {c: r[c] for c in "rgb"})(M.normalise((_c("k") % 4 + 1), _c("k") % 256, _c("k2") % 256, (_c("k") + _c("k2")) % 256)),
    {
        "r": "CASE WHEN k % 4 + 1 <= 2 THEN k % 256 ELSE (k + k2) % 256 END",
        "g": "CASE WHEN k % 4 + 1 <= 2 THEN k % 256 ELSE k2 % 256 END",
        "b": "k % 256",
    },
)
_RGB = "k % 256", "k2 % 256", "(k + k2) % 256"
_R, _G, _B = _RGB
_add(
    "rgb_to_ycbcr",
    lambda: (lambda r: {c: r[c] for c in ("y", "cb", "cr")})(M.ycbcr(_c("k") % 256, _c("k2") % 256, (_c("k") + _c("k2")) % 256)),
    {
        "y": f"least(greatest((77 * ({_R}) + 150 * ({_G}) + 29 * ({_B}) + 128) >> 8, 0), 255)",
        "cb": f"least(greatest(floor((-43 * ({_R}) - 85 * ({_G}) + 128 * ({_B}) + 128) / 256.0::DOUBLE)::BIGINT + 128, 0), 255)",
        "cr": f"least(greatest(floor((128 * ({_R}) - 107 * ({_G}) - 21 * ({_B}) + 128) / 256.0::DOUBLE)::BIGINT + 128, 0), 255)",
    },
)


@query("jpeg_quant_table", f"SELECT q, p AS place, least(greatest((v[p + 1] * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END + 50) // 100, 1), 255) AS value "
       f"FROM (SELECT {M.LUMA} AS v), (SELECT unnest(range(1, 101)) AS q), (SELECT unnest(range(64)) AS p)")  # fmt: skip
def jpeg_quant_table(spark, sf_dir):
    q = spark.range(1, 101).select(F.col("id").alias("q"))
    rows = q.select("q", F.posexplode(F.array(*[F.lit(v) for v in M.LUMA])).alias("place", "v"))
    return rows.select("q", "place", M.quant_value(F.col("v"), F.col("q")).alias("value"))


@query("zigzag", "SELECT row_number() OVER (ORDER BY s, CASE WHEN s % 2 = 0 THEN -y ELSE y END) - 1 AS step, y * 8 + x AS place "
       "FROM (SELECT p % 8 AS x, p // 8 AS y, p % 8 + p // 8 AS s FROM (SELECT unnest(range(64)) AS p))")  # fmt: skip
def zigzag(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(M.ZIGZAG)), "step long, place long")


_BLOCKS = """WITH f AS (SELECT vec_id, pos, (floor(embedding[pos + 1]::DOUBLE * 128) + 128)::INT - 128 AS v
  FROM embeddings, (SELECT unnest(range(64)) AS pos))
SELECT vec_id, u, w, {} FROM (
  SELECT vec_id, u, w, 0.25::DOUBLE * CASE WHEN u = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END * CASE WHEN w = 0 THEN sqrt(0.5::DOUBLE) ELSE 1 END
    * sum(v * cos((2 * (pos % 8) + 1) * u * pi() / 16) * cos((2 * (pos // 8) + 1) * w * pi() / 16)) AS c
  FROM f, (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS w) GROUP BY vec_id, u, w)"""


def _blocks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 128))
    return M.dct(e.select("vec_id", v.alias("v")), ["vec_id"])


@query("dct_8x8", _BLOCKS.format("round(c, 6) + 0 AS c"))
def dct_8x8(spark, sf_dir):
    return _blocks(spark, sf_dir).select("vec_id", "u", "w", (F.round("c", 6) + 0).alias("c"))


@query("quantise", _BLOCKS.format("least(greatest(round(round(c, 6) / 16)::INT, -1023), 1023) AS q"))
def quantise(spark, sf_dir):
    return _blocks(spark, sf_dir).select("vec_id", "u", "w", M.quantised(F.round("c", 6), F.lit(16)).alias("q"))
