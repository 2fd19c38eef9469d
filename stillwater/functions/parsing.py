"""Parsers and formatters of arguments, as columns: a struct of the value and whether the text is valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"^[+-]?[0-9]+$"
_UNSIGNED = r"^\+?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _int(text: Column, low: int, high: int, pattern: str = _INT) -> Column:
    """The integer of a text, or null when it is none or out of range."""
    value = F.when(text.rlike(pattern), text.try_cast("decimal(38,0)"))
    return F.when(value.between(low, high), value.cast("long"))


def _float(text: Column) -> Column:
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def parse_region(text: Column) -> Column:
    """X,Y,W,H with spaces around, four parts, not empty: struct(x, y, width, height) or null."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    part = lambda i: F.get(parts, F.lit(i))
    x, y = _int(part(0), -(1 << 31), (1 << 31) - 1), _int(part(1), -(1 << 31), (1 << 31) - 1)
    w, h = _int(part(2), 1, (1 << 32) - 1, _UNSIGNED), _int(part(3), 1, (1 << 32) - 1, _UNSIGNED)
    good = (F.size(parts) == 4) & x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(good, F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height")))


def parse_region_policy(text: Column) -> Column:
    """NAME=X,Y,W,H[@part,...], part one of all, newest, older, !0-255: struct(name, rect, scope, priority) or null.

    The last part of a kind counts.
    """
    name = F.regexp_extract(text, "^([^=]+)=", 1)
    rest = F.regexp_extract(text, "(?s)^[^=]+=(.*)$", 1)
    coordinates, suffix = F.substring_index(rest, "@", 1), F.regexp_extract(rest, "(?s)^[^@]*@(.*)$", 1)
    has = F.contains(rest, F.lit("@"))
    parts = F.split(suffix, ",")
    priority = lambda p: _int(F.regexp_extract(p, "(?s)^!(.*)$", 1), 0, 255, _UNSIGNED)
    known = F.forall(parts, lambda p: p.isin("all", "newest", "older") | priority(p).isNotNull())
    scopes = F.filter(parts, lambda p: p.isin("all", "newest", "older"))
    marks = F.filter(F.transform(parts, priority), lambda p: p.isNotNull())
    rect = parse_region(coordinates)
    good = (name != "") & rect.isNotNull() & (~has | known)
    return F.when(
        good,
        F.struct(
            name.alias("name"),
            rect.alias("rect"),
            F.when(has, F.get(scopes, F.size(scopes) - 1)).alias("scope"),
            F.when(has, F.get(marks, F.size(marks) - 1)).alias("priority"),
        ),
    )


def parse_window_id(text: Column) -> Column:
    """A decimal or 0x-prefixed hexadecimal id, not 0, or null."""
    t = F.trim(text)
    hexa = F.regexp_extract(t, "^0[xX]([0-9a-fA-F]{1,15})$", 1)
    value = F.when(hexa != "", F.conv(hexa, 16, 10).cast("long")).otherwise(_int(t, 0, (1 << 63) - 1, _UNSIGNED))
    return F.when(value > 0, value)


def parse_count(text: Column, most: int | None) -> Column:
    """An integer from 1 to ``most``, or null."""
    return _int(F.trim(text), 1, most if most is not None else (1 << 63) - 1, _UNSIGNED)


def parse_scale(text: Column) -> Column:
    value = _float(F.trim(text))
    return F.when((value > 0) & (value < float("inf")), value)


def parse_area_threshold(text: Column) -> Column:
    value = _float(F.trim(text))
    return F.when(value.between(0.0, 1.0), value)


def parse_duration(text: Column) -> Column:
    """Nanoseconds of a non-negative number with the unit ms or s; zero is for the operation to refuse."""
    t = F.trim(text)
    number, unit = F.regexp_extract(t, r"^(.*?)\s*(ms|s)$", 1), F.regexp_extract(t, r"^(.*?)(ms|s)$", 2)
    value = _float(F.trim(number))
    scale = F.when(unit == "ms", F.lit(1e6)).when(unit == "s", F.lit(1e9))
    nanos = F.round(value * scale)
    return F.when((value >= 0) & (nanos < float(1 << 63)), nanos.cast("long"))


def format_name(text: Column) -> Column:
    """png or jpeg, in any case, or null."""
    return F.when(F.lower(text) == "png", "png").when(F.lower(text).isin("jpg", "jpeg"), "jpeg")


def format_of_path(path: Column) -> Column:
    return format_name(F.regexp_extract(path, r"\.([^./]+)$", 1))


def resolve_format(explicit: Column, path: Column) -> Column:
    """The named format, else the output path's, else png; null when the named one is unknown."""
    by_path = F.when(path != "-", format_of_path(path))
    return F.when(explicit.isNotNull(), format_name(explicit)).otherwise(F.coalesce(by_path, F.lit("png")))


def mode_name(text: Column) -> Column:
    """exact or rgb, or null."""
    return F.when(text == "exact", "exact").when(text.isin("rgb", "rgb_threshold", "threshold"), "rgb")


def media_type(name: Column) -> Column:
    return F.when(name == "png", "image/png").when(name == "jpeg", "image/jpeg")


def resolve_quality(quality: Column, image_format: Column) -> Column:
    """struct(quality, status): quality only for jpeg, 80 where none is given."""
    bad = quality.isNotNull() & (image_format == "png")
    return F.struct(
        F.when(~bad, F.coalesce(quality, F.lit(80))).alias("quality"),
        F.when(bad, "invalid_arguments").otherwise("ok").alias("status"),
    )


def resolve_compression(effort: Column, image_format: Column) -> Column:
    """struct(effort, status): an effort (fast, default, best) only for png."""
    bad = effort.isNotNull() & ((image_format == "jpeg") | ~effort.isin("fast", "default", "best"))
    return F.struct(
        F.when(~bad, F.coalesce(effort, F.lit("default"))).alias("effort"),
        F.when(bad, "invalid_arguments").otherwise("ok").alias("status"),
    )


def resolve_resize(width: Column, height: Column, scale: Column) -> Column:
    """kind of a resize: width, height, scale or none; null when width and height are combined."""
    return F.when(width.isNotNull() & height.isNotNull(), None).otherwise(
        F.when(width.isNotNull(), "width").when(height.isNotNull(), "height").when(scale.isNotNull(), "scale").otherwise("none")
    )


def resolve_target(window: Column, region: Column) -> Column:
    return F.when(window.isNotNull(), "window").when(region.isNotNull(), "region").otherwise("desktop")


def resolve_display(flag: Column, environment: Column) -> Column:
    return F.coalesce(flag, environment)


def base64_line(data: Column) -> Column:
    """RFC 4648 text without line breaks."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def base64_length(n: Column) -> Column:
    return (F.floor((n + 2) / 3) * 4).cast("long")


def salvage_request_id(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.request_id"), F.lit(""))


#: Most bytes of a message.
MAX_MESSAGE = 64 << 20


def frame_message(body: Column) -> Column:
    """A message on the wire: length as four big-endian bytes, then the text; null when empty or too long."""
    n = F.octet_length(body)
    head = F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))
    return F.when((n > 0) & (n <= MAX_MESSAGE), F.concat(head, F.encode(body, "UTF-8")))


#: The version that services speak.
PROTOCOL_VERSION = 1


def incoming(wire: Column) -> Column:
    """struct(status, request_id, detail, body) of the bytes read from a connection.

    Nothing read: closed. A length that is cut short, zero or above MAX_MESSAGE (told before any of the body is read), a
    body shorter than its length, and a body without a method are protocol errors; of the last the request id is salvaged.
    """
    n = F.octet_length(wire)
    length = F.conv(F.hex(F.substring(wire, 1, 4)), 16, 10).cast("long")
    whole = (n >= 4) & (length.between(1, MAX_MESSAGE)) & (n >= length + 4)
    body = F.when(whole, F.decode(F.substr(wire, F.lit(5), length.cast("int")), "UTF-8"))
    method = F.get_json_object(body, "$.method")
    detail = (
        F.when(n == 0, F.lit(None))
        .when(n < 4, "could not read a message length")
        .when(length == 0, "a message length of zero")
        .when(length > MAX_MESSAGE, F.concat(F.lit("message of "), length, F.lit(f" bytes exceeds the {MAX_MESSAGE} byte limit")))
        .when(n < length + 4, "could not read a message body")
        .when(method.isNull(), "could not decode a message")
    )
    status = F.when(n == 0, "closed").when(detail.isNotNull(), "service_protocol_error").otherwise("ok")
    return F.struct(
        status.alias("status"), F.when(whole, salvage_request_id(body)).otherwise("").alias("request_id"), detail.alias("detail"), body.alias("body")
    )


def handled(body: Column) -> Column:
    """struct(request_id, ok, code, message): a request's answer, whose version, if any, is checked before it is dispatched."""
    version = F.get_json_object(body, "$.protocol_version").cast("long")
    ok = F.coalesce(version == PROTOCOL_VERSION, F.lit(True))
    told = F.concat(
        F.lit("service protocol error: protocol version "), version,
        F.lit(f" is not supported; this service speaks version {PROTOCOL_VERSION}. The client and the service are probably different builds."),
    )
    return F.struct(
        salvage_request_id(body).alias("request_id"), ok.alias("ok"), F.when(~ok, "service_protocol_error").alias("code"), F.when(~ok, told).alias("message")
    )


def route_output(json: Column, base64: Column, stdout: Column) -> Column:
    """struct(status, write_image_bytes, metadata): where bytes and metadata of a capture go."""
    bytes_too = ~(json & base64 & stdout)
    metadata = F.when(~json, "none").when(stdout & bytes_too, "stderr").otherwise("stdout")
    bad = base64 & ~json
    return F.struct(
        F.when(bad, "invalid_arguments").otherwise("ok").alias("status"),
        F.when(~bad, bytes_too).alias("write_image_bytes"),
        F.when(~bad, metadata).alias("metadata"),
    )


def derived_floors(kind: Column, value: Column, quality: Column, fraction: float, drop: int) -> Column:
    """struct(min_width, min_quality) that fitting may reduce a view to, from what was asked for."""
    width = F.when(kind.isin("width", "height"), F.greatest(F.floor(value * F.lit(fraction)).cast("long"), F.lit(16)))
    lowest = F.when(quality.isNull(), 40).otherwise(F.greatest(F.greatest(quality - drop, F.lit(0)), F.lit(10)))
    return F.struct(width.alias("min_width"), lowest.alias("min_quality"))


def detect_format(content: Column) -> Column:
    """png or jpeg by the first bytes, never by the name; null for others."""
    png = F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    jpeg = F.substring(content, 1, 3) == F.unhex(F.lit("FFD8FF"))
    return F.when(png, "png").when(jpeg, "jpeg")


def wire_ms(microseconds: Column) -> Column:
    """Milliseconds on the wire: parts of one are cut off."""
    return F.floor(microseconds / 1000).cast("long")


def mask_info(mask: Column) -> Column:
    """struct(shift, bits) of a channel mask, or null when it is zero or has gaps."""
    low = mask.bitwiseAND(-mask)
    shift = F.round(F.log2(low)).cast("int")
    bits = F.bit_count(mask)
    solid = (mask > 0) & (F.round(mask / F.when(low > 0, low)).cast("long") == F.round(F.pow(F.lit(2.0), bits)).cast("long") - 1)
    return F.when(solid, F.struct(shift.alias("shift"), bits.alias("bits")))


def scale_channel(raw: Column, bits: int) -> Column:
    """A channel value of so many bits as 0 to 255."""
    return raw if bits == 8 else F.round(raw * 255.0 / ((1 << bits) - 1)).cast("int")


def unpack_pixel(word: Column, red: tuple[int, int], green: tuple[int, int], blue: tuple[int, int]) -> Column:
    """struct(r, g, b) of a native pixel word, each channel by (shift, bits)."""
    def channel(shift: int, bits: int) -> Column:
        return scale_channel(F.shiftright(word, shift).bitwiseAND((1 << bits) - 1).cast("int"), bits)

    return F.struct(channel(*red).alias("r"), channel(*green).alias("g"), channel(*blue).alias("b"))
