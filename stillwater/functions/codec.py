"""Image encoders: baseline JPEG and RGB PNG, in Arrow batches; the transform of all blocks of an image at once."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import EngineError
from .codec_math import CHROMA, LUMA, ZIGZAG

# The standard Huffman tables, numbers of codes by length and the coded values in order.
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = (
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    [
        0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07,
        0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0,
        0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28,
        0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49,
        0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69,
        0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89,
        0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7,
        0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5,
        0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
        0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
        0xF9, 0xFA,
    ],
)
AC_CHROMA = (
    [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
    [
        0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71,
        0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0,
        0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26,
        0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48,
        0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68,
        0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87,
        0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5,
        0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
        0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
        0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
        0xF9, 0xFA,
    ],
)

#: zlib levels of the PNG efforts.
EFFORTS = {"fast": 1, "default": 6, "best": 9}

_k = np.arange(8)
_BASIS = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * 0.5
_BASIS[0] *= np.sqrt(0.5)
_ORDER = np.array(ZIGZAG)


def huffman_codes(table: tuple[list[int], list[int]]) -> dict[int, str]:
    """Canonical codes, as bits, by value."""
    codes, code, at = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for value in table[1][at : at + n]:
            codes[value] = format(code, f"0{length}b")
            code += 1
        at, code = at + n, code << 1
    return codes


_CODES = {k: huffman_codes(t) for k, t in (("dl", DC_LUMA), ("dc", DC_CHROMA), ("al", AC_LUMA), ("ac", AC_CHROMA))}


def quant_table(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def _planes(rgb: np.ndarray) -> list[np.ndarray]:
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    return [
        np.clip(p, 0, 255)
        for p in (
            (77 * r + 150 * g + 29 * b + 128) >> 8,
            ((-43 * r - 85 * g + 128 * b + 128) >> 8) + 128,
            ((128 * r - 107 * g - 21 * b + 128) >> 8) + 128,
        )
    ]


def _coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of all blocks, in coding order; edges are repeated to whole blocks."""
    h, w = plane.shape
    padded = np.pad(plane, ((0, -h % 8), (0, -w % 8)), "edge") - 128.0
    rows, columns = padded.shape[0] // 8, padded.shape[1] // 8
    blocks = padded.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    c = (_BASIS @ blocks @ _BASIS.T).astype(np.float32).reshape(-1, 64) / table
    return np.clip(np.trunc(c + np.copysign(0.5, c)), -1023, 1023).astype(int)[:, _ORDER]


def _magnitude(v: int) -> tuple[int, str]:
    """Category of a value and its extra bits."""
    n = abs(v).bit_length()
    return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def _block_bits(block: np.ndarray, before: int, dc: dict[int, str], ac: dict[int, str]) -> str:
    n, extra = _magnitude(int(block[0]) - before)
    out, run = [dc[n], extra], 0
    last = int(np.flatnonzero(block)[-1]) if block.any() else 0
    for v in block[1 : last + 1].tolist():
        if v == 0:
            run += 1
            continue
        out.append(ac[0xF0] * (run // 16))
        n, extra = _magnitude(v)
        out += [ac[(run % 16) << 4 | n], extra]
        run = 0
    if last < 63:
        out.append(ac[0])
    return "".join(out)


def encode_jpeg(rgb: np.ndarray, quality: int = 80) -> bytes:
    """Baseline JFIF without chroma subsampling of an array (height, width, 3)."""
    if not 1 <= quality <= 100:
        raise EngineError("encode_failed", f"quality {quality} is not in 1 to 100")
    h, w = rgb.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise EngineError("encode_failed", f"{w}x{h} does not fit")
    tables = [quant_table(LUMA, quality), quant_table(CHROMA, quality)]
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")]
    out += [segment(0xDB, bytes([i]) + bytes(t[_ORDER].tolist())) for i, t in enumerate(tables)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])))
    for place, (bits, values) in ((0x00, DC_LUMA), (0x10, AC_LUMA), (0x01, DC_CHROMA), (0x11, AC_CHROMA)):
        out.append(segment(0xC4, bytes([place]) + bytes(bits) + bytes(values)))
    out.append(segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0])))
    planes = [_coefficients(p, tables[min(i, 1)]) for i, p in enumerate(_planes(rgb))]
    before, bits = [0, 0, 0], []
    for k in range(len(planes[0])):
        for i, plane in enumerate(planes):
            kind = "l" if i == 0 else "c"
            bits.append(_block_bits(plane[k], before[i], _CODES["d" + kind], _CODES["a" + kind]))
            before[i] = int(plane[k][0])
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
    return b"".join([*out, data, b"\xff\xd9"])


def encode_png(rgb: np.ndarray, effort: str = "default") -> bytes:
    """8-bit RGB PNG of an array (height, width, 3)."""
    if effort not in EFFORTS:
        raise EngineError("invalid_arguments", f"unsupported PNG compression {effort!r}")
    h, w = rgb.shape[:2]
    raw = np.concatenate((np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)), 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, EFFORTS[effort])) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """The array of an 8-bit RGB PNG without interlacing, any row filter."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise EngineError("image_load_failed", "not a PNG")
    at, body, h, w = 8, b"", 0, 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack_from(">IIBB", part)
            if (depth, colour) != (8, 2):
                raise EngineError("image_load_failed", "not 8-bit RGB")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    raw, stride = zlib.decompress(body), 3 * w + 1
    out = np.zeros((h, 3 * w), np.uint8)
    for y in range(h):
        line = np.frombuffer(raw, np.uint8, 3 * w, y * stride + 1).astype(int)
        above = out[y - 1].astype(int) if y else np.zeros(3 * w, int)
        kind = raw[y * stride]
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            line = line.copy()
            for x in range(3 * w):
                a, b, c = (line[x - 3] if x >= 3 else 0), above[x], (above[x - 3] if x >= 3 else 0)
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else paeth)) & 255
        out[y] = line & 255
    return out.reshape(h, w, 3)


def encode(frames: DataFrame, keys: list[str]) -> DataFrame:
    """keys, format, data of packed frames (keys, width, height, data BINARY, format, quality, effort).

    Rows with the format metadata get no data.
    """
    schema = [f for f in frames.schema.fields if f.name in keys]
    kind = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema] + ["format string", "data binary"])
    names = [f.name for f in schema]

    def run(batches):
        for b in batches:
            made = []
            for r in b.itertuples(index=False):
                rgb = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) if r.format != "metadata" else None
                made.append(None if rgb is None else encode_jpeg(rgb, r.quality) if r.format == "jpeg" else encode_png(rgb, r.effort))
            yield pd.DataFrame({**{k: b[k] for k in names}, "format": b["format"], "data": made})

    return frames.select(*names, "width", "height", "data", "format", "quality", "effort").mapInPandas(run, kind)
