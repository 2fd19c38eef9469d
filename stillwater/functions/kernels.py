"""Numpy kernels over whole frames or strips of lines: arrays (lines, width, 3) of bytes. Spark deals out the rows."""

from __future__ import annotations

import numpy as np


def pixels(data: bytes, width: int) -> np.ndarray:
    """The array of interleaved RGB bytes, line by line; a view, not a copy."""
    return np.frombuffer(data, np.uint8).reshape(-1, width, 3)


def texture(width: int, height: int, seed: int) -> np.ndarray:
    """n = ((7x + 13y) mod 256) xor seed, with channels n, 3n and n + 91 mod 256."""
    n = ((7 * np.arange(width) + 13 * np.arange(height)[:, None]) % 256 ^ seed).astype(np.uint8)
    return np.stack([n, n * np.uint8(3), n + np.uint8(91)], 2)


def changes(before: np.ndarray, after: np.ndarray, threshold: int) -> tuple[int, int, int, int, int] | None:
    """Changed pixels and the edges of their box (first and last column and line), or none: any channel differs by more."""
    rows = np.flatnonzero((before != after).reshape(len(before), -1).any(1))
    if not len(rows):
        return None
    if len(rows) < len(before):
        before, after = before[rows], after[rows]
    far = np.maximum(before, after) - np.minimum(before, after) > threshold if threshold else before != after
    at = far[..., 0] | far[..., 1] | far[..., 2]
    lines = np.flatnonzero(at.any(1))
    if not len(lines):
        return None
    columns = np.flatnonzero(at.any(0))
    return int(np.count_nonzero(at)), int(columns[0]), int(columns[-1]), int(rows[lines[0]]), int(rows[lines[-1]])


def spans(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the source span of each target index: what it touches, one at least."""
    i = np.arange(target)
    ratio = source / target
    start = np.minimum(np.floor(i * ratio).astype(np.int64), source - 1)
    end = np.minimum(np.maximum(np.ceil((i + 1) * ratio).astype(np.int64), start + 1), source)
    return start, end


def resize(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """Box resampling: means along x, then along y, in 32-bit floats added up in order, rounded half up."""
    lines, columns = rgb.shape[:2]
    if (columns, lines) == (width, height):
        return rgb
    start, end = spans(columns, width)
    if columns % width == 0:  # spans of one length side by side
        sums = rgb.reshape(lines, width, columns // width, 3).sum(2, dtype=np.int32)
    else:
        up_to = np.zeros((lines, columns + 1, 3), np.int32)
        np.cumsum(rgb, axis=1, dtype=np.int32, out=up_to[:, 1:])
        sums = up_to[:, end] - up_to[:, start]
    across = sums.astype(np.float32) / (end - start).astype(np.float32)[:, None]
    start, end = spans(lines, height)
    down = np.zeros((height, width, 3), np.float32)
    for k in range(int((end - start).max())):
        inside = start + k < end
        down[inside] += across[start[inside] + k]
    down /= (end - start).astype(np.float32)[:, None, None]
    return np.clip(np.floor(down.astype(np.float64) + 0.5), 0, 255).astype(np.uint8)
