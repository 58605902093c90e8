"""Numpy kernels for one picture. Spark decides where they run.

A picture is an array (height, width, channels) of bytes in the layout of Spark's
image source: blue, green, red and maybe alpha, or a single gray channel.
"""

from __future__ import annotations

import struct
import zlib

from functools import lru_cache

import numpy as np


def as_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def _luma(img: np.ndarray, red: int, green: int, blue: int, shift: int) -> np.ndarray:
    if img.shape[2] == 1:
        return img[:, :, 0].astype(np.int32)
    b, g, r = (img[:, :, c].astype(np.int32) for c in range(3))
    return (red * r + green * g + blue * b + (1 << (shift - 1))) >> shift


def gray(img: np.ndarray) -> np.ndarray:
    """Q1: BT.601 luma in 14-bit fixed point, as used for the quality measures."""
    return _luma(img, 4899, 9617, 1868, 14)


def gray_for_hash(img: np.ndarray) -> np.ndarray:
    """BT.601 luma in 16-bit fixed point, as used for the perceptual hash."""
    return _luma(img, 19595, 38470, 7471, 16)


def population_variance(values: np.ndarray) -> float:
    """Variance of whole numbers from exact sums, whatever their order.

    The sums are whole and stay below 2**53, so doubles hold them exactly.
    """
    v = values.ravel().astype(np.float64)
    n, total, squares = v.size, int(v.sum()), int(v @ v)
    return (n * squares - total * total) / (n * n)


def laplacian(g: np.ndarray) -> np.ndarray:
    """4-neighbour Laplacian; the border is mirrored without repeating the edge."""
    p = np.pad(g, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def pixel_stats(img: np.ndarray) -> tuple[float, float, float]:
    """Q1-Q4: mean and deviation of gray, variance of the Laplacian."""
    g = gray(img)
    return (
        int(g.sum()) / g.size,
        float(np.sqrt(population_variance(g))),
        population_variance(laplacian(g)),
    )


@lru_cache(maxsize=128)
def _lanczos_weights(src: int, dst: int) -> np.ndarray:
    """Matrix (dst, src) of normalised Lanczos-3 weights, widened when shrinking. Kept, as sizes recur: not to be written to."""
    scale = src / dst
    widen = max(scale, 1.0)
    centre = (np.arange(dst) + 0.5) * scale
    x = (np.arange(src)[None, :] + 0.5 - centre[:, None]) / widen
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


#: Levels, and frequencies, that differ by less are equal: what their sums leave behind depends on the order of adding.
EQUAL_LEVELS = 1e-10
EQUAL_FREQUENCIES = 1e-6


def to_bytes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values + 0.5), 0, 255).astype(np.uint8)


def resample(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos in both directions; halves go up, as do sums that fall short of them by less than ``EQUAL_LEVELS``."""
    h, w = img.shape[:2]
    if (w, h) == (width, height):
        return img
    down = _lanczos_weights(h, height)
    across = down if (w, width) == (h, height) else _lanczos_weights(w, width)
    planes = [down @ img[:, :, c].astype(np.float64) @ across.T for c in range(img.shape[2])]
    return to_bytes(np.stack(planes, axis=2) + EQUAL_LEVELS)


@lru_cache(maxsize=8)
def _cosines(rows: int, size: int) -> np.ndarray:
    n = np.arange(size)
    return np.cos(np.pi * np.arange(rows)[:, None] * (2 * n + 1)[None, :] / (2 * size))


def phash(img: np.ndarray, hash_size: int = 16, equal: float = EQUAL_FREQUENCIES) -> list[int]:
    """Signs of the low frequencies of the DCT against their median, as 64-bit words.

    Frequencies that exceed the median by no more than ``equal`` do not count as above it.
    """
    size = 4 * hash_size
    g = gray_for_hash(img)[:, :, None].astype(np.uint8)
    small = resample(g, size, size)[:, :, 0].astype(np.float64)
    basis = _cosines(hash_size, size)
    low = basis @ small @ basis.T
    bits = np.packbits((low > np.median(low) + equal).ravel(), bitorder="little")
    return [int(word) for word in np.pad(bits, (0, -bits.size % 8)).view("<i8")]


def brighten(img: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(img * factor, 0, 255).astype(np.uint8)


def stretch_contrast(img: np.ndarray, factor: float) -> np.ndarray:
    mean = int(gray_for_hash(img).mean() + 0.5)
    return np.clip(mean + factor * (img.astype(np.float64) - mean), 0, 255).astype(np.uint8)


def _separable(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    r = len(kernel) // 2
    out = img.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="edge")
        size = out.shape[axis]
        out = sum(k * padded.take(range(i, i + size), axis=axis) for i, k in enumerate(kernel))
    return out


def soften(img: np.ndarray, factor: float) -> np.ndarray:
    """Blend towards a 3x3 smoothed picture (centre weight 5 of 13)."""
    img = img.astype(np.float64)
    p = np.pad(img, ((1, 1), (1, 1), (0, 0)), mode="edge")
    h, w = img.shape[:2]
    around = sum(p[y : y + h, x : x + w] for y in range(3) for x in range(3))
    smooth = (around + 4 * img) / 13
    return to_bytes(smooth + factor * (img - smooth))


def unsharp(img: np.ndarray, percent: int, radius: int = 2, threshold: int = 3) -> np.ndarray:
    n = np.arange(-3 * radius, 3 * radius + 1)
    kernel = np.exp(-(n**2) / (2.0 * radius**2))
    detail = img - _separable(img, kernel / kernel.sum())
    detail[np.abs(detail) <= threshold] = 0
    return to_bytes(img + detail * percent / 100)


def encode_png(img: np.ndarray) -> bytes:
    """Lossless PNG file of a picture."""
    h, w, channels = img.shape
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    rows = np.zeros((h, 1 + w * channels), dtype=np.uint8)
    rows[:, 1:] = img[:, :, order].reshape(h, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n"
        + chunk(b"IHDR", header)
        + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6))
        + chunk(b"IEND", b"")
    )


def decode_png(data: bytes) -> np.ndarray | None:
    """The picture of a file such as ``encode_png`` writes, in colour; None for any other file.

    Whole levels of gray, colour or colour with alpha, which is left out, in plain lines; there is nothing
    in such a file that readers take in different ways.
    """
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    parts, at = [], 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            return None
        parts.append((kind, body))
        at += 12 + size
    if at != len(data) or len(parts) < 3 or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13 or parts[-1] != (b"IEND", b"") or any(k != b"IDAT" for k, _ in parts[1:-1]):
        return None
    w, h, depth, kind, *rest = struct.unpack(">IIBBBBB", parts[0][1])
    order = {0: [0, 0, 0], 2: [2, 1, 0], 6: [2, 1, 0]}.get(kind)
    if order is None or depth != 8 or any(rest) or not w or not h:
        return None
    channels = {0: 1, 2: 3, 6: 4}[kind]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(body for _, body in parts[1:-1])), dtype=np.uint8)
    except zlib.error:
        return None
    if lines.size != h * (1 + w * channels) or lines[:: 1 + w * channels].any():
        return None
    return lines.reshape(h, -1)[:, 1:].reshape(h, w, channels)[:, :, order]
