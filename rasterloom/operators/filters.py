"""Neighbourhood operators: blur, correlation, ranks, morphology, edges and distances."""

from __future__ import annotations

import math

import numpy as np

from .core import REQUIRED, convert, image, like, operator, promoted, single, wide

#: Border modes and what NumPy calls them.
BORDERS = {"replicate": "edge", "zero": "constant", "reflect": "reflect"}


def _framed(y: np.ndarray, ry: int, rx: int, border: str = "replicate") -> np.ndarray:
    if border not in BORDERS:
        raise ValueError(f"border {border!r} is none of {', '.join(BORDERS)}")
    return np.pad(y, [(ry, ry), (rx, rx)] + [(0, 0)] * (y.ndim - 2), mode=BORDERS[border])


@operator("blur", {"sigma": REQUIRED})
def blur(x, sigma):
    if not sigma >= 0:
        raise ValueError("blur: sigma must not be negative")
    if sigma == 0:
        return x
    y = image(x)
    r = math.ceil(3 * sigma)
    k = np.exp(-((np.arange(-r, r + 1) / sigma) ** 2) / 2)
    k = (k / k.sum()).astype(wide(y.dtype))
    v = y.astype(k.dtype)
    h, w = y.shape[:2]
    across = _framed(v, 0, r)
    v = sum(k[i] * across[:, i : i + w] for i in range(2 * r + 1))
    down = _framed(v, r, 0)
    v = sum(k[i] * down[i : i + h] for i in range(2 * r + 1))
    return like(convert(v, y.dtype), x)


@operator("convolve2d", {"kernel": REQUIRED, "border": "replicate", "normalize": False}, dtype=promoted)
def convolve2d(x, kernel, border, normalize):
    k = np.asarray(kernel, float)
    if k.ndim == 1:
        side = math.isqrt(k.size)
        k = k.reshape(side, -1) if side * side == k.size else k[None]
    if k.ndim != 2 or k.shape[0] != k.shape[1] or k.shape[0] % 2 == 0:
        raise ValueError("convolve2d: the kernel must be square with an odd side")
    if normalize:
        k = k / np.abs(k).sum()
    y = image(x)
    h, w = y.shape[:2]
    r = k.shape[0] // 2
    v = _framed(y.astype(float), r, r, border)
    out = np.zeros(y.shape)
    for i, j in zip(*np.nonzero(k), strict=True):
        out += k[i, j] * v[i : i + h, j : j + w]
    return like(out.astype(y.dtype if y.dtype.kind == "f" else wide(y.dtype)), x)


def _windows(y: np.ndarray, height: int, width: int, border: str = "replicate") -> np.ndarray:
    """[H, W, C, height * width]."""
    v = np.lib.stride_tricks.sliding_window_view(_framed(y, height // 2, width // 2, border), (height, width), (0, 1))
    return v.reshape(*y.shape, height * width)


@operator("rank_filter", {"height": REQUIRED, "width": REQUIRED, "q": 50.0, "border": "replicate"})
def rank_filter(x, height, width, q, border):
    if height % 2 == 0 or width % 2 == 0 or not 0 <= q <= 100:
        raise ValueError("rank_filter: an odd window and a percentile of 0 to 100 are needed")
    y = image(x)
    return like(convert(np.percentile(_windows(y, height, width, border).astype(float), q, axis=3), y.dtype), x)


def _local(x: np.ndarray, ksize: int, iterations: int, footprint: str, best) -> np.ndarray:
    v = single(x)
    r = ksize // 2
    if footprint not in ("square", "disk"):
        raise ValueError(f"footprint {footprint!r} is neither square nor disk")
    h, w = v.shape
    for _ in range(iterations):
        f = _framed(v, r, r)
        if footprint == "square":
            rows = f[:, :w]
            for j in range(1, 2 * r + 1):
                rows = best(rows, f[:, j : j + w])
            v = rows[:h]
            for i in range(1, 2 * r + 1):
                v = best(v, rows[i : i + h])
        else:
            v = None
            for i in range(-r, r + 1):
                for j in range(-r, r + 1):
                    if i * i + j * j <= r * r:
                        part = f[r + i : r + i + h, r + j : r + j + w]
                        v = part if v is None else best(v, part)
    return v.reshape(x.shape)


_MORPH = {"ksize": 3, "iterations": 1, "footprint": "square"}


@operator("erode", _MORPH)
def erode(x, ksize, iterations, footprint):
    return _local(x, ksize, iterations, footprint, np.minimum)


@operator("dilate", _MORPH)
def dilate(x, ksize, iterations, footprint):
    return _local(x, ksize, iterations, footprint, np.maximum)


@operator("morphology_gradient", {"ksize": 3, "footprint": "square"})
def morphology_gradient(x, ksize, footprint):
    return dilate(x, ksize, 1, footprint) - erode(x, ksize, 1, footprint)


@operator("canny", {"low_threshold": 50.0, "high_threshold": 150.0}, dtype=lambda d, p: "u8", ndim=lambda n, p: 3)
def canny(x, low_threshold, high_threshold):
    """Edges where the L1 Sobel slope is a peak across its direction and is strong, or is joined to a strong one."""
    v = _framed(convert(single(x), np.uint8).astype(np.int64), 1, 1)
    h, w = v.shape[0] - 2, v.shape[1] - 2
    p = lambda i, j: v[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    gx = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
    gy = p(1, -1) + 2 * p(1, 0) + p(1, 1) - p(-1, -1) - 2 * p(-1, 0) - p(-1, 1)
    ax, ay = np.abs(gx), np.abs(gy)
    m = np.pad(ax + ay, 1)
    q = lambda i, j: m[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    low, high = sorted((math.floor(low_threshold), math.floor(high_threshold)))
    eighth = ax * 13573  # tangent of 22.5 degrees in 15 bits
    flat, steep = (ay << 15) < eighth, (ay << 15) > eighth + (ax << 16)
    slant = np.where((gx ^ gy) < 0, -1, 1)
    peak = np.where(flat, (q(0, 0) > q(0, -1)) & (q(0, 0) >= q(0, 1)), np.where(steep, (q(0, 0) > q(-1, 0)) & (q(0, 0) >= q(1, 0)), np.where(slant > 0, (q(0, 0) > q(-1, -1)) & (q(0, 0) > q(1, 1)), (q(0, 0) > q(-1, 1)) & (q(0, 0) > q(1, -1)))))
    weak = peak & (q(0, 0) > low)
    edge = weak & (q(0, 0) > high)
    while True:
        grown = weak & (_local(edge, 3, 1, "square", np.maximum))
        if (grown == edge).all():
            return (grown * np.uint8(255))[:, :, None]
        edge = grown


def _squared(site: np.ndarray) -> np.ndarray:
    """Squared distance of every pixel to the nearest site; infinite without one."""
    h, w = site.shape
    if not site.any():
        return np.full((h, w), np.inf)
    i = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(site, i, -(10**6)), 0)
    below = np.minimum.accumulate(np.where(site, i, 10**6)[::-1], 0)[::-1]
    g = np.minimum(i - above, below - i).astype(float) ** 2
    across = (np.arange(w)[:, None] - np.arange(w)[None, :]).astype(float) ** 2
    return np.stack([(row[None, :] + across).min(1) for row in g])


@operator("distance_transform", {"signed": False}, dtype=lambda d, p: "f32")
def distance_transform(x, signed):
    fore = single(x) != 0
    inner = np.sqrt(_squared(~fore))
    out = np.where(fore, 0.5 - inner, np.sqrt(_squared(fore)) - 0.5) if signed else np.where(fore, inner, 0)
    return out.astype(np.float32).reshape(x.shape)
