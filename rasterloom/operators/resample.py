"""Resizing with antialiased separable filters, letterboxing and affine warps."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .core import REQUIRED, convert, image, like, operator, wide
from .views import pad_to_size


def _sinc3(t):
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)


def _cubic(t):
    """Catmull and Rom's cubic: through its neighbours with slopes of half their distance."""
    t = np.abs(t)
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0))


#: The filters by name, each with its reach at scale 1.
FILTERS = {
    "bilinear": (lambda t: np.maximum(0, 1 - np.abs(t)), 1.0),
    "catmullrom": (_cubic, 2.0),
    "gaussian": (lambda t: np.where(np.abs(t) <= 3, np.exp(-2 * t * t), 0), 3.0),
    "lanczos3": (_sinc3, 3.0),
}
FILTERS["triangle"] = FILTERS["bilinear"]


@lru_cache(256)
def weights(src: int, dst: int, name: str) -> np.ndarray:
    """[dst, src] weights of one axis; rows sum to 1."""
    ratio = src / dst
    place = np.arange(src)
    if name == "area":  # how much of each source cell an output cell covers
        lo, hi = np.arange(dst)[:, None] * ratio, np.arange(1, dst + 1)[:, None] * ratio
        w = np.clip(np.minimum(hi, place + 1) - np.maximum(lo, place), 0, None)
    else:
        f, reach = FILTERS[name]
        grow = max(ratio, 1.0)
        centre = (np.arange(dst)[:, None] + 0.5) * ratio
        w = f((place + 0.5 - centre) / grow)
        w[np.abs(place + 0.5 - centre) >= reach * grow] = 0
    return w / w.sum(1, keepdims=True)


@lru_cache(256)
def bands(src: int, dst: int, name: str, kind: str) -> list[tuple[int, int, int, int, np.ndarray]]:
    """The weights in blocks of output places, each with the run of source places it reads."""
    w, out = weights(src, dst, name).astype(kind), []
    for a in range(0, dst, 32):
        block = w[a : a + 32]
        used = np.flatnonzero((block != 0).any(0))
        lo, hi = int(used[0]), int(used[-1]) + 1
        out.append((a, min(dst, a + 32), lo, hi, np.ascontiguousarray(block[:, lo:hi])))
    return out


def _along(v: np.ndarray, dst: int, name: str) -> np.ndarray:
    """[src, n] resampled to [dst, n]."""
    out = np.empty((dst, v.shape[1]), v.dtype)
    for a, b, lo, hi, w in bands(v.shape[0], dst, name, v.dtype.str):
        np.matmul(w, v[lo:hi], out[a:b])
    return out


def resample(x: np.ndarray, height: int, width: int, name: str) -> np.ndarray:
    y = image(x)
    h, w, c = y.shape
    height, width = int(height), int(width)
    if min(height, width) < 1 or min(h, w) < 1:
        raise ValueError(f"resize: {list(x.shape)} to {height} x {width}")
    if name == "nearest":
        rows, cols = ((2 * np.arange(n) + 1) * s // (2 * n) for n, s in ((height, h), (width, w)))
        return like(y[rows][:, cols], x)
    if name not in FILTERS and name != "area":
        raise ValueError(f"resize: filter {name!r} is none of nearest, area, {', '.join(FILTERS)}")
    if (height, width) == (h, w):
        return x
    kind = wide(y.dtype)
    v = y.astype(kind)
    alpha = c in (2, 4)
    if alpha:
        v = np.concatenate((v[:, :, :-1] * v[:, :, -1:], v[:, :, -1:]), 2)
    if height != h:
        v = _along(v.reshape(h, -1), height, name).reshape(height, w, c)
    if width != w:
        v = _along(v.transpose(1, 0, 2).reshape(w, -1), width, name).reshape(width, height, c).transpose(1, 0, 2)
    if alpha:
        with np.errstate(all="ignore"):
            v = np.concatenate((np.where(v[:, :, -1:] == 0, 0, v[:, :, :-1] / v[:, :, -1:]), v[:, :, -1:]), 2)
    return like(convert(v, y.dtype), x)


def _whole(v: float) -> int:
    return max(1, math.floor(v + 0.5))


@operator("resize", {"height": REQUIRED, "width": REQUIRED, "filter": "lanczos3"})
def resize(x, height, width, filter):  # noqa: A002
    return resample(x, height, width, filter)


@operator("resize_scale", {"scale_x": REQUIRED, "scale_y": REQUIRED, "filter": "lanczos3"})
def resize_scale(x, scale_x, scale_y, filter):  # noqa: A002
    return resample(x, _whole(x.shape[0] * scale_y), _whole(x.shape[1] * scale_x), filter)


def _sized(name, param, factor):
    def run(x, filter, **p):  # noqa: A002
        h, w = x.shape[:2]
        n = p[param]
        s = factor(h, w, n)
        return resample(x, n if (name == "resize_to_height" or s * h == n) else _whole(h * s), n if (name == "resize_to_width" or s * w == n) else _whole(w * s), filter)

    operator(name, {param: REQUIRED, "filter": "lanczos3"})(run)


_sized("resize_to_height", "height", lambda h, w, n: n / h)
_sized("resize_to_width", "width", lambda h, w, n: n / w)
_sized("resize_max", "max_size", lambda h, w, n: n / max(h, w))
_sized("resize_min", "min_size", lambda h, w, n: n / min(h, w))


@operator("resize_like", {"filter": "lanczos3"}, nodes=("like",))
def resize_like(x, like, filter):  # noqa: A002
    return resample(x, like.shape[0], like.shape[1], filter)


@operator("letterbox", {"height": REQUIRED, "width": REQUIRED, "value": 0.0, "filter": "lanczos3"})
def letterbox(x, height, width, value, filter):  # noqa: A002
    s = min(height / x.shape[0], width / x.shape[1])
    small = resample(x, min(height, _whole(x.shape[0] * s)), min(width, _whole(x.shape[1] * s)), filter)
    return pad_to_size(small, height, width, "center", value)


def warp(x: np.ndarray, matrix, height: int, width: int, interpolation: str, border: float) -> np.ndarray:
    """Each output pixel reads where the inverse of the forward matrix [a, b, tx, c, d, ty] puts it."""
    y = image(x)
    h, w, _ = y.shape
    a, b, tx, c, d, ty = (float(v) for v in matrix)
    det = a * d - b * c
    if not all(map(math.isfinite, (a, b, tx, c, d, ty))) or abs(det) < 1e-15:
        raise ValueError("warp: the matrix has no inverse")
    gx, gy = np.arange(int(width))[None, :], np.arange(int(height))[:, None]
    ia, ib, ic, id_ = d / det, -b / det, -c / det, a / det
    sx, sy = ia * gx + ib * gy - (ia * tx + ib * ty), ic * gx + id_ * gy - (ic * tx + id_ * ty)
    hole = float(border)

    def at(px, py):
        inside = (px >= 0) & (px < w) & (py >= 0) & (py < h)
        v = y[np.clip(py, 0, h - 1), np.clip(px, 0, w - 1)].astype(float)
        v[~inside] = hole
        return v

    if interpolation == "nearest":
        out = at(np.floor(sx + 0.5).astype(np.int64), np.floor(sy + 0.5).astype(np.int64))
    elif interpolation == "bilinear":
        x0, y0 = np.floor(sx), np.floor(sy)
        fx, fy = (sx - x0)[:, :, None], (sy - y0)[:, :, None]
        x0, y0 = x0.astype(np.int64), y0.astype(np.int64)
        top = at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx
        out = top * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy
    else:
        raise ValueError(f"warp: interpolation {interpolation!r} is neither nearest nor bilinear")
    return like(convert(out, y.dtype), x)


def turn(angle: float, cx: float, cy: float, scale: float = 1.0) -> list[float]:
    """Forward matrix that turns by degrees, clockwise on the screen, about (cx, cy)."""
    c, s = math.cos(math.radians(angle)) * scale, math.sin(math.radians(angle)) * scale
    return [c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy]


@operator("warp_affine", {"matrix": REQUIRED, "output_size": REQUIRED, "interpolation": "bilinear", "border_value": 0.0})
def warp_affine(x, matrix, output_size, interpolation, border_value):
    """output_size is [height, width]."""
    return warp(x, matrix, output_size[0], output_size[1], interpolation, border_value)


@operator("rotate_and_scale", {"angle": REQUIRED, "center": REQUIRED, "output_size": REQUIRED, "scale": 1.0})
def rotate_and_scale(x, angle, center, output_size, scale):
    return warp(x, turn(angle, center[0], center[1], scale), output_size[0], output_size[1], "bilinear", 0.0)


@operator("rotate", {"angle": REQUIRED, "expand": False, "interpolation": "bilinear", "border_value": 0.0}, fixed=("expand",))
def rotate(x, angle, expand, interpolation, border_value):
    quarter = angle % 360
    h, w = image(x).shape[:2]
    if quarter in (0, 180) or (quarter in (90, 270) and (expand or h == w)):
        return np.rot90(x, -int(quarter // 90))
    m = turn(angle, (w - 1) / 2, (h - 1) / 2)
    out_h, out_w = h, w
    if expand:
        out_w, out_h = (math.ceil(round(v, 9)) for v in (abs(m[0]) * w + abs(m[1]) * h, abs(m[3]) * w + abs(m[4]) * h))
        m[2], m[5] = m[2] + (out_w - w) / 2, m[5] + (out_h - h) / 2
    return warp(x, m, out_h, out_w, interpolation, border_value)
