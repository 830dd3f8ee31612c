"""Reductions, histograms and hashes of one buffer."""

from __future__ import annotations

import math

import numpy as np

from .colour import luma
from .core import REQUIRED, convert, fixed, image, operator, same
from .pixels import mask_of
from .resample import resample

F64 = fixed("f64")


def _rank(n, p):
    return 0 if p.get("axis") is None else None if n is None else n - 1


def _gives(p):
    return "scalar" if p.get("axis") is None else "buffer"


def _axis(x, axis):
    if axis is not None and not 0 <= axis < x.ndim:
        raise ValueError(f"axis {axis} is not below {x.ndim}")
    return axis


def _filled(x, name):
    if not x.size:
        raise ValueError(f"{name}: the buffer is empty")
    return x


def named(name: str):
    """The reduction by name: sum, mean, min, max, std, median, count or a percentile such as p95. NaN over nothing (0
    for sum and count), NaN where a value is NaN; takes (values, axis)."""
    plain = {"sum": np.sum, "mean": np.mean, "min": np.min, "max": np.max, "std": np.std, "median": np.median}

    def run(v, axis=None):
        v = np.asarray(v, float)
        n = v.size if axis is None else v.shape[axis]
        shape = () if axis is None else tuple(s for i, s in enumerate(v.shape) if i != axis)
        if name == "count":
            return np.full(shape, float(n))
        if n == 0:
            return np.full(shape, 0.0 if name == "sum" else np.nan)
        with np.errstate(all="ignore"):
            if name in plain:
                return plain[name](v, axis=axis)
            return np.where(np.isnan(v).any(axis), np.nan, np.percentile(v, float(name[1:]), axis=axis))

    if name not in plain and name != "count" and not (name[:1] == "p" and name[1:].replace(".", "", 1).isdigit() and float(name[1:]) <= 100):
        raise ValueError(f"reduction {name!r} is none of sum, mean, min, max, std, median, count, pNN")
    return run


def _reduce(name, f, params=None, dtype=F64, needs=False):
    def run(x, axis=None, **p):
        v = _filled(x, name) if needs else x
        with np.errstate(all="ignore"):
            return f(v, _axis(x, axis), **p)

    operator(name, {"axis": None, **(params or {})}, gives=_gives, dtype=dtype, ndim=_rank, fixed=("axis",))(run)


_reduce("reduce_max", lambda x, axis: x.max(axis), dtype=same, needs=True)
_reduce("reduce_min", lambda x, axis: x.min(axis), dtype=same, needs=True)
_reduce("reduce_mean", lambda x, axis: x.mean(axis, dtype=float) if x.size else np.nan)


def _std(x, axis, ddof):
    n = x.size if axis is None else x.shape[axis]
    if n - ddof <= 0:
        return np.nan if axis is None else np.full([s for i, s in enumerate(x.shape) if i != axis], np.nan)
    return x.astype(float).std(axis, ddof=ddof)


_reduce("reduce_std", _std, {"ddof": 0})


@operator("reduce_sum", gives="scalar", dtype=F64, ndim=lambda n, p: 0)
def reduce_sum(x):
    return x.sum(dtype=float)


@operator("reduce_popcount", gives="scalar", dtype=F64, ndim=lambda n, p: 0)
def reduce_popcount(x):
    if x.dtype.kind == "f":
        raise ValueError("reduce_popcount: integers are needed")
    return float(np.bitwise_count(np.ascontiguousarray(x).view(np.uint8)).sum())


def _place(name, pick):
    @operator(name, {"axis": REQUIRED}, dtype=fixed("i64"), ndim=_rank, fixed=("axis",))
    def run(x, axis):
        """The first one; a NaN is the largest and the smallest."""
        return pick(_filled(x, name), _axis(x, axis)).astype(np.int64)


_place("reduce_argmax", np.argmax)
_place("reduce_argmin", np.argmin)


@operator("reduce_percentile", {"q": REQUIRED}, gives="scalar", dtype=F64, ndim=lambda n, p: 0)
def reduce_percentile(x, q):
    if not 0 <= q <= 100:
        raise ValueError(f"reduce_percentile: {q} is not in 0 to 100")
    return float(named(f"p{q}")(_filled(x, "reduce_percentile")))


@operator("reduce", {"reduction": REQUIRED, "axis": None}, gives=_gives, dtype=F64, ndim=_rank, fixed=("axis",))
def reduce(x, reduction, axis):
    return named(reduction)(x, _axis(x, axis))


@operator("reduce_masked", {"reduction": "mean", "axis": None}, nodes=("mask",), gives=_gives, dtype=F64, ndim=lambda n, p: 0 if p.get("axis") is None else 1, fixed=("axis",))
def reduce_masked(x, mask, reduction, axis):
    y, m = image(x), image(mask) > 0
    mask_of(x, mask)
    m = np.broadcast_to(m, y.shape)
    f = named(reduction)
    if axis is None:
        return float(f(y[m]))
    if axis not in (0, 1):
        raise ValueError("reduce_masked: the axis is 0 or 1")
    y, m = (np.moveaxis(v, axis, 0).reshape(v.shape[axis], -1, v.shape[2]) for v in (y, m))
    return np.asarray([float(f(y[:, i][m[:, i]])) for i in range(y.shape[1])])


@operator("block_reduce", {"height": REQUIRED, "width": REQUIRED, "reduction": "mean"}, dtype=F64)
def block_reduce(x, height, width, reduction):
    if height < 1 or width < 1:
        raise ValueError("block_reduce: blocks have at least one pixel")
    y, f = image(x).astype(float), named(reduction)
    h, w, c = y.shape
    out = np.empty((-(-h // height), -(-w // width), c))
    full_h, full_w = h // height, w // width
    if full_h and full_w:  # whole blocks at once
        whole = y[: full_h * height, : full_w * width].reshape(full_h, height, full_w, width, c).transpose(0, 2, 4, 1, 3).reshape(full_h, full_w, c, -1)
        out[:full_h, :full_w] = f(whole, 3)
    for i in range(out.shape[0]):
        for j in range(out.shape[1]):
            if i >= full_h or j >= full_w:
                out[i, j] = f(y[i * height : (i + 1) * height, j * width : (j + 1) * width].reshape(-1, c), 0)
    return out[:, :, 0] if x.ndim == 2 else out


@operator("statistics", {"include": ("mean", "std", "min", "max")}, gives="vector", dtype=F64, ndim=lambda n, p: 1, fixed=("include",))
def statistics(x, include):
    return np.asarray([float(named(n)(x)) for n in include])


def edges_of(x: np.ndarray, bins, value_range) -> np.ndarray:
    """numpy's edges: `bins` equal ones over the range, or the ones given."""
    if np.ndim(bins):
        e = np.asarray(bins, float)
        if len(e) < 2 or (np.diff(e) < 0).any() or np.isnan(e).any():
            raise ValueError("histogram: edges must not decrease")
        return e
    if bins < 1:
        raise ValueError("histogram: at least one bin is needed")
    if value_range is None:
        lo, hi = (float(x.min()), float(x.max())) if x.size else (0.0, 1.0)
    else:
        lo, hi = (float(v) for v in value_range)
    if not (math.isfinite(lo) and math.isfinite(hi)) or lo > hi:
        raise ValueError(f"histogram: no bins over [{lo}, {hi}]")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return np.append(lo + np.arange(bins) * ((hi - lo) / bins), hi)


@operator(
    "histogram", {"bins": 256, "range": None, "closed": "left", "output": "buckets"}, fixed=("closed", "output"),
    gives=lambda p: "buffer" if p["output"] == "quantized" else "buckets" if p["output"] == "buckets" else "vector",
    dtype=lambda d, p: {"counts": "u64", "quantized": "u32"}.get(p["output"], "f64"), ndim=lambda n, p: n if p["output"] == "quantized" else 1,
)
def histogram(x, bins, range, closed, output):  # noqa: A002
    e = edges_of(x, bins, range)
    if closed not in ("left", "right") or output not in ("counts", "normalized", "quantized", "edges", "buckets"):
        raise ValueError(f"histogram: closed {closed!r}, output {output!r}")
    if output == "edges":
        return e
    n = len(e) - 1
    v = x.ravel()
    at = np.searchsorted(e[1:-1], v, "right" if closed == "left" else "left")
    with np.errstate(invalid="ignore"):
        at = np.where((v >= e[0]) & (v <= e[-1]), at, n)  # NaN is in no bin
    if output == "quantized":
        return at.astype(np.uint32).reshape(x.shape)
    counts = np.bincount(at, minlength=n + 1)[:n]
    if output == "counts":
        return counts.astype(np.uint64)
    share = counts / max(1, counts.sum())
    if output == "normalized":
        return share
    return [{"lower_edge": a, "upper_edge": b, "count": c, "normalized": s} for a, b, c, s in zip(e[:-1].tolist(), e[1:].tolist(), counts.tolist(), share.tolist(), strict=True)]


def _packed(bits: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size // 8 * 8, np.uint8)
    flat = bits.ravel()[: len(out)]
    out[: len(flat)] = flat
    return np.packbits(out)


@operator("perceptual_hash", {"algorithm": "perceptual", "hash_size": 64}, gives="vector", dtype=fixed("u8"), ndim=lambda n, p: 1, fixed=("algorithm", "hash_size"))
def perceptual_hash(x, algorithm, hash_size):
    """hash_size / 8 bytes, row by row, the first bit highest: above the median of the lowest frequencies (perceptual),
    above the mean (average), brighter than the right neighbour (difference) or above its band's median block
    (blockhash), of a grey copy of the image."""
    y = convert(image(x), np.uint8)
    grey = (y[:, :, 0] if y.shape[2] < 3 else luma(y)[:, :, 0]).copy()
    side = math.isqrt(hash_size)
    if side < 1:
        raise ValueError("perceptual_hash: hash_size must be positive")
    if algorithm == "perceptual":
        n = 4 * side
        small = resample(grey, n, n, "lanczos3").astype(float)
        k, t = np.arange(side)[:, None], np.arange(n)[None, :]
        basis = np.cos(np.pi * k * (2 * t + 1) / (2 * n))
        f = basis @ small @ basis.T
        f[np.abs(f) <= np.abs(f).max() * 1e-9] = 0  # what is 0 but for rounding
        return _packed(f > np.median(f), hash_size)
    if algorithm == "average":
        small = resample(grey, side, side, "lanczos3").astype(float)
        return _packed(small >= small.mean(), hash_size)
    if algorithm == "difference":
        small = resample(grey, side, side + 1, "lanczos3").astype(int)
        return _packed(small[:, :-1] < small[:, 1:], hash_size)
    if algorithm == "blockhash":
        sums = resample(grey.astype(np.float32), side, side, "area").astype(float)
        bands = np.array_split(sums.ravel(), 4)
        half = 255 / 2
        bits = [(b > m) | ((b == m) & (m > half)) for b in bands for m in [np.median(b) if len(b) else 0]]
        return _packed(np.concatenate(bits), hash_size)
    raise ValueError(f"perceptual_hash: algorithm {algorithm!r} is none of perceptual, average, difference, blockhash")
