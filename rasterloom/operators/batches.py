"""Kernels over all sets of convex rings of an Arrow column at once.

They hold where every contour of the column is a closed convex ring without holes, all of one size; `convex_sets` gives
None elsewhere, and the kernels of single shapes do the work.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 14  # pairs at a time
LAST: list = []  # the columns and matrices of the last call: operators of one query often meet the same columns


class Sets(NamedTuple):
    start: np.ndarray  # row i holds the rings start[i] to start[i + 1]
    rings: np.ndarray  # [m, n, 2], counter-clockwise
    area: np.ndarray  # signed, as the rings were given
    low: np.ndarray  # [m, 2]: corners of each ring's box
    high: np.ndarray


def convex_sets(col: pa.Array) -> Sets | None:
    if not pa.types.is_list(col.type) or not pa.types.is_struct(col.type.value_type) or col.type.value_type.get_field_index("exterior") < 0 or col.null_count:
        return None
    start = col.offsets.to_numpy().astype(np.int64)
    c = col.flatten()
    if not len(c) or c.null_count:
        return None
    ext, holes, closed = c.field("exterior"), c.field("holes"), c.field("is_closed")
    if ext.null_count or (pc.sum(pc.list_value_length(holes)).as_py() or 0) or not pc.all(pc.fill_null(closed, True)).as_py():
        return None
    sizes, points = np.diff(ext.offsets.to_numpy()), ext.flatten()
    n = int(sizes[0])
    if n < 3 or (sizes != n).any() or points.null_count or points.field("x").null_count or points.field("y").null_count:
        return None
    r = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in "xy"], 1).reshape(-1, n, 2)
    e = np.roll(r, -1, 1) - r
    f = np.roll(e, -1, 1)
    turn = _cross(e, f)
    around = np.arctan2(turn, (e * f).sum(2)).sum(1)
    if not np.isfinite(r).all() or not ((turn > 0).all(1) | (turn < 0).all(1)).all() or (np.abs(np.abs(around) - math.tau) > 1e-6).any():
        return None
    p = r - r[:, :1]
    area = _cross(p, np.roll(p, -1, 1)).sum(1) / 2
    return Sets(start - start[0], np.where((area > 0)[:, None, None], r, r[:, ::-1]), area, r.min(1), r.max(1))


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _clipped(p: np.ndarray, q: np.ndarray, size: np.ndarray, own: bool) -> np.ndarray:
    """What the parts of p's edges inside q add to the area around the origin. An edge on an edge of q counts where both
    run the same way, and only for one of the two rings."""
    d, f = (np.roll(v, -1, 1) - v for v in (p, q))
    d, f, off = d[:, :, None], f[:, None], p[:, :, None] - q[:, None]
    at, along = _cross(f, off), _cross(f, d)
    length = np.sqrt((f * f).sum(3))
    level = np.abs(along) <= 1e-12 * length * np.sqrt((d * d).sum(3))
    on = level & (np.abs(at) <= 1e-12 * length * size[:, None, None])
    t = -at / np.where(level, 1, along)
    lo = np.where(~level & (along > 0), t, 0).max(2, initial=0)
    hi = np.where(~level & (along < 0), t, 1).min(2, initial=1)
    out = (level & ~on & (at < 0)) | (on & ((f * d).sum(3) < 0) if own else on)
    d = d[:, :, 0]
    part = _cross(p + lo[..., None] * d, p + hi[..., None] * d) / 2
    return np.where((hi > lo) & ~out.any(2), part, 0).sum(1)


def shared_areas(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of convex counter-clockwise rings [p, n, 2] and [p, m, 2]."""
    base = a[:, :1]
    a, b = a - base, b - base
    size = np.maximum(np.abs(a).max((1, 2)), np.abs(b).max((1, 2)))
    return np.maximum(_clipped(a, b, size, True) + _clipped(b, a, size, False), 0)


def iou(a: Sets, b: Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    both = shared_areas(a.rings[i], b.rings[j])
    whole = np.abs(a.area[i]) + np.abs(b.area[j]) - both
    return np.where(whole >= 1e-10, np.clip(both / np.where(whole >= 1e-10, whole, 1), 0, 1), 0)


iou.reach = 0.0


def coverage(tolerance: float):
    """The share of the right ring's vertices inside the left one or within the tolerance of its edges."""

    def share(a: Sets, b: Sets, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        p, e = b.rings[j][:, :, None], a.rings[i][:, None]
        d = np.roll(e, -1, 2) - e
        off = p - e
        t = np.clip((off * d).sum(3) / (d * d).sum(3), 0, 1)
        near = np.sqrt(((p - (e + t[..., None] * d)) ** 2).sum(3)).min(2) <= tolerance
        y0, y1 = e[..., 1], (e + d)[..., 1]
        crossing = (y0 > p[..., 1]) != (y1 > p[..., 1])
        x = e[..., 0] + off[..., 1] * d[..., 0] / np.where(crossing, d[..., 1], 1)
        return (near | ((crossing & (p[..., 0] < x)).sum(2) % 2 == 1)).mean(1)

    share.reach = tolerance
    return share


def _same(a: pa.Array, b: pa.Array) -> bool:
    at = lambda c: [x.address if x is not None else 0 for x in c.buffers()]
    return a is b or (a.type == b.type and len(a) == len(b) and a.offset == b.offset and at(a) == at(b))


def met(a: pa.Array, b: pa.Array, measure, key) -> tuple | None:
    """The matrices of two columns of sets; None where the batch kernels do not hold. The last are kept, with their columns,
    so that no other column can have their addresses."""
    for x, y, k, got in LAST:
        if k == key and _same(x, a) and _same(y, b):
            return got
    left = convex_sets(a)
    right = left if _same(a, b) else convex_sets(b)
    got = None if left is None or right is None else matrices(left, right, measure)
    LAST[:] = [(a, b, key, got)]
    return got


def matrices(a: Sets, b: Sets, measure) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The values of every row's pairs, left by left; where each row's begin; and the sizes of its two sets. Pairs whose
    boxes lie farther apart than the measure reaches have the value 0."""
    left, right = np.diff(a.start), np.diff(b.start)
    begin = np.concatenate(([0], np.cumsum(left * right)))
    out = np.zeros(begin[-1])
    for k in range(0, len(out), CHUNK):
        at = np.arange(k, min(k + CHUNK, len(out)))
        row = np.searchsorted(begin, at, "right") - 1
        i, j = np.divmod(at - begin[row], right[row])
        i, j = a.start[row] + i, b.start[row] + j
        near = np.flatnonzero(((a.low[i] <= b.high[j] + measure.reach) & (b.low[j] <= a.high[i] + measure.reach)).all(1))
        out[at[near]] = measure(a, b, i[near], j[near])
    return out, begin, left, right


def lists(start: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), values)


def nested(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.ListArray:
    """The matrices as lists of lists."""
    inner = np.concatenate(([0], np.cumsum(np.repeat(right, left))))
    return lists(np.concatenate(([0], np.cumsum(left))), lists(inner, pa.array(values)))


def greedy(values: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: np.ndarray, kind: pa.DataType) -> pa.StructArray:
    """contours.greedy of every row, row by row of equal sizes at once."""
    start = np.concatenate(([0], np.cumsum(left)))
    idx, score, twice = np.full(start[-1], -1), np.zeros(start[-1]), np.zeros(start[-1], bool)
    sizes, of = np.unique(np.stack((left, right), 1), axis=0, return_inverse=True)
    for g, (n, m) in enumerate(sizes.tolist()):
        if not n or not m:
            continue
        rows = np.flatnonzero(of.ravel() == g)
        step = max(1, (1 << 20) // (n * m))
        for some in (rows[k : k + step] for k in range(0, len(rows), step)):
            matrix = values[begin[some][:, None] + np.arange(n * m)].reshape(-1, n, m)
            free, each, least = np.ones((len(some), m), bool), np.arange(len(some)), threshold[some]
            for i in range(n):
                v = np.where(free, matrix[:, i], -np.inf)
                j = v.argmax(1)
                hit = free[each, j] & (v[each, j] >= least)
                free[each[hit], j[hit]] = False
                at = start[some] + i
                idx[at], score[at] = np.where(hit, j, -1), np.where(hit, v[each, j], 0)
                twice[at] = ~hit & (matrix[:, i] >= least[:, None]).any(1)
    columns = [pa.array(idx.astype(np.int32), mask=idx < 0), pa.array(score), pa.array(twice)]
    return pa.StructArray.from_arrays([lists(start, c) for c in columns], fields=list(kind))
