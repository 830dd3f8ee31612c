"""Views, geometric transforms and neighbourhood operators on row-major [height, width] arrays, as native columns.

Sizes are literals or integer columns. A window outside the image is an error where the text says so; null arrays stay
null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pixel import bind


def _int(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("int")


def gather(x: Column, height, width, source: Callable[[Column, Column], Column]) -> Column:
    """A [height, width] array whose element (row, column) is x at the flat place that source gives."""
    h, w = _int(height), _int(width)
    place = lambda i: source(F.floor(i / w).cast("int"), (i % w).cast("int")).cast("int")
    return _over(x, h * w, lambda y: lambda i: F.get(y, place(i)))


def _over(x: Column, n: Column, f: Callable[[Column], Callable[[Column], Column]]) -> Column:
    """f(x) of each place 0 to n - 1, with x evaluated once; null for null, empty where n is 0."""
    each = lambda y: F.when(y.isNull(), None).when(n == 0, F.slice(y, 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), f(y)))
    return bind(x, each)


def _inside(low: Column, high: Column, size: Column, out: Column, kind: str) -> Column:
    return F.when((low >= 0) & (high <= size), out).otherwise(F.raise_error(F.lit("window outside the image")).cast(kind))


def flip_h(x: Column, height, width) -> Column:
    return gather(x, height, width, lambda r, c: r * _int(width) + _int(width) - 1 - c)


def flip_v(x: Column, height, width) -> Column:
    return gather(x, height, width, lambda r, c: (_int(height) - 1 - r) * _int(width) + c)


def transpose(x: Column, height, width) -> Column:
    return gather(x, width, height, lambda r, c: c * _int(width) + r)


def rotate90(x: Column, height, width, turns: int = 1) -> Column:
    """Clockwise quarter turns, exact."""
    h, w = _int(height), _int(width)
    turned = {0: lambda: x, 1: lambda: gather(x, w, h, lambda r, c: (h - 1 - c) * w + r), 2: lambda: F.reverse(x), 3: lambda: gather(x, w, h, lambda r, c: c * w + w - 1 - r)}
    return turned[turns % 4]()


def crop(x: Column, height, width, top, left, rows, cols, kind: str = "array<double>") -> Column:
    """A window that must lie inside the image."""
    h, w, t, l = map(_int, (height, width, top, left))  # noqa: E741
    out = gather(x, rows, cols, lambda r, c: (t + r) * w + l + c)
    return _inside(t, t + _int(rows), h, _inside(l, l + _int(cols), w, out, kind), kind)


def _fold(i: Column, n: Column, mode: str) -> Column:
    """The place inside 0..n-1 that stands for place i."""
    if mode == "edge":
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    if mode == "reflect":
        period = F.greatest(2 * (n - 1), F.lit(1))
        m = F.pmod(i, period)
        return F.when(n == 1, 0).otherwise(F.least(m, period - m))
    m = F.pmod(i, 2 * n)
    return F.least(m, 2 * n - 1 - m)


def pad(x: Column, height, width, top=0, bottom=0, left=0, right=0, value: float = 0.0, mode: str = "constant") -> Column:
    """Modes constant, edge, reflect (without the edge) and symmetric (with it)."""
    h, w, t, l = map(_int, (height, width, top, left))  # noqa: E741
    out_h, out_w = h + t + _int(bottom), w + l + _int(right)
    if mode != "constant":
        return gather(x, out_h, out_w, lambda r, c: _fold(r - t, h, mode) * w + _fold(c - l, w, mode))
    place = lambda r, c: F.when((r >= t) & (r < t + h) & (c >= l) & (c < l + w), (r - t) * w + c - l).otherwise(-1)
    hole = F.lit(value).cast("double")
    at = lambda i: place(F.floor(i / F.nullif(out_w, F.lit(0))), i % F.nullif(out_w, F.lit(0))).cast("int")
    return _over(x, out_h * out_w, lambda y: lambda i: bind(at(i), lambda p: F.when(p < 0, hole).otherwise(F.get(y, p).cast("double"))))


def resize_nearest(x: Column, height, width, out_height, out_width) -> Column:
    """Place i reads floor((2 i + 1) * size / (2 * new size))."""
    h, w, oh, ow = map(_int, (height, width, out_height, out_width))
    return gather(x, oh, ow, lambda r, c: F.floor((2 * r + 1) * h / (2 * oh)) * w + F.floor((2 * c + 1) * w / (2 * ow)))


def neighbours(x: Column, height, width, f: Callable[[Column], Column], size: int = 3) -> Column:
    """f over the array of the size x size elements around each element, edges replicated."""
    h, w, k = _int(height), _int(width), size // 2
    around = [(dr, dc) for dr in range(-k, k + 1) for dc in range(-k, k + 1)]

    def at(y: Column, i: Column) -> Column:
        r, c = F.floor(i / w).cast("int"), (i % w).cast("int")
        return bind(F.array(*[F.get(y, (_fold(r + dr, h, "edge") * w + _fold(c + dc, w, "edge")).cast("int")) for dr, dc in around]), f)

    return _over(x, h * w, lambda y: lambda i: at(y, i))


def erode(x: Column, height, width, size: int = 3) -> Column:
    return neighbours(x, height, width, F.array_min, size)


def dilate(x: Column, height, width, size: int = 3) -> Column:
    return neighbours(x, height, width, F.array_max, size)


def morphology_gradient(x: Column, height, width, size: int = 3) -> Column:
    return neighbours(x, height, width, lambda v: F.array_max(v) - F.array_min(v), size)


def median_filter(x: Column, height, width, size: int = 3) -> Column:
    return neighbours(x, height, width, lambda v: F.element_at(F.array_sort(v), size * size // 2 + 1), size)


def convolve2d(x: Column, height, width, kernel: list[float], normalize: bool = False) -> Column:
    """Correlation with an odd square kernel, edges replicated, divided by the sum of absolute coefficients if asked."""
    size = round(len(kernel) ** 0.5)
    whole = sum(map(abs, kernel)) if normalize else 1.0
    k = F.array(*[F.lit(float(v)) for v in kernel])
    return neighbours(x, height, width, lambda v: F.aggregate(F.zip_with(v, k, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t) / whole, size)


def block_mean(x: Column, height, width, rows: int, cols: int) -> Column:
    """Means of rows x cols blocks; blocks at the far edges may be smaller."""
    h, w = _int(height), _int(width)
    oh, ow = F.ceil(h / rows).cast("int"), F.ceil(w / cols).cast("int")

    def at(y: Column, i: Column) -> Column:
        r, c = F.floor(i / ow).cast("int") * rows, (i % ow).cast("int") * cols
        cells = [F.when((r + a < h) & (c + b < w), F.get(y, ((r + a) * w + c + b).cast("int"))) for a in range(rows) for b in range(cols)]
        full = F.filter(F.array(*cells), lambda v: v.isNotNull())
        return bind(full, lambda v: F.aggregate(v, F.lit(0.0), lambda s, u: s + u) / F.size(v))

    return _over(x, oh * ow, lambda y: lambda i: at(y, i))
