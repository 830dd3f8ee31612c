"""Element-wise, reducing and pairwise operators on flat numeric arrays, as native column expressions.

Integers are promoted by the caller's array type; null arrays stay null. NaN passes through every operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _each(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f over every element as double; NaN stays NaN."""
    return lambda x: F.transform(x, lambda v: F.when(F.isnan(v.cast("double")), v.cast("double")).otherwise(f(v.cast("double")).cast("double")))


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, wherever f names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _signed_inf(v: Column) -> Column:
    return F.when(v < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with infinities and NaN in place of errors."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).otherwise(_signed_inf(a))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


relu = _each(lambda v: F.greatest(v, F.lit(0.0)))
neg = _each(lambda v: -v)
absolute = _each(F.abs)
square = _each(lambda v: v * v)
sqrt = _each(lambda v: F.when(v >= 0, F.sqrt(v)).otherwise(F.lit(float("nan"))))
reciprocal = _each(lambda v: ieee_div(F.lit(1.0), v))
sign = _each(F.signum)
floor = _each(lambda v: F.when(F.abs(v) < 2**52, F.floor(v).cast("double")).otherwise(v))
ceil = _each(lambda v: F.when(F.abs(v) < 2**52, F.ceil(v).cast("double")).otherwise(v))
round_even = _each(F.rint)
trunc = _each(lambda v: F.when(F.abs(v) < 2**52, F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double")).otherwise(v))


def scale(x: Column, factor) -> Column:
    return _each(lambda v: v * factor)(x)


def add_constant(x: Column, value) -> Column:
    return _each(lambda v: v + value)(x)


def subtract_constant(x: Column, value) -> Column:
    return _each(lambda v: v - value)(x)


def clamp(x: Column, low, high) -> Column:
    return _each(lambda v: F.least(F.greatest(v, F.lit(low)), F.lit(high)))(x)


def clamp_min(x: Column, low) -> Column:
    return _each(lambda v: F.greatest(v, F.lit(low)))(x)


def clamp_max(x: Column, high) -> Column:
    return _each(lambda v: F.least(v, F.lit(high)))(x)


def threshold(x: Column, value) -> Column:
    """255 where the element is above value, else 0 (also for NaN)."""
    return F.transform(x, lambda v: F.when((v > value) & ~F.isnan(v.cast("double")), 255).otherwise(0))


def invert(x: Column, top=1.0) -> Column:
    return _each(lambda v: F.lit(top) - v)(x)


def adjust_gamma(x: Column, gamma, top=1.0) -> Column:
    return _each(lambda v: F.pow(F.least(F.greatest(v / top, F.lit(0.0)), F.lit(1.0)), F.lit(gamma)) * top)(x)


def normalize_range(x: Column, low, high) -> Column:
    return _each(lambda v: F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)))(x)


def cast_u8(x: Column) -> Column:
    """Round half away from zero, saturate to 0..255; NaN becomes 0."""
    return F.transform(x, lambda v: F.when(F.isnan(v.cast("double")), 0).otherwise(F.least(F.greatest(F.round(F.least(F.greatest(v.cast("double"), F.lit(-1.0)), F.lit(256.0))), F.lit(0.0)), F.lit(255.0))).cast("int"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    """NaN for an empty array."""
    return bind(x, lambda y: F.when(F.size(y) == 0, F.lit(float("nan"))).otherwise(total(y) / F.nullif(F.size(y), F.lit(0))))


def variance(x: Column, ddof: int = 0) -> Column:
    def of(y, m):
        n = F.size(y) - ddof
        return F.when(n <= 0, F.lit(float("nan"))).otherwise(F.aggregate(y, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.when(n > 0, n))

    return bind(x, lambda y: bind(mean(y), lambda m: of(y, m)))


def std(x: Column, ddof: int = 0) -> Column:
    return F.sqrt(variance(x, ddof))


def reduce_max(x: Column) -> Column:
    """NaN where one element is NaN, as Spark orders NaN last."""
    return F.array_max(x)


def _any_nan(x: Column) -> Column:
    return F.exists(x, lambda v: F.isnan(v.cast("double")))


def reduce_min(x: Column) -> Column:
    """NaN where one element is NaN."""
    return bind(x, lambda y: F.when(_any_nan(y), F.array_max(y)).otherwise(F.array_min(y)))


def percentile(x: Column, q: float) -> Column:
    """Linear interpolation between the two nearest ranks; NaN where one element is NaN."""

    def of(s):
        pos = (F.size(s) - 1) * (q / 100)
        lo = F.floor(pos).cast("int")
        a = F.try_element_at(s, lo + 1).cast("double")
        b = F.coalesce(F.try_element_at(s, lo + 2), F.try_element_at(s, lo + 1)).cast("double")
        return F.when(F.isnan(F.try_element_at(s, F.lit(-1)).cast("double")), F.lit(float("nan"))).otherwise(a + (b - a) * (pos - lo))

    return bind(F.array_sort(x), of)


def normalize_minmax(x: Column) -> Column:
    """(x - min) / (max - min); zeros where all are equal."""
    scaled = lambda y, e: F.transform(y, lambda v: F.when(e["high"] > e["low"], (v - e["low"]) / F.nullif(e["high"] - e["low"], F.lit(0.0))).otherwise(F.lit(0.0)))
    return bind(x, lambda y: bind(F.struct(F.array_min(y).cast("double").alias("low"), F.array_max(y).cast("double").alias("high")), lambda e: scaled(y, e)))


def normalize_zscore(x: Column) -> Column:
    """(x - mean) / std; zeros where all are equal."""
    scaled = lambda y, e: F.transform(y, lambda v: F.when(e["s"] > 0, (v - e["m"]) / F.nullif(e["s"], F.lit(0.0))).otherwise(F.lit(0.0)))
    return bind(x, lambda y: bind(F.struct(mean(y).alias("m"), std(y).alias("s")), lambda e: scaled(y, e)))


def adjust_contrast(x: Column, factor) -> Column:
    return bind(x, lambda y: bind(mean(y), lambda m: F.transform(y, lambda v: (v - m) * factor + m)))


def argmax(x: Column) -> Column:
    return bind(x, lambda y: F.array_position(y, F.array_max(y)) - 1)


def argmin(x: Column) -> Column:
    """The first NaN, or the first of the smallest."""
    return bind(x, lambda y: bind(reduce_min(y), lambda m: F.array_position(y, m) - 1))


def _same_size(x: Column, y: Column, out: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), None).when(F.size(x) == F.size(y), out).otherwise(F.raise_error(F.lit("operands differ in shape")).cast("array<double>"))


def binary(x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f over pairs of elements; operands must have one shape."""
    pairs = lambda p: _same_size(p["x"], p["y"], F.zip_with(p["x"], p["y"], lambda a, b: f(a.cast("double"), b.cast("double")).cast("double")))
    return bind(F.struct(x.alias("x"), y.alias("y")), pairs)


def add(x, y):
    return binary(x, y, lambda a, b: a + b)


def subtract(x, y):
    return binary(x, y, lambda a, b: a - b)


def multiply(x, y):
    return binary(x, y, lambda a, b: a * b)


def divide(x, y):
    return binary(x, y, ieee_div)


def maximum(x, y):
    return binary(x, y, F.greatest)


def minimum(x, y):
    """NaN where either is."""
    return binary(x, y, lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b)))


def bits(x: Column) -> Column:
    """One bit for each element: above the mean of its array."""
    return bind(x, lambda y: bind(mean(y), lambda m: F.transform(y, lambda v: (v > m).cast("int"))))


def hamming_distance(x: Column, y: Column) -> Column:
    """Bits that differ between two hashes (arrays of bytes or bits) of one length; other lengths are an error."""
    differ = lambda p: F.aggregate(F.zip_with(p["x"], p["y"], lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    one = lambda p: F.when(p["x"].isNull() | p["y"].isNull(), None).when(F.size(p["x"]) == F.size(p["y"]), differ(p)).otherwise(F.raise_error(F.lit("hashes differ in length")).cast("int"))
    return bind(F.struct(x.alias("x"), y.alias("y")), one)


def hash_similarity(x: Column, y: Column, n_bits: int | None = None) -> Column:
    """100 (1 - distance / bits); a hash of bytes has 8 bits an element unless n_bits says otherwise."""
    n = F.lit(n_bits) if n_bits else F.size(x) * 8
    return 100.0 * (1.0 - hamming_distance(x, y) / n)
