"""Element types, conversion rules and the table of operators.

A buffer is a NumPy array of one of ten element types, an image one of shape [H, W] or [H, W, C]. An operator is a
function of the buffer (and of other nodes' values) with named parameters, and rules that tell its result's element
type and rank before any row is seen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

#: Names of the element types and their codes in a VIEW blob.
DTYPES = {
    "u8": np.dtype("u1"), "i8": np.dtype("i1"), "u16": np.dtype("u2"), "i16": np.dtype("i2"), "u32": np.dtype("u4"),
    "i32": np.dtype("i4"), "f32": np.dtype("f4"), "f64": np.dtype("f8"), "u64": np.dtype("u8"), "i64": np.dtype("i8"),
}
WIRE_CODE = {"u8": 1, "i8": 2, "u16": 3, "i16": 4, "u32": 5, "i32": 6, "f32": 7, "f64": 8, "u64": 9, "i64": 10}
#: Spark has no unsigned types: the next wider one stands for them.
SPARK = {
    "u8": T.ShortType(), "i8": T.ByteType(), "u16": T.IntegerType(), "i16": T.ShortType(), "u32": T.LongType(),
    "i32": T.IntegerType(), "f32": T.FloatType(), "f64": T.DoubleType(), "u64": T.DecimalType(20, 0), "i64": T.LongType(),
}
LONG_NAME = {"uint8": "u8", "int8": "i8", "uint16": "u16", "int16": "i16", "uint32": "u32", "int32": "i32", "float32": "f32", "float64": "f64", "uint64": "u64", "int64": "i64"}


def dtype_name(x) -> str:
    """Short name of an element type given by short name, NumPy name, NumPy dtype or array."""
    if isinstance(x, np.ndarray):
        x = x.dtype
    if isinstance(x, str) and x in DTYPES:
        return x
    try:
        return LONG_NAME[np.dtype(x).name]
    except (KeyError, TypeError):
        raise ValueError(f"unknown element type {x!r}; one of {', '.join(DTYPES)}") from None


def top_of(dtype) -> float:
    """The largest value of an integer type, 1 for floats."""
    d = np.dtype(dtype)
    return 1.0 if d.kind == "f" else float(np.iinfo(d).max)


def wide(dtype) -> np.dtype:
    """What sums of a type are taken in: f64 for f64 and 32/64-bit integers, else f32."""
    d = np.dtype(dtype)
    return np.dtype("f8") if d.itemsize == 8 or (d.kind != "f" and d.itemsize == 4) else np.dtype("f4")


def as_float(x: np.ndarray) -> np.ndarray:
    return x if x.dtype.kind == "f" else x.astype(wide(x.dtype))


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounded to whole numbers, halves away from zero."""
    whole = np.trunc(x)
    return whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0)


def convert(x: np.ndarray, dtype) -> np.ndarray:
    """x in another element type: integers wrap; floats to integers round halves away from zero and saturate, NaN is 0."""
    d = np.dtype(DTYPES.get(dtype, dtype))
    if x.dtype == d:
        return x
    with np.errstate(invalid="ignore", over="ignore"):
        if d.kind == "f" or x.dtype.kind != "f":
            return x.astype(d)
        info = np.iinfo(d)
        if d.kind == "u" and d.itemsize < 4:  # the common case; whatever is negative ends at 0
            r = np.floor(x)
            r += x - r >= 0.5
            np.clip(r, 0, info.max, out=r)
            if np.isnan(r).any():
                r[np.isnan(r)] = 0
            return r.astype(d)
        r = half_away(np.where(np.isnan(x), 0, x).astype(np.float64))
        out = np.clip(r, float(info.min), float(info.max) if d.itemsize < 8 else float(2**62)).astype(d)
        if d.itemsize == 8:  # the top of 64 bits is no double
            big = r >= 2.0**62
            out[big] = [min(int(info.max), int(v)) if np.isfinite(v) else int(info.max) for v in r[big]]
        return out


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable
    params: dict
    nodes: tuple[str, ...]
    takes: str  # domain of the input: buffer, contour, any
    gives: str  # buffer, contour, scalar, vector
    dtype: Callable = field(compare=False)
    ndim: Callable = field(compare=False)
    fixed: tuple[str, ...] = ()  # parameters that are never per row


OPERATORS: dict[str, Operator] = {}


def promoted(dtypes: list, params: dict):
    """Integers become floats, floats stay."""
    d = dtypes[0]
    return None if d is None else dtype_name(DTYPES[d] if DTYPES[d].kind == "f" else wide(DTYPES[d]))


def same(dtypes: list, params: dict):
    return dtypes[0]


def fixed(name: str):
    return lambda dtypes, params: name


def joint(dtypes: list, params: dict):
    if None in dtypes:
        return None
    return dtype_name(np.result_type(*[DTYPES[d] for d in dtypes]))


def operator(name: str, params: dict | None = None, *, nodes: tuple[str, ...] = (), takes: str = "buffer", gives: str = "buffer", dtype=same, ndim=None, fixed: tuple[str, ...] = ()):
    """Register a kernel. A parameter without default has the value REQUIRED."""

    def add(f):
        OPERATORS[name] = Operator(name, f, dict(params or {}), nodes, takes, gives, dtype, ndim or (lambda n, p: n), fixed)
        return f

    return add


REQUIRED = object()


def image(x: np.ndarray) -> np.ndarray:
    """x as [H, W, C]."""
    if x.ndim == 2:
        return x[:, :, None]
    if x.ndim != 3:
        raise ValueError(f"an image has shape [H, W] or [H, W, C], not {list(x.shape)}")
    return x


def like(out: np.ndarray, x: np.ndarray) -> np.ndarray:
    """[H, W, C] in the rank of x."""
    return out[:, :, 0] if x.ndim == 2 else out


def single(x: np.ndarray) -> np.ndarray:
    """A one-channel image as [H, W]."""
    y = image(x)
    if y.shape[2] != 1:
        raise ValueError(f"a single channel is needed, not {y.shape[2]}")
    return y[:, :, 0]
