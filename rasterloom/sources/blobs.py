"""VIEW blobs and tensor structs: typed n-dimensional buffers as bytes."""

from __future__ import annotations

import struct

import numpy as np

from ..operators.core import DTYPES, LONG_NAME, WIRE_CODE, dtype_name

#: Fixed values of the format: magic, version and the 64-byte header (little-endian).
MAGIC = b"VIEW"
VERSION = 1
HEADER = struct.Struct("<4sHBBQQ40x")
CODE_NAME = {c: n for n, c in WIRE_CODE.items()}
STRIDED = 1


def to_blob(x: np.ndarray) -> bytes:
    """Header, shape and the elements in C order."""
    x = np.ascontiguousarray(x)
    head = HEADER.pack(MAGIC, VERSION, WIRE_CODE[dtype_name(x)], x.ndim, HEADER.size + 8 * x.ndim, 0)
    return head + struct.pack(f"<{x.ndim}Q", *x.shape) + x.tobytes()


def from_blob(b: bytes) -> np.ndarray:
    if len(b) < HEADER.size:
        raise ValueError(f"a blob of {len(b)} bytes is shorter than its header")
    magic, version, code, rank, offset, flags = HEADER.unpack_from(b)
    if magic != MAGIC or version != VERSION or code not in CODE_NAME:
        raise ValueError("no blob of this format and version")
    d = DTYPES[CODE_NAME[code]]
    if HEADER.size + 8 * rank > len(b):
        raise ValueError("a blob ends inside its shape")
    shape = struct.unpack_from(f"<{rank}Q", b, HEADER.size)
    strides = None
    if flags & STRIDED:
        if HEADER.size + 16 * rank > len(b):
            raise ValueError("a blob ends inside its strides")
        strides = struct.unpack_from(f"<{rank}q", b, HEADER.size + 8 * rank)
    return view(b, d, shape, strides, offset)


def view(b: bytes, d: np.dtype, shape, strides, offset: int) -> np.ndarray:
    """The buffer that shape, byte strides and offset describe; every element must lie inside the bytes."""
    shape = tuple(int(v) for v in shape)
    if strides is None:
        count = int(np.prod(shape, dtype=object)) if shape else 1
        if offset < 0 or offset + count * d.itemsize > len(b):
            raise ValueError("a buffer reaches past its bytes")
        return np.frombuffer(b, d, count, offset).reshape(shape)
    strides = tuple(int(v) for v in strides)
    reach = [(s * (n - 1)) for s, n in zip(strides, shape, strict=True)]
    if all(shape) and (offset + sum(min(0, r) for r in reach) < 0 or offset + sum(max(0, r) for r in reach) + d.itemsize > len(b)):
        raise ValueError("a buffer reaches past its bytes")
    if not all(shape):
        return np.zeros(shape, d)
    whole = np.frombuffer(b, np.uint8)
    return np.ndarray(shape, d, whole, offset, strides)


def to_tensor(x: np.ndarray, half: bool = False) -> dict:
    """The published struct, C order; `half` stores floats in 16 bits."""
    x = np.ascontiguousarray(x)
    name = {v: k for k, v in LONG_NAME.items()}[dtype_name(x)]
    if half:
        if x.dtype.kind != "f":
            raise ValueError("only floats are stored in 16 bits")
        x, name = x.astype(np.float16), "float16"
    return {"data": x.tobytes(), "dtype": name, "shape": list(x.shape), "strides": list(x.strides), "offset": 0}


def from_tensor(t: dict) -> np.ndarray:
    """A tensor struct, strided ones included; float16 is read as f32."""
    half = t["dtype"] == "float16"
    d = np.dtype(np.float16) if half else DTYPES[dtype_name(t["dtype"])]
    x = view(t["data"], d, t["shape"], t.get("strides"), int(t.get("offset") or 0))
    return x.astype(np.float32) if half else x


def numpy_from_struct(t) -> np.ndarray | None:
    """The buffer of a collected tensor struct (a Row or a dict)."""
    return None if t is None else from_tensor(t.asDict(recursive=True) if hasattr(t, "asDict") else t)


def numpy_from_column(df, column: str) -> list[np.ndarray | None]:
    """The buffers of a tensor column, collected: for results that fit the driver."""
    return [numpy_from_struct(v) for v in df.select(column).toArrow().column(0).to_pylist()]
