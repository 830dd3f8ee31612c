"""Rows of Arrow columns as NumPy buffers or shapes, and back."""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa

from ..operators.contours import from_value, to_value
from ..operators.core import DTYPES, convert, dtype_name
from ..sources.blobs import MAGIC, from_blob, from_tensor, to_blob, to_tensor
from ..sources.codecs import ENCODERS, decode

#: What a column of one element type is stored as.
LEAF = {
    "u8": pa.int16(), "i8": pa.int8(), "u16": pa.int32(), "i16": pa.int16(), "u32": pa.int64(), "i32": pa.int32(), "f32": pa.float32(),
    "f64": pa.float64(), "u64": pa.decimal128(20, 0), "i64": pa.int64(), "str": pa.string(), "bool": pa.bool_(),
}
DDL = {
    "u8": "smallint", "i8": "tinyint", "u16": "int", "i16": "smallint", "u32": "bigint", "i32": "int", "f32": "float", "f64": "double",
    "u64": "decimal(20,0)", "i64": "bigint", "str": "string", "bool": "boolean",
}
POINT = "struct<x:double,y:double>"
CONTOUR = f"struct<exterior:array<{POINT}>,holes:array<array<{POINT}>>,is_closed:boolean>"
BBOX = "struct<x:double,y:double,width:double,height:double>"
TENSOR = "struct<data:binary,dtype:string,shape:array<bigint>,strides:array<bigint>,offset:bigint>"
BUCKET = "struct<lower_edge:double,upper_edge:double,count:bigint,normalized:double>"
CORRESPONDENCE = "struct<right_idx:array<int>,overlap:array<double>,duplicate:array<boolean>>"
DISTANCES = "struct<mean_a_to_b:double,mean_b_to_a:double,assd:double,hd:double,hd95:double>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_CONTOUR = pa.struct([("exterior", pa.list_(_POINT)), ("holes", pa.list_(pa.list_(_POINT))), ("is_closed", pa.bool_())])
_TENSOR = pa.struct([("data", pa.binary()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("strides", pa.list_(pa.int64())), ("offset", pa.int64())])
_BUCKET = pa.struct([("lower_edge", pa.float64()), ("upper_edge", pa.float64()), ("count", pa.int64()), ("normalized", pa.float64())])


def whole(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _numbers(col: pa.Array) -> np.ndarray:
    if pa.types.is_decimal(col.type):
        return np.asarray([int(v) for v in col.to_pylist()], np.uint64)
    return col.to_numpy(zero_copy_only=False)


def _list_rows(col: pa.Array, dtype, contiguous: bool):
    """A function from a row of a nested list column to its buffer; rows must be regular."""
    leaf, depth = col.type, 0
    while pa.types.is_list(leaf) or pa.types.is_large_list(leaf) or pa.types.is_fixed_size_list(leaf):
        leaf, depth = leaf.value_type, depth + 1
    d = DTYPES[dtype] if dtype else np.dtype("u1") if pa.types.is_boolean(leaf) else np.dtype("u8") if pa.types.is_decimal(leaf) else np.dtype(leaf.to_pandas_dtype())
    if depth == 1 and not pa.types.is_fixed_size_list(col.type):
        offsets, values = col.offsets.to_numpy(), col.values
        if values.null_count == 0:
            flat = _numbers(values)
            return lambda i: convert(flat[offsets[i] : offsets[i + 1]], d)

    def row(i: int) -> np.ndarray:
        v, shape = col[i].as_py(), []
        level = [v]
        for _ in range(depth):
            sizes = {len(x) for x in level if x is not None}
            if len(sizes) > 1 or any(x is None for x in level):
                raise ValueError("a list row is jagged or holds a null")
            shape.append(sizes.pop() if sizes else 0)
            level = [y for x in level for y in x]
        if any(x is None for x in level):
            raise ValueError("a list row holds a null")
        flat = np.asarray([int(x) for x in level], np.uint64) if pa.types.is_decimal(leaf) else np.asarray(level, leaf.to_pandas_dtype() if not pa.types.is_boolean(leaf) else np.uint8)
        return convert(flat.reshape(shape), d)

    return row


def reader(kind: str, options: dict):
    """A function from a column to a function from a row number to its value (None for null)."""
    dtype = options.get("dtype")
    cast = (lambda x: convert(x, dtype)) if dtype else (lambda x: x)

    def open_(col):
        col = whole(col)
        t, k = col.type, kind
        if k == "auto":
            if pa.types.is_struct(t):
                k = "tensor" if t.get_field_index("data") >= 0 and t.get_field_index("shape") >= 0 else "contour"
            elif pa.types.is_binary(t) or pa.types.is_large_binary(t):
                k = "bytes"
            elif pa.types.is_string(t) or pa.types.is_large_string(t):
                k = "file_path"
            elif pa.types.is_struct(t.value_type):
                k = "contour"
            else:
                k = "list"
        valid = ~np.asarray(col.is_null())
        if k in ("list", "array"):
            get = _list_rows(col, dtype, options.get("require_contiguous", False))
            if k == "array" and options.get("shape"):
                inner, want = get, tuple(options["shape"])

                def get(i):
                    x = inner(i)
                    if x.size != int(np.prod(want)):
                        raise ValueError(f"a row of {x.size} elements does not fill {list(want)}")
                    return x.reshape(want)

        elif k == "raw":
            get = lambda i: np.frombuffer(col[i].as_py(), DTYPES[dtype_name(dtype or "u8")])
        elif k == "blob":
            get = lambda i: cast(from_blob(col[i].as_py()))
        elif k == "image_bytes":
            get = lambda i: cast(decode(col[i].as_py(), options.get("orientation", "stored"), options.get("decode_max_size")))
        elif k == "bytes":
            get = lambda i: (lambda b: cast(from_blob(b) if b[:4] == MAGIC else decode(b, options.get("orientation", "stored"), options.get("decode_max_size"))))(col[i].as_py())
        elif k == "file_path":
            from ..sources.files import read_path

            get = lambda i: cast(decode(read_path(col[i].as_py(), options.get("allowed_roots")), options.get("orientation", "stored"), options.get("decode_max_size")))
        elif k == "tensor":
            get = lambda i: cast(from_tensor(col[i].as_py()))
        elif k == "contour":
            get = lambda i: from_value(col[i].as_py())
        else:
            raise ValueError(f"source {k!r} is unknown")
        return lambda i: get(i) if valid[i] else None

    return open_


def nested(rows: list, dtype: str, ndim: int) -> pa.Array:
    """Buffers (or None) of one rank as a nested list column."""
    d = DTYPES[dtype]
    held = [None if x is None else convert(np.ascontiguousarray(x), d) for x in rows]
    if any(x is not None and x.ndim != ndim for x in held):
        raise ValueError(f"a result has another rank than the planned {ndim}")
    flat = np.concatenate([np.zeros(0, d), *(x.ravel() for x in held if x is not None)])
    out = pa.array([decimal.Decimal(int(v)) for v in flat], LEAF[dtype]) if dtype == "u64" else pa.array(flat).cast(LEAF[dtype])
    for level in range(ndim - 1, -1, -1):
        sizes = [0 if x is None else x.shape[level] for x in held] if level == 0 else np.concatenate([np.zeros(0, np.int64), *(np.full(int(np.prod(x.shape[:level])), x.shape[level]) for x in held if x is not None)])
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        mask = pa.array([x is None for x in held]) if level == 0 and any(x is None for x in held) else None
        out = pa.ListArray.from_arrays(pa.array(offsets), out, mask=mask)
    return out


def sink_type(fmt: str, domain: str, dtype, ndim, options: dict) -> str:
    """DDL of what a sink gives."""
    if fmt in ("blob", "png", "jpeg", "webp", "tiff"):
        return "binary"
    if fmt in ("tensor", "numpy"):
        return TENSOR
    if fmt == "native":
        if domain == "contour":
            return f"array<{CONTOUR}>"
        if domain == "buckets":
            return f"array<{BUCKET}>"
        if domain == "scalar":
            return "double" if dtype in (None, "f32", "f64") else DDL[dtype]
        if domain != "vector":
            raise ValueError("sink native is for scalars, vectors and contours; a buffer goes to list, array, tensor or blob")
    if fmt in ("list", "array", "native", "long"):
        dtype = options.get("dtype") or dtype
        if domain in ("contour", "buckets"):
            return sink_type("native", domain, dtype, ndim, options)
        if domain == "scalar":
            return DDL[dtype or "f64"]
        if dtype is None:
            raise ValueError(f"sink {fmt}: the element type is not known before the rows are; give the source or the sink a dtype")
        if fmt == "long":
            names = options.get("names") or ["value"]
            return "array<struct<row:int,col:int," + ",".join(f"`{n}`:{DDL[dtype]}" for n in names) + ">>"
        ndim = len(options["shape"]) if fmt == "array" and options.get("shape") else options.get("ndim") or ndim
        if ndim is None:
            raise ValueError(f"sink {fmt}: the rank is not known before the rows are; give ndim")
        return "array<" * ndim + DDL[dtype] + ">" * ndim
    raise ValueError(f"sink {fmt!r} is none of tensor, array, list, native, long, blob, png, jpeg, tiff")


def writer(fmt: str, domain: str, dtype, ndim, options: dict):
    """A function from a list of values (None for null) to an Arrow array of sink_type."""
    dtype = options.get("dtype") or dtype
    if fmt in ("blob", "png", "tiff", "jpeg", "webp"):
        if fmt == "webp":
            raise ValueError("sink webp is not built: no lossless or lossy WebP encoder")
        to = to_blob if fmt == "blob" else (lambda x: ENCODERS["jpeg"](x, options.get("quality", 85))) if fmt == "jpeg" else ENCODERS[fmt]
        return lambda rows: pa.array([None if x is None else to(np.asarray(x)) for x in rows], pa.binary())
    if fmt in ("tensor", "numpy"):
        half = options.get("dtype") in ("f16", "float16")
        return lambda rows: pa.array([None if x is None else to_tensor(np.asarray(x), half) for x in rows], _TENSOR)
    if domain == "contour":
        return lambda rows: pa.array([None if x is None else [to_value(s) for s in x] for x in rows], pa.list_(_CONTOUR))
    if domain == "buckets":
        return lambda rows: pa.array(rows, pa.list_(_BUCKET))
    if domain == "scalar":
        leaf = LEAF[dtype if fmt == "native" and dtype not in (None, "f32") else dtype or "f64"] if dtype != "f32" or fmt != "native" else pa.float64()
        if dtype == "u64":
            return lambda rows: pa.array([None if x is None else decimal.Decimal(int(x)) for x in rows], leaf)
        return lambda rows: pa.array([None if x is None else x.item() if hasattr(x, "item") else x for x in rows], leaf)
    if fmt == "long":
        names = options.get("names") or ["value"]
        where = options.get("where")

        def pixels(x):
            y = x[:, :, None] if x.ndim == 2 else x
            extra = 1 if where else 0
            if y.ndim != 3 or y.shape[2] != len(names) + extra:
                raise ValueError(f"sink long: {len(names)} names for shape {list(x.shape)}")
            r, c = np.nonzero(y[:, :, -1] > 0) if where else (v.ravel() for v in np.indices(y.shape[:2]))
            return [{"row": i, "col": j, **dict(zip(names, v, strict=True))} for i, j, v in zip(r.tolist(), c.tolist(), convert(y[r, c, : len(names)], dtype).tolist(), strict=True)]

        kind = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), *((n, LEAF[dtype]) for n in names)]))
        return lambda rows: pa.array([None if x is None else pixels(x) for x in rows], kind)
    if dtype in ("str", "bool"):
        return lambda rows: pa.array([None if x is None else x.tolist() for x in rows], pa.list_(LEAF[dtype]))
    ndim = len(options["shape"]) if fmt == "array" and options.get("shape") else options.get("ndim") or ndim
    shape = tuple(options["shape"]) if fmt == "array" and options.get("shape") else None

    def rows_(rows):
        if shape:
            for x in rows:
                if x is not None and x.shape != shape:
                    raise ValueError(f"sink array: a row has shape {list(x.shape)}, not {list(shape)}")
        return nested([None if x is None else np.asarray(x) for x in rows], dtype_name(dtype), ndim)

    return rows_
