"""Element-wise, binary and masked operators."""

from __future__ import annotations

import numpy as np

from .core import DTYPES, REQUIRED, as_float, convert, dtype_name, fixed, image, joint, like, operator, promoted, same, top_of, wide


def _map(name, f, params=None):
    def run(x, **p):
        with np.errstate(all="ignore"):
            y = as_float(x)
            return f(y, **p).astype(y.dtype, copy=False)

    operator(name, params, dtype=promoted)(run)


def _larger(x, v):
    return np.where(np.isnan(x), x, np.maximum(x, v))


_map("scale", lambda x, factor: x * x.dtype.type(factor), {"factor": REQUIRED})
_map("relu", lambda x: _larger(x, 0))
_map("clamp", lambda x, min, max: np.clip(x, min, max), {"min": REQUIRED, "max": REQUIRED})
_map("clamp_min", lambda x, value: _larger(x, x.dtype.type(value)), {"value": REQUIRED})
_map("clamp_max", lambda x, value: np.minimum(x, x.dtype.type(value)), {"value": REQUIRED})
_map("add_constant", lambda x, value: x + x.dtype.type(value), {"value": REQUIRED})
_map("subtract_constant", lambda x, value: x - x.dtype.type(value), {"value": REQUIRED})
_map("neg", np.negative)
_map("abs", np.abs)
_map("sqrt", np.sqrt)
_map("square", np.square)
_map("reciprocal", lambda x: 1 / x)
_map("sign", np.sign)
_map("floor", np.floor)
_map("ceil", np.ceil)
_map("round", np.rint)
_map("trunc", np.trunc)
_map("adjust_contrast", lambda x, factor: ((x - x.mean(dtype=float)) * factor + x.mean(dtype=float)), {"factor": REQUIRED})


@operator("cast", {"dtype": REQUIRED}, dtype=lambda d, p: dtype_name(p["dtype"]), fixed=("dtype",))
def cast(x, dtype):
    return convert(x, dtype_name(dtype))


@operator("adjust_gamma", {"gamma": REQUIRED})
def adjust_gamma(x, gamma):
    top = top_of(x.dtype)
    with np.errstate(all="ignore"):
        return convert(np.clip(x.astype(float) / top, 0, 1) ** gamma * top, x.dtype)


@operator("invert")
def invert(x):
    if x.dtype.kind == "f":
        return 1 - x
    return ~x  # largest plus smallest minus x


@operator("threshold", {"value": REQUIRED}, dtype=fixed("u8"))
def threshold(x, value):
    return np.where(x > value, 255, 0).astype(np.uint8)


def _finished(y, out_dtype):
    return convert(y.astype(np.float32), dtype_name(out_dtype)) if out_dtype else y.astype(np.float32)


def _out(dtypes, params):
    return dtype_name(params["out_dtype"]) if params.get("out_dtype") else "f32"


def _window(x, low, high):
    with np.errstate(all="ignore"):
        return np.clip((x - low) / (high - low), 0, 1) if high > low else np.zeros(x.shape)


@operator("normalize", {"method": "minmax", "out_dtype": None}, dtype=_out, fixed=("method", "out_dtype"))
def normalize(x, method, out_dtype):
    y = x.astype(float)
    if not y.size:
        return _finished(y, out_dtype)
    if method == "minmax":
        low, spread = y.min(), y.max() - y.min()
    elif method == "zscore":
        low, spread = y.mean(), y.std()
    else:
        raise ValueError(f"normalize: method {method!r} is neither minmax nor zscore")
    return _finished(np.zeros(y.shape) if spread == 0 else (y - low) / spread, out_dtype)


@operator("normalize_preset", {"mean": REQUIRED, "std": REQUIRED, "out_dtype": None}, dtype=_out, fixed=("out_dtype",))
def normalize_preset(x, mean, std, out_dtype):
    y = image(x)
    if len(mean) != y.shape[2] or len(std) != y.shape[2]:
        raise ValueError(f"normalize_preset: {len(mean)} means and {len(std)} deviations for {y.shape[2]} channels")
    return _finished(like((y - np.asarray(mean, float)) / np.asarray(std, float), x), out_dtype)


def _percent(q):
    if not 0 <= q <= 100:
        raise ValueError(f"a percentile lies in 0 to 100, not {q}")
    return float(q)


@operator("normalize_percentile", {"low": REQUIRED, "high": REQUIRED, "out_dtype": None}, dtype=_out, fixed=("out_dtype",))
def normalize_percentile(x, low, high, out_dtype):
    y = x.astype(float)
    if not y.size:
        raise ValueError("normalize_percentile: an empty buffer has no percentile")
    a, b = np.percentile(y, [_percent(low), _percent(high)])
    return _finished(np.full(y.shape, np.nan) if np.isnan(y).any() else _window(y, a, b), out_dtype)


@operator("normalize_range", {"low": REQUIRED, "high": REQUIRED, "out_dtype": None}, dtype=_out, fixed=("out_dtype",))
def normalize_range(x, low, high, out_dtype):
    if not low < high:
        raise ValueError("normalize_range: low must be below high")
    return _finished(_window(x.astype(float), low, high), out_dtype)


@operator("apply_lut", {"table": REQUIRED, "out_dtype": "u8"}, dtype=lambda d, p: dtype_name(p["out_dtype"]), ndim=lambda n, p: None if n is None else n + (np.ndim(p["table"]) == 2 and np.shape(p["table"])[1] > 1), fixed=("table", "out_dtype"))
def apply_lut(x, table, out_dtype):
    if dtype_name(x) not in ("u8", "u16"):
        raise ValueError("apply_lut: a u8 or u16 buffer is needed")
    t = convert(np.asarray(table, float), dtype_name(out_dtype))
    if x.size and int(x.max()) >= len(t):
        raise ValueError(f"apply_lut: value {int(x.max())} has no row in a table of {len(t)}")
    out = t[x]
    return out[..., 0] if t.ndim == 2 and t.shape[1] == 1 else out


def _pair(x, y):
    if x.shape != y.shape:
        raise ValueError(f"operands differ in shape: {list(x.shape)} and {list(y.shape)}")
    d = np.result_type(x.dtype, y.dtype)
    return x.astype(d), y.astype(d)


def _saturating(f):
    """f on whole numbers wide enough, cut to the type's range; on floats as it is."""

    def run(x, other):
        a, b = _pair(x, other)
        if a.dtype.kind == "f":
            with np.errstate(all="ignore"):
                return f(a, b)
        info = np.iinfo(a.dtype)
        held = np.int64 if a.dtype.itemsize < 4 else object
        return np.clip(f(a.astype(held), b.astype(held)), int(info.min), int(info.max)).astype(a.dtype)

    return run


for _name, _f in {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b}.items():
    operator(_name, nodes=("other",), dtype=joint)(_saturating(_f))


def _quiet(f):
    def run(x, other):
        with np.errstate(all="ignore"):
            return f(*_pair(x, other))

    return run


operator("maximum", nodes=("other",), dtype=joint)(_quiet(np.maximum))
operator("minimum", nodes=("other",), dtype=joint)(_quiet(np.minimum))


@operator("blend", nodes=("other",), dtype=joint)
def blend(x, other):
    a, b = _pair(x, other)
    if a.dtype.kind == "f":
        return a * b
    return convert(a.astype(float) * b.astype(float) / top_of(a.dtype), a.dtype)


@operator("divide", nodes=("other",), dtype=lambda d, p: None if None in d else promoted([joint(d, p)], p))
def divide(x, other):
    a, b = _pair(x, other)
    kind = a.dtype if a.dtype.kind == "f" else wide(a.dtype)
    with np.errstate(all="ignore"):
        return a.astype(kind) / b.astype(kind)


def _bitwise(name, f):
    def run(x, other):
        a, b = _pair(x, other)
        if a.dtype.kind == "f":
            raise ValueError(f"{name}: integers are needed")
        return f(a, b)

    operator(name, nodes=("other",), dtype=joint)(run)


_bitwise("bitwise_and", np.bitwise_and)
_bitwise("bitwise_or", np.bitwise_or)
_bitwise("bitwise_xor", np.bitwise_xor)


def mask_of(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask as [H, W, 1] or [H, W, C] for the image x."""
    y, m = image(x), image(mask)
    if m.shape[:2] != y.shape[:2] or m.shape[2] not in (1, y.shape[2]):
        raise ValueError(f"a mask of shape {list(mask.shape)} does not fit {list(x.shape)}")
    return m


@operator("apply_mask", {"invert": False}, nodes=("mask",))
def apply_mask(x, mask, invert):
    m = mask_of(x, mask)
    if m.dtype == np.uint8:
        weight = m / 255.0
    elif m.dtype.kind == "f":
        weight = m.astype(float)
    else:
        raise ValueError("apply_mask: a mask is u8 or float")
    return like(convert(image(x) * (1 - weight if invert else weight), x.dtype), x)


@operator("masked_select", nodes=("mask",), ndim=lambda n, p: 1)
def masked_select(x, mask):
    return image(x)[np.broadcast_to(mask_of(x, mask) > 0, image(x).shape)]


@operator("normalize_percentile_masked", {"low": REQUIRED, "high": REQUIRED, "out_dtype": None}, nodes=("mask",), dtype=_out, fixed=("out_dtype",))
def normalize_percentile_masked(x, mask, low, high, out_dtype):
    v = masked_select(x, mask).astype(float)
    if not v.size:
        return _finished(np.zeros(x.shape), out_dtype)
    if np.isnan(v).any():
        return _finished(np.full(x.shape, np.nan), out_dtype)
    a, b = np.percentile(v, [_percent(low), _percent(high)])
    return _finished(_window(x.astype(float), a, b), out_dtype)


@operator("channel_merge", nodes=("others",), ndim=lambda n, p: 3)
def channel_merge(x, others):
    parts = [image(v) for v in (x, *others)]
    if len({p.shape[:2] for p in parts}) > 1 or len({p.dtype for p in parts}) > 1:
        raise ValueError("channel_merge: operands differ in size or element type")
    return np.concatenate(parts, 2)
