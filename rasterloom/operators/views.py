"""Views, windows and padding."""

from __future__ import annotations

import numpy as np

from .core import REQUIRED, convert, fixed, image, like, operator


def _bounds(x, top, left, height, width):
    h, w = x.shape[:2]
    return h - top if height is None else height, w - left if width is None else width


@operator("crop", {"top": 0, "left": 0, "height": None, "width": None})
def crop(x, top, left, height, width):
    image(x)
    height, width = _bounds(x, top, left, height, width)
    if top < 0 or left < 0 or height < 0 or width < 0 or top + height > x.shape[0] or left + width > x.shape[1]:
        raise ValueError(f"crop: window [{top}, {left}, {height}, {width}] is outside the image {list(x.shape)}")
    return x[top : top + height, left : left + width]


@operator("crop_clip", {"top": 0, "left": 0, "height": None, "width": None})
def crop_clip(x, top, left, height, width):
    image(x)
    height, width = _bounds(x, top, left, height, width)
    a, b, c, d = max(0, top), min(x.shape[0], top + height), max(0, left), min(x.shape[1], left + width)
    if a >= b or c >= d:
        raise ValueError(f"crop_clip: window [{top}, {left}, {height}, {width}] misses the image {list(x.shape)}")
    return x[a:b, c:d]


@operator("crop_pad", {"top": 0, "left": 0, "height": REQUIRED, "width": REQUIRED, "value": 0.0})
def crop_pad(x, top, left, height, width, value):
    image(x)
    out = np.full((height, width, *x.shape[2:]), convert(np.asarray([value], float), x.dtype)[0], x.dtype)
    a, b, c, d = max(0, top), min(x.shape[0], top + height), max(0, left), min(x.shape[1], left + width)
    if a < b and c < d:
        out[a - top : b - top, c - left : d - left] = x[a:b, c:d]
    return out


@operator("transpose", {"axes": REQUIRED}, fixed=("axes",))
def transpose(x, axes):
    if sorted(axes) != list(range(x.ndim)):
        raise ValueError(f"transpose: axes {list(axes)} are no permutation of {x.ndim}")
    return x.transpose(axes)


@operator("reshape", {"shape": REQUIRED}, ndim=lambda n, p: len(p["shape"]))
def reshape(x, shape):
    if int(np.prod(shape)) != x.size:
        raise ValueError(f"reshape: {x.size} elements do not fill {list(shape)}")
    return np.ascontiguousarray(x).reshape([int(v) for v in shape])


@operator("flip", {"axes": REQUIRED, "when": True}, fixed=("axes",))
def flip(x, axes, when):
    if any(not -x.ndim <= a < x.ndim for a in axes):
        raise ValueError(f"flip: axes {list(axes)} are not all below {x.ndim}")
    return np.flip(x, tuple(axes)) if when else x


@operator("channel_select", {"index": REQUIRED, "keepdims": True}, ndim=lambda n, p: 3 if p["keepdims"] else 2, fixed=("keepdims",))
def channel_select(x, index, keepdims):
    y = image(x)
    if not 0 <= index < y.shape[2]:
        raise ValueError(f"channel_select: no channel {index} of {y.shape[2]}")
    return y[:, :, index : index + 1] if keepdims else y[:, :, index]


@operator("channel_swap", {"order": REQUIRED})
def channel_swap(x, order):
    y = image(x)
    if sorted(order) != list(range(y.shape[2])):
        raise ValueError(f"channel_swap: {list(order)} is no permutation of {y.shape[2]} channels")
    return like(y[:, :, list(order)], x)


@operator("squeeze", {"axis": REQUIRED}, ndim=lambda n, p: None if n is None else n - 1, fixed=("axis",))
def squeeze(x, axis):
    return np.squeeze(x, axis)


@operator("expand_dims", {"axis": REQUIRED}, ndim=lambda n, p: None if n is None else n + 1, fixed=("axis",))
def expand_dims(x, axis):
    return np.expand_dims(x, axis)


#: Pad modes and what NumPy calls them.
MODES = {"constant": "constant", "edge": "edge", "reflect": "reflect", "symmetric": "symmetric"}


@operator("pad", {"top": 0, "bottom": 0, "left": 0, "right": 0, "value": 0.0, "mode": "constant"})
def pad(x, top, bottom, left, right, value, mode):
    image(x)
    if mode not in MODES:
        raise ValueError(f"pad: mode {mode!r} is none of {', '.join(MODES)}")
    width = [(top, bottom), (left, right)] + [(0, 0)] * (x.ndim - 2)
    if mode == "constant":
        return np.pad(x, width, constant_values=convert(np.asarray([value], float), x.dtype)[0])
    return np.pad(x, width, mode=MODES[mode])


@operator("pad_to_size", {"height": REQUIRED, "width": REQUIRED, "position": "center", "value": 0.0})
def pad_to_size(x, height, width, position, value):
    h, w = x.shape[:2]
    if h > height or w > width:
        raise ValueError(f"pad_to_size: {list(x.shape)} is larger than {height} x {width}")
    dh, dw = height - h, width - w
    at = {"center": (dh // 2, dw // 2), "top-left": (0, 0), "bottom-right": (dh, dw)}
    if position not in at:
        raise ValueError(f"pad_to_size: position {position!r} is none of {', '.join(at)}")
    t, l = at[position]  # noqa: E741
    return pad(x, t, dh - t, l, dw - l, value, "constant")


@operator("assert_shape", {"dims": REQUIRED, "exact": True}, ndim=lambda n, p: len(p["dims"]) if p["exact"] else n)
def assert_shape(x, dims, exact):
    """Dimensions that are None may be anything; without `exact` the shape may have more of them."""
    ok = (x.ndim == len(dims) if exact else x.ndim >= len(dims)) and all(d is None or d == s for d, s in zip(dims, x.shape))
    if not ok:
        raise ValueError(f"assert_shape: {list(x.shape)} is not {list(dims)}")
    return x


@operator("extract_shape", gives="vector", dtype=fixed("f64"), ndim=lambda n, p: 1)
def extract_shape(x):
    return np.asarray(x.shape, float)


@operator("coordinate_grid", {"normalized": False}, dtype=fixed("f32"), ndim=lambda n, p: 3)
def coordinate_grid(x, normalized):
    h, w = image(x).shape[:2]
    gx, gy = np.arange(w) + 0.5, np.arange(h) + 0.5
    if normalized:
        gx, gy = gx / w, gy / h
    return np.stack(np.broadcast_arrays(gx[None, :], gy[:, None]), 2).astype(np.float32)
