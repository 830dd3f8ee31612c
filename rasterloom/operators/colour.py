"""Colour spaces. A second or fourth channel is alpha and is left as it is."""

from __future__ import annotations

import numpy as np

from .core import REQUIRED, convert, image, like, operator, top_of

#: Channels of each space.
SPACES = {"rgb": 3, "bgr": 3, "hsv": 3, "lab": 3, "ycbcr": 3, "gray": 1}
LUMA = (0.299, 0.587, 0.114)


def luma(y: np.ndarray) -> np.ndarray:
    """[H, W, 3] to [H, W, 1]; bytes in eight-bit fixed point."""
    if y.dtype == np.uint8:
        v = y.astype(np.uint32)
        return ((77 * v[:, :, 0] + 150 * v[:, :, 1] + 29 * v[:, :, 2] + 128) >> 8).astype(np.uint8)[:, :, None]
    return convert((y[:, :, :3].astype(float) @ np.asarray(LUMA))[:, :, None], y.dtype)


@operator("grayscale", {"keepdims": True}, ndim=lambda n, p: 3 if p["keepdims"] else 2, fixed=("keepdims",))
def grayscale(x, keepdims):
    y = image(x)
    out = y[:, :, :1] if y.shape[2] < 3 else luma(y)
    return out if keepdims else out[:, :, 0]


def _to_rgb(v: np.ndarray, space: str, full: float, centre: float, turn: float) -> np.ndarray:
    """Channels in 0 to 1."""
    if space in ("rgb", "bgr"):
        return (v if space == "rgb" else v[:, :, ::-1]) / full
    if space == "gray":
        return np.repeat(v / full, 3, 2)
    if space == "hsv":
        hue, s, val = v[:, :, 0] * 6 / turn, v[:, :, 1] / full, v[:, :, 2] / full
        k = (np.asarray([5.0, 3.0, 1.0]) + hue[:, :, None]) % 6
        return val[:, :, None] * (1 - s[:, :, None] * np.clip(np.minimum(k, 4 - k), 0, 1))
    if space == "ycbcr":
        y, cb, cr = v[:, :, 0] / full, (v[:, :, 1] - centre) / full, (v[:, :, 2] - centre) / full
        return np.clip(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), 2), 0, 1)
    fy = (v[:, :, 0] + 16) / 116
    f = np.stack((fy + v[:, :, 1] / 500, fy, fy - v[:, :, 2] / 200), 2)
    lin = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * WHITE @ np.linalg.inv(XYZ).T
    return np.clip(np.where(lin <= 0.0031308, 12.92 * lin, 1.055 * np.maximum(lin, 0) ** (1 / 2.4) - 0.055), 0, 1)


#: The matrix from linear sRGB to XYZ and its white point (D65).
XYZ = np.asarray([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.asarray([0.950456, 1.0, 1.088754])


def _from_rgb(v: np.ndarray, space: str, full: float, centre: float, turn: float) -> np.ndarray:
    if space in ("rgb", "bgr"):
        return (v if space == "rgb" else v[:, :, ::-1]) * full
    grey = (v @ np.asarray(LUMA))[:, :, None]
    if space == "gray":
        return grey * full
    if space == "hsv":
        top, low = v.max(2), v.min(2)
        spread = top - low
        safe = np.where(spread == 0, 1, spread)
        r, g, b = v[:, :, 0], v[:, :, 1], v[:, :, 2]
        sixth = np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))
        return np.stack((np.where(spread == 0, 0, sixth) * turn / 6, np.where(top == 0, 0, spread / np.where(top == 0, 1, top)) * full, top * full), 2)
    if space == "ycbcr":
        mix = v @ np.asarray([[-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]]).T
        return np.concatenate((grey * full, centre + mix * full), 2)
    lin = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    t = lin @ XYZ.T / WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack((116 * f[:, :, 1] - 16, 500 * (f[:, :, 0] - f[:, :, 1]), 200 * (f[:, :, 1] - f[:, :, 2])), 2)


def _range(dtype) -> tuple[float, float, float]:
    """Full scale, centre of a chroma channel and a whole turn of hue, as the type holds them."""
    d = np.dtype(dtype)
    if d.kind == "i":
        raise ValueError("cvt_color: signed integers have no colour range")
    full = top_of(d)
    if d.kind == "f":
        return full, 0.5, 360.0
    return full, (full + 1) / 2, 180.0 if d == np.uint8 else full + 1


@operator("cvt_color", {"from_space": REQUIRED, "to_space": REQUIRED}, dtype=lambda d, p: "f32" if p["to_space"] == "lab" != p["from_space"] else ("u8" if p["from_space"] == "lab" != p["to_space"] and d[0] is None else d[0]), ndim=lambda n, p: 3, fixed=("from_space", "to_space"))
def cvt_color(x, from_space, to_space):
    for s in (from_space, to_space):
        if s not in SPACES:
            raise ValueError(f"cvt_color: space {s!r} is none of {', '.join(SPACES)}")
    y = image(x)
    alpha = y[:, :, -1:] if y.shape[2] in (2, 4) else None
    v = y[:, :, :-1] if alpha is not None else y
    if v.shape[2] != SPACES[from_space]:
        raise ValueError(f"cvt_color: {from_space} has {SPACES[from_space]} channels, not {v.shape[2]}")
    if from_space == to_space:
        return y
    kind = np.dtype("f4") if to_space == "lab" else v.dtype
    if {from_space, to_space} == {"rgb", "bgr"}:
        out = v[:, :, ::-1]
    elif from_space in ("rgb", "bgr") and to_space == "gray":
        out = luma(v if from_space == "rgb" else v[:, :, ::-1])
    elif from_space == "gray" and to_space in ("rgb", "bgr"):
        out = np.repeat(v, 3, 2)
    else:
        rgb = _to_rgb(v.astype(float), from_space, *_range(v.dtype))
        full, centre, turn = _range(kind)
        out = convert(_from_rgb(rgb, to_space, full, centre, turn), kind)
        if to_space == "hsv" and kind.kind != "f":
            out[:, :, 0] = np.where(out[:, :, 0] >= turn, 0, out[:, :, 0])
    return out if alpha is None else np.concatenate((out, convert(alpha, out.dtype)), 2)


@operator("equalize_histogram", dtype=lambda d, p: "u8")
def equalize_histogram(x):
    y = convert(image(x), np.uint8)
    out = np.empty_like(y)
    for c in range(y.shape[2]):
        seen = np.cumsum(np.bincount(y[:, :, c].ravel(), minlength=256))
        low = seen[seen > 0][0] if seen[-1] else 0
        table = convert((seen - float(low)) / max(1.0, float(seen[-1] - low)) * 255, np.uint8)
        out[:, :, c] = table[y[:, :, c]]
    return like(out, x)
