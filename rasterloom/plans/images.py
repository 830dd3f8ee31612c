"""Queries of the pipeline operators over vectors read as small images, and their DuckDB SQL.

A vector of 64 numbers is an 8 x 8 image x; u is the same in bytes, 256 x + 128; c is a 4 x 4 image of three channels in
0 to 1 from its first 48 numbers. Results are long: one row for an element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Lazy, Pipeline, cv, this

START = Pipeline().source("list", dtype="f64")


def plain(p: Pipeline = START) -> Lazy:
    return cv("x").pipe(p.reshape(shape=[8, 8]))


def byte() -> Lazy:
    return plain().scale(factor=256.0).add_constant(value=128.0).cast(dtype="u8")


def colour() -> Lazy:
    return cv(F.slice("x", 1, 48)).pipe(START.reshape(shape=[4, 4, 3])).scale(factor=2.0).add_constant(value=0.5).clamp(min=0.0, max=1.0)


_X = "SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings"
_BASE = f"""SELECT *, list_transform(x, lambda e: CAST(least(greatest(round(e * 256.0 + 128.0), 0), 255) AS BIGINT)) AS u,
  list_transform(x[1:48], lambda e: least(greatest(e * 2.0 + 0.5, 0.0), 1.0)) AS c FROM ({_X})"""


def U(r, c, x="u") -> str:  # noqa: N802
    """Element (r, c), edges replicated."""
    return f"{x}[least(greatest({r}, 0), 7) * 8 + least(greatest({c}, 0), 7) + 1]"


R, C = "(pos // 8)", "(pos % 8)"
HERE = "u[pos + 1]"
FLIP = U(R, f"7 - {C}")


def around(cells, x="u") -> str:
    return "[" + ", ".join(U(f"{R} + ({i})", f"{C} + ({j})", x) for i, j in cells) + "]"


SQUARE = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
DISK = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4]


def _dot(kernel, x="u") -> str:
    return " + ".join(f"{k} * {U(f'{R} + ({i})', f'{C} + ({j})', x)}" for (i, j), k in zip(SQUARE, kernel, strict=True) if k)


def px(k: int | str) -> str:
    """Channel k of pixel pos of c."""
    return f"c[pos * 3 + {k} + 1]"


def ch(k) -> str:
    """Channel k of the pixel that element pos of c belongs to."""
    return f"c[(pos // 3) * 3 + {k} + 1]"


def fold(i: str, n: int, mode: str) -> str:
    """Place i of an axis of n as reflect or symmetric padding reads it (one turn each way)."""
    far = f"{2 * (n - 1)} - ({i})" if mode == "reflect" else f"{2 * n - 1} - ({i})"
    near = f"-({i})" if mode == "reflect" else f"-1 - ({i})"
    return f"(CASE WHEN {i} < 0 THEN {near} WHEN {i} >= {n} THEN {far} ELSE {i} END)"


_LUMA = f"(0.299 * {ch(0)} + 0.587 * {ch(1)} + 0.114 * {ch(2)})"
_TOP, _LOW = f"greatest({ch(0)}, {ch(1)}, {ch(2)})", f"least({ch(0)}, {ch(1)}, {ch(2)})"
_HUE = f"(CASE WHEN {_TOP} = {_LOW} THEN 0 WHEN {_TOP} = {ch(0)} THEN 60 * ({ch(1)} - {ch(2)}) / ({_TOP} - {_LOW}) + CASE WHEN {ch(1)} < {ch(2)} THEN 360 ELSE 0 END WHEN {_TOP} = {ch(1)} THEN 60 * ({ch(2)} - {ch(0)}) / ({_TOP} - {_LOW}) + 120 ELSE 60 * ({ch(0)} - {ch(1)}) / ({_TOP} - {_LOW}) + 240 END)"
_SHIFT = lambda r, c: f"(CASE WHEN ({r}) BETWEEN 0 AND 7 AND ({c}) BETWEEN 0 AND 7 THEN {U(r, c, 'x')} ELSE 9.0 END)"
_COS, _SIN = f"{math.cos(math.radians(30))!r}", f"{math.sin(math.radians(30))!r}"
#: Source place of an output pixel under a turn by 30 degrees about (3.5, 3.5).
_TX, _TY = f"(3.5 + {_COS} * ({C} - 3.5) + {_SIN} * ({R} - 3.5))", f"(3.5 - {_SIN} * ({C} - 3.5) + {_COS} * ({R} - 3.5))"
_BILINEAR = " + ".join(f"(CASE WHEN floor({_TY}) + {i} BETWEEN 0 AND 7 AND floor({_TX}) + {j} BETWEEN 0 AND 7 THEN x[CAST((floor({_TY}) + {i}) * 8 + floor({_TX}) + {j} AS INTEGER) + 1] ELSE 0.0 END) * {'(' + _TX + ' - floor(' + _TX + '))' if j else '(1 - ' + _TX + ' + floor(' + _TX + '))'} * {'(' + _TY + ' - floor(' + _TY + '))' if i else '(1 - ' + _TY + ' + floor(' + _TY + '))'}" for i in (0, 1) for j in (0, 1))
_LINE = lambda k: f"[{', '.join(f'u[{k(i)} + 1]' for i in range(8))}]"
_ROW, _COL = _LINE(lambda i: f"pos * 8 + {i}"), _LINE(lambda i: f"{8 * i} + pos")
_ON = "list_filter(range(0, 64), lambda k: u[k + 1] > 128)"
_MASKED = "list_transform(list_filter(range(0, 64), lambda k: u[(k // 8) * 8 + 7 - k % 8 + 1] > 128), lambda k: u[k + 1])"
_NEAR = f"list_min(list_transform(list_filter(range(0, 64), lambda k: u[k + 1] <= 128), lambda k: (k // 8 - {R}) * (k // 8 - {R}) + (k % 8 - {C}) * (k % 8 - {C})))"
_FAR = f"list_min(list_transform(list_filter(range(0, 64), lambda k: u[k + 1] > 128), lambda k: (k // 8 - {R}) * (k // 8 - {R}) + (k % 8 - {C}) * (k % 8 - {C})))"
_BIN = f"least({HERE} // 32, 7)"

#: name -> (result from nothing, elements, DuckDB expression over x, u, c and pos)
ELEMENTS: dict[str, tuple[Callable[[], Lazy], int, str]] = {
    "u8_invert": (lambda: byte().invert(), 64, f"255 - {HERE}"),
    "u8_threshold": (lambda: byte().threshold(value=128.0), 64, f"CASE WHEN {HERE} > 128 THEN 255 ELSE 0 END"),
    "u8_gamma": (lambda: byte().adjust_gamma(gamma=2.0), 64, f"round(pow({HERE} / 255.0, 2.0) * 255.0)"),
    "u8_scale_promotes": (lambda: byte().scale(factor=1.5), 64, f"{HERE} * 1.5"),
    "u8_scale_keeps_dtype": (lambda: byte().scale(factor=1.5, preserve_dtype=True), 64, f"least(round({HERE} * 1.5), 255)"),
    "u8_cast_i8_wraps": (lambda: byte().cast(dtype="i8"), 64, f"(({HERE} + 128) % 256) - 128"),
    "f64_cast_i8_saturates": (lambda: plain().scale(factor=1000.0).cast(dtype="i8"), 64, "least(greatest(round(x[pos + 1] * 1000.0), -128), 127)"),
    "u8_normalize_minmax": (lambda: byte().normalize(), 64, f"CAST(CASE WHEN list_max(u) = list_min(u) THEN 0 ELSE ({HERE} - list_min(u)) / CAST(list_max(u) - list_min(u) AS DOUBLE) END AS FLOAT)"),
    "u8_normalize_range": (lambda: byte().normalize_range(low=64.0, high=192.0), 64, f"CAST(least(greatest(({HERE} - 64.0) / 128.0, 0.0), 1.0) AS FLOAT)"),
    "normalize_percentile": (lambda: plain().normalize_percentile(low=25.0, high=75.0), 64, "CAST(least(greatest((x[pos + 1] - list_aggregate(x, 'quantile_cont', 0.25)) / (list_aggregate(x, 'quantile_cont', 0.75) - list_aggregate(x, 'quantile_cont', 0.25)), 0.0), 1.0) AS FLOAT)"),
    "normalize_preset": (lambda: colour().normalize_preset(mean=[0.5, 0.25, 0.125], std=[0.5, 0.25, 2.0]), 48, "CAST((c[pos + 1] - [0.5, 0.25, 0.125][pos % 3 + 1]) / [0.5, 0.25, 2.0][pos % 3 + 1] AS FLOAT)"),
    "apply_lut": (lambda: byte().apply_lut(table=[(7 * i + 3) % 256 for i in range(256)]), 64, f"(7 * {HERE} + 3) % 256"),
    "apply_lut_palette": (lambda: byte().apply_lut(table=[[i, 255 - i, i // 2] for i in range(256)]), 192, "[u[pos // 3 + 1], 255 - u[pos // 3 + 1], u[pos // 3 + 1] // 2][pos % 3 + 1]"),
    "u8_add_saturates": (lambda: (lambda a: a.add(a.flip_h()))(byte()), 64, f"least({HERE} + {FLIP}, 255)"),
    "u8_subtract_saturates": (lambda: (lambda a: a.subtract(a.flip_h()))(byte()), 64, f"greatest({HERE} - {FLIP}, 0)"),
    "u8_multiply_saturates": (lambda: (lambda a: a.multiply(a.flip_h()))(byte()), 64, f"least({HERE} * {FLIP}, 255)"),
    "u8_blend": (lambda: (lambda a: a.blend(a.flip_h()))(byte()), 64, f"round({HERE} * {FLIP} / 255.0)"),
    "u8_maximum": (lambda: (lambda a: a.maximum(a.flip_v()))(byte()), 64, f"greatest({HERE}, {U(f'7 - {R}', C)})"),
    "u8_minimum": (lambda: (lambda a: a.minimum(a.flip_v()))(byte()), 64, f"least({HERE}, {U(f'7 - {R}', C)})"),
    "bitwise_and": (lambda: (lambda a: a.bitwise_and(a.flip_h()))(byte()), 64, f"{HERE} & {FLIP}"),
    "bitwise_or": (lambda: (lambda a: a.bitwise_or(a.flip_h()))(byte()), 64, f"{HERE} | {FLIP}"),
    "bitwise_xor": (lambda: (lambda a: a.bitwise_xor(a.flip_h()))(byte()), 64, f"xor({HERE}, {FLIP})"),
    "u8_divide": (lambda: (lambda a: a.divide(a.flip_h().add_constant(value=1.0).cast(dtype="u16").clamp(min=1.0, max=999.0)))(byte()), 64, f"CAST({HERE} AS FLOAT) / CAST({FLIP} + 1 AS FLOAT)"),
    "apply_mask": (lambda: (lambda a: a.apply_mask(a.flip_h().threshold(value=128.0)))(byte()), 64, f"CASE WHEN {FLIP} > 128 THEN {HERE} ELSE 0 END"),
    "apply_mask_inverted": (lambda: (lambda a: a.apply_mask(a.flip_h().threshold(value=128.0), invert=True))(byte()), 64, f"CASE WHEN {FLIP} > 128 THEN 0 ELSE {HERE} END"),
    "apply_mask_weighs": (lambda: (lambda a: a.apply_mask(a.flip_h()))(plain()), 64, f"x[pos + 1] * {U(R, f'7 - {C}', 'x')}"),
    "channel_merge": (lambda: (lambda a: a.channel_merge([a.flip_h(), a.invert()]))(byte()), 192, f"[u[pos // 3 + 1], {U('(pos // 24)', '7 - (pos // 3) % 8')}, 255 - u[pos // 3 + 1]][pos % 3 + 1]"),
    "crop_rows": (lambda: byte().crop(top=1, left=2, height=4, width=5), 20, U("1 + pos // 5", "2 + pos % 5")),
    "crop_of_this": (lambda: byte().crop(top=this.height // 4, left=this.width // 2, height=this.height - 4, width=this.width // 2), 16, U("2 + pos // 4", "4 + pos % 4")),
    "crop_clip": (lambda: byte().crop_clip(top=-2, left=5, height=6, width=9), 12, U("pos // 3", "5 + pos % 3")),
    "crop_pad": (lambda: byte().crop_pad(top=-1, left=6, height=4, width=4, value=9.0), 16, f"CASE WHEN pos // 4 >= 1 AND pos % 4 < 2 THEN {U('pos // 4 - 1', '6 + pos % 4')} ELSE 9 END"),
    "crop_box": (lambda: byte().crop_box(F.struct(F.lit(2.4).alias("x"), F.lit(1.0).alias("y"), F.lit(2.5).alias("width"), F.lit(3.9).alias("height"))), 12, U("1 + pos // 3", "2 + pos % 3")),
    "transpose_axes": (lambda: byte().transpose(axes=[1, 0]), 64, U(C, R)),
    "flip_axes": (lambda: byte().flip(axes=[0, 1]), 64, "u[64 - pos]"),
    "channel_select": (lambda: colour().channel_select(index=1), 16, px(1)),
    "channel_swap": (lambda: colour().channel_swap(order=[2, 0, 1]), 48, f"[{ch(2)}, {ch(0)}, {ch(1)}][pos % 3 + 1]"),
    "pad_reflect": (lambda: byte().pad(top=2, bottom=1, left=3, right=2, mode="reflect"), 143, U(fold("(pos // 13 - 2)", 8, "reflect"), fold("(pos % 13 - 3)", 8, "reflect"))),
    "pad_symmetric": (lambda: byte().pad(top=2, bottom=1, left=3, right=2, mode="symmetric"), 143, U(fold("(pos // 13 - 2)", 8, "symmetric"), fold("(pos % 13 - 3)", 8, "symmetric"))),
    "pad_to_size": (lambda: byte().pad_to_size(height=11, width=10, value=7.0), 110, f"CASE WHEN pos // 10 BETWEEN 1 AND 8 AND pos % 10 BETWEEN 1 AND 8 THEN {U('pos // 10 - 1', 'pos % 10 - 1')} ELSE 7 END"),
    "pad_to_size_bottom_right": (lambda: byte().pad_to_size(height=9, width=10, position="bottom-right"), 90, f"CASE WHEN pos // 10 >= 1 AND pos % 10 >= 2 THEN {U('pos // 10 - 1', 'pos % 10 - 2')} ELSE 0 END"),
    "rotate_quarter": (lambda: byte().rotate(angle=90.0), 64, U(f"7 - {C}", R)),
    "rotate_half": (lambda: byte().rotate(angle=180.0), 64, "u[64 - pos]"),
    "rotate_three_quarters": (lambda: byte().rotate(angle=270.0), 64, U(C, f"7 - {R}")),
    "rotate_bilinear": (lambda: plain().rotate(angle=30.0), 64, _BILINEAR),
    "rotate_and_scale": (lambda: plain().rotate_and_scale(angle=30.0, center=[3.5, 3.5], output_size=[8, 8]), 64, _BILINEAR),
    "warp_shift": (lambda: plain().warp_affine(matrix=[1.0, 0.0, 2.0, 0.0, 1.0, -1.0], output_size=[8, 8], interpolation="nearest", border_value=9.0), 64, _SHIFT(f"{R} + 1", f"{C} - 2")),
    "warp_half_pixel": (lambda: plain().warp_affine(matrix=[1.0, 0.0, 0.5, 0.0, 1.0, 0.0], output_size=[8, 8], border_value=9.0), 64, f"0.5 * {_SHIFT(R, f'{C} - 1')} + 0.5 * {_SHIFT(R, C)}"),
    "shear": (lambda: plain().shear(sx=1.0, sy=0.0, output_size=[8, 8], border_value=9.0), 64, _SHIFT(R, f"{C} - {R}")),
    "grayscale": (lambda: colour().scale(factor=255.0).cast(dtype="u8").grayscale(), 16, "(77 * CAST(round(c[pos * 3 + 1] * 255.0) AS BIGINT) + 150 * CAST(round(c[pos * 3 + 2] * 255.0) AS BIGINT) + 29 * CAST(round(c[pos * 3 + 3] * 255.0) AS BIGINT) + 128) // 256"),
    "grayscale_float": (lambda: colour().grayscale(), 16, f"0.299 * {px(0)} + 0.587 * {px(1)} + 0.114 * {px(2)}"),
    "to_bgr": (lambda: colour().to_bgr(), 48, f"[{ch(2)}, {ch(1)}, {ch(0)}][pos % 3 + 1]"),
    "to_ycbcr": (lambda: colour().to_ycbcr(), 48, f"[{_LUMA}, 0.5 - 0.168736 * {ch(0)} - 0.331264 * {ch(1)} + 0.5 * {ch(2)}, 0.5 + 0.5 * {ch(0)} - 0.418688 * {ch(1)} - 0.081312 * {ch(2)}][pos % 3 + 1]"),
    "to_hsv": (lambda: colour().to_hsv(), 48, f"[{_HUE}, CASE WHEN {_TOP} = 0 THEN 0 ELSE ({_TOP} - {_LOW}) / {_TOP} END, {_TOP}][pos % 3 + 1]"),
    "equalize_histogram": (lambda: byte().equalize_histogram(), 64, f"round((len(list_filter(u, lambda z: z <= {HERE})) - len(list_filter(u, lambda z: z = list_min(u)))) / greatest(64.0 - len(list_filter(u, lambda z: z = list_min(u))), 1.0) * 255.0)"),
    "convolve2d_sobel": (lambda: byte().sobel(), 64, _dot([-1, 0, 1, -2, 0, 2, -1, 0, 1])),
    "laplacian": (lambda: byte().laplacian(), 64, _dot([0, 1, 0, 1, -4, 1, 0, 1, 0])),
    "sharpen": (lambda: byte().sharpen(), 64, _dot([0, -1, 0, -1, 5, -1, 0, -1, 0])),
    "convolve2d_zero_border": (lambda: byte().convolve2d(kernel=[[0, 0, 0], [1, 0, 0], [0, 0, 0]], border="zero"), 64, f"CASE WHEN {C} = 0 THEN 0 ELSE {U(R, f'{C} - 1')} END"),
    "convolve2d_normalized": (lambda: plain().convolve2d(kernel=[[1, 1, 1], [1, 8, 1], [1, 1, 1]], normalize=True), 64, f"({_dot([1, 1, 1, 1, 8, 1, 1, 1, 1], 'x')}) / 16.0"),
    "rank_filter": (lambda: byte().rank_filter(height=3, width=3, q=25.0), 64, f"list_sort({around(SQUARE)})[3]"),
    "median": (lambda: byte().median_filter(), 64, f"list_sort({around(SQUARE)})[5]"),
    "erode_disk": (lambda: byte().erode(ksize=5, footprint="disk"), 64, f"list_min({around(DISK)})"),
    "dilate_twice": (lambda: byte().dilate(ksize=3, iterations=2), 64, f"list_max({around([(i, j) for i in range(-2, 3) for j in range(-2, 3)])})"),
    "u8_gradient": (lambda: byte().morphology_gradient(), 64, f"list_max({around(SQUARE)}) - list_min({around(SQUARE)})"),
    "distance_transform": (lambda: byte().threshold(value=128.0).distance_transform(), 64, f"CASE WHEN {HERE} <= 128 THEN 0 ELSE CAST(sqrt(coalesce({_NEAR}, 'infinity'::DOUBLE)) AS FLOAT) END"),
    "distance_signed": (lambda: byte().threshold(value=128.0).distance_transform(signed=True), 64, f"CASE WHEN {HERE} > 128 THEN CAST(0.5 - sqrt(coalesce({_NEAR}, 'infinity'::DOUBLE)) AS FLOAT) ELSE CAST(sqrt(coalesce({_FAR}, 'infinity'::DOUBLE)) - 0.5 AS FLOAT) END"),
    "coordinate_grid": (lambda: byte().coordinate_grid(), 128, "CASE WHEN pos % 2 = 0 THEN (pos // 2) % 8 + 0.5 ELSE (pos // 2) // 8 + 0.5 END"),
    "reduce_max_rows": (lambda: byte().reduce_max(axis=1), 8, f"list_max({_ROW})"),
    "reduce_min_columns": (lambda: byte().reduce_min(axis=0), 8, f"list_min({_COL})"),
    "reduce_mean_columns": (lambda: byte().reduce_mean(axis=0), 8, f"list_avg({_COL})"),
    "reduce_std_rows": (lambda: byte().reduce_std(axis=1, ddof=1), 8, f"list_stddev_samp({_ROW})"),
    "reduce_argmax_rows": (lambda: byte().reduce_argmax(axis=1), 8, f"list_position({_ROW}, list_max({_ROW})) - 1"),
    "reduce_argmin_columns": (lambda: byte().reduce_argmin(axis=0), 8, f"list_position({_COL}, list_min({_COL})) - 1"),
    "reduce_by_name": (lambda: byte().reduce(reduction="median", axis=0), 8, f"list_median({_COL})"),
    "reduce_masked_columns": (lambda: (lambda a: a.reduce_masked(a.flip_h().threshold(value=128.0), reduction="sum", axis=0))(byte()), 8, f"list_sum([{', '.join(f'CASE WHEN u[{8 * i} + 7 - pos + 1] > 128 THEN u[{8 * i} + pos + 1] ELSE 0 END' for i in range(8))}])"),
    "block_reduce_max": (lambda: byte().block_reduce(height=3, width=4, reduction="max"), 6, "list_max(list_transform(list_filter(range(0, 64), lambda k: k // 24 = pos // 2 AND (k % 8) // 4 = pos % 2), lambda k: u[k + 1]))"),
    "block_reduce_mean": (lambda: byte().block_reduce(height=3, width=3), 9, "list_avg(list_transform(list_filter(range(0, 64), lambda k: k // 24 = pos // 3 AND (k % 8) // 3 = pos % 3), lambda k: u[k + 1]))"),
    "histogram_counts": (lambda: byte().histogram(bins=8, range=[0.0, 256.0], output="counts"), 8, "len(list_filter(u, lambda z: z // 32 = pos))"),
    "histogram_normalized": (lambda: byte().histogram(bins=[0.0, 32.0, 128.0, float("inf")], output="normalized"), 3, "len(list_filter(u, lambda z: CASE WHEN z < 32 THEN 0 WHEN z < 128 THEN 1 ELSE 2 END = pos)) / 64.0"),
    "histogram_quantized": (lambda: byte().histogram(bins=8, range=[0.0, 255.0], output="quantized"), 64, f"least(CAST(floor({HERE} / 31.875) AS INTEGER), 7)"),
    "histogram_edges": (lambda: byte().histogram(bins=4, output="edges"), 5, "list_min(u) + pos * CASE WHEN list_max(u) = list_min(u) THEN 0.25 ELSE (list_max(u) - list_min(u)) / 4.0 END - CASE WHEN list_max(u) = list_min(u) THEN 0.5 ELSE 0 END"),
    "average_hash": (lambda: byte().perceptual_hash(algorithm="average"), 8, f"list_sum(list_transform(range(0, 8), lambda b: CASE WHEN u[pos * 8 + b + 1] >= list_avg(u) THEN 1 << (7 - b) ELSE 0 END))"),
    "extract_shape": (lambda: colour().extract_shape(), 3, "[4, 4, 3][pos + 1]"),
    "squeeze_expand": (lambda: byte().expand_dims(axis=2).squeeze(axis=2), 64, HERE),
    "assert_shape": (lambda: byte().assert_shape(dims=[8, None]), 64, HERE),
    "adjust_brightness_keeps_dtype": (lambda: byte().adjust_brightness(factor=1.25, preserve_dtype=True), 64, f"least(round({HERE} * 1.25), 255)"),
    "sharpen_by_row": (lambda: byte().sharpen(strength=F.col("vec_id").cast("double") % 3), 64, f"{HERE} + (vec_id % 3) * (4 * {HERE} - ({_dot([0, 1, 0, 1, 0, 1, 0, 1, 0])}))"),
    "resize_scale_both": (lambda: byte().resize_scale(0.5, filter="nearest"), 16, U("2 * (pos // 4) + 1", "2 * (pos % 4) + 1")),
    "background_divide": (lambda: byte().background_divide(sigma=0.0, epsilon=1.0), 64, f"CAST({HERE} AS FLOAT) / CAST({HERE} + 1 AS FLOAT)"),
    "adjust_brightness": (lambda: byte().adjust_brightness(factor=1.25), 64, f"least({HERE} * 1.25, 255)"),
    "u8_adjust_contrast": (lambda: plain().adjust_contrast(factor=1.5), 64, "(x[pos + 1] - list_sum(x) / 64) * 1.5 + list_sum(x) / 64"),
    "morphology_open": (lambda: byte().morphology_open(), 64, "list_max([" + ", ".join("list_min([" + ", ".join(U(f"least(greatest({R} + ({i}), 0), 7) + ({k})", f"least(greatest({C} + ({j}), 0), 7) + ({m})") for k, m in SQUARE) + "])" for i, j in SQUARE) + "])"),
    "morphology_close": (lambda: byte().morphology_close(), 64, "list_min([" + ", ".join("list_max([" + ", ".join(U(f"least(greatest({R} + ({i}), 0), 7) + ({k})", f"least(greatest({C} + ({j}), 0), 7) + ({m})") for k, m in SQUARE) + "])" for i, j in SQUARE) + "])"),
}
#: name -> (result, DuckDB expression): one number for a row.
SCALARS: dict[str, tuple[Callable[[], Column], str]] = {
    "u8_reduce_sum": (lambda: byte().reduce_sum().sink("native"), "list_sum(u)"),
    "u8_reduce_max": (lambda: byte().reduce_max().sink("native"), "list_max(u)"),
    "u8_reduce_std": (lambda: byte().reduce_std().sink("native"), "list_stddev_pop(u)"),
    "reduce_popcount": (lambda: byte().reduce_popcount().sink("native"), "list_sum(list_transform(u, lambda z: bit_count(z)))"),
    "reduce_percentile_bytes": (lambda: byte().reduce_percentile(q=90.0).sink("native"), "list_aggregate(u, 'quantile_cont', 0.9)"),
    "reduce_p95": (lambda: byte().reduce(reduction="p95").sink("native"), "list_aggregate(u, 'quantile_cont', 0.95)"),
    "reduce_masked": (lambda: (lambda a: a.reduce_masked(a.flip_h().threshold(value=128.0), reduction="mean"))(byte()).sink("native"), f"coalesce(list_avg({_MASKED}), 'nan'::DOUBLE)"),
    "masked_select_sum": (lambda: (lambda a: a.masked_select(a.flip_h().threshold(value=128.0)).reduce_sum())(byte()).sink("native"), f"coalesce(list_sum({_MASKED}), 0)"),
    "contour_pixels": (lambda: byte().threshold(value=128.0).extract_contours(mode="all", method="none").contour_area(signed=True).reduce_sum().sink("native"), f"len({_ON})"),
    "rasterize_extracted": (lambda: (lambda m: m.extract_contours(mode="external").rasterize(shape=m).maximum(m.reshape(shape=[8, 8, 1])).subtract(m.extract_contours(mode="external").rasterize(shape=m)).reduce_sum())(byte().threshold(value=128.0)).sink("native"), "0"),
    "label_reduce_max": (lambda: byte().label_reduce(F.array(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((2, 1), (6, 1), (6, 5), (2, 5))]))).reduce_sum().sink("native"), "list_max(list_transform(list_filter(range(0, 64), lambda k: k // 8 BETWEEN 1 AND 4 AND k % 8 BETWEEN 2 AND 5), lambda k: u[k + 1]))"),
    "header_width": (lambda: cv(byte().resize(height=5, width=6, filter="nearest").sink("png")).width(), "6"),
    "blob_round_trip": (lambda: cv(byte().sink("blob")).pipe(Pipeline().source("blob")).reduce_sum().sink("native"), "list_sum(u)"),
    "png_round_trip": (lambda: cv(byte().sink("png")).pipe(Pipeline().source("image_bytes")).reduce_sum().sink("native"), "list_sum(u)"),
    "tiff_round_trip": (lambda: cv(byte().sink("tiff")).pipe(Pipeline().source("auto")).reduce_max().sink("native"), "list_max(u)"),
    "tensor_round_trip": (lambda: cv(byte().transpose(axes=[1, 0]).sink("tensor")).pipe(Pipeline().source("tensor")).reduce_argmax(axis=0).reduce_sum().sink("native"), "list_sum(list_transform(range(0, 8), lambda r: list_position(u[r * 8 + 1:r * 8 + 8], list_max(u[r * 8 + 1:r * 8 + 8])) - 1))"),
    "raw_source": (lambda: cv(F.unhex(F.lit("01020304"))).pipe(Pipeline().source("raw", dtype="u16")).reduce_sum().sink("native"), "513 + 1027"),
    "array_source": (lambda: cv(F.array(F.slice("x", 1, 4), F.slice("x", 5, 4))).pipe(Pipeline().source("array", dtype="f64", shape=[2, 4])).reduce_max(axis=0).reduce_sum().sink("native"), "greatest(x[1], x[5]) + greatest(x[2], x[6]) + greatest(x[3], x[7]) + greatest(x[4], x[8])"),
    "jpeg_size": (lambda: cv(byte().resize(height=16, width=24, filter="nearest").sink("jpeg")).image_info()["width"], "24"),
    "row_parameter": (lambda: byte().threshold(value=F.col("vec_id").cast("double") % 256).reduce_sum().sink("native"), "255 * len(list_filter(u, lambda z: z > vec_id % 256))"),
    "on_error_null": (lambda: F.coalesce(_quiet().sink("native").cast("double"), F.lit(-1.0)), "CASE WHEN vec_id % 2 = 0 THEN -1 ELSE list_max(u[1:16]) END"),
}


def _quiet() -> Lazy:
    """Rows whose window lies outside the image are null."""
    p = START.reshape(shape=[8, 8]).scale(factor=256.0).add_constant(value=128.0).cast(dtype="u8").crop(height=F.when(F.col("vec_id") % 2 == 0, 99).otherwise(2)).reduce_max().on_error("null")
    return cv("x").pipe(p)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _elements(make, n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = images(spark, sf_dir).select("vec_id", F.posexplode(make().reshape(shape=[n]).sink("list")).alias("pos", "value"))
        return out.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))

    return run


def _vector(make):
    """A result that is a vector already."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = images(spark, sf_dir).select("vec_id", F.posexplode(make().sink("native")).alias("pos", "value"))
        return out.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))

    return run


def _scalars(make):
    return lambda spark, sf_dir: images(spark, sf_dir).select("vec_id", F.round(make().cast("double"), 6).alias("value"))


VECTORS = {"histogram_counts", "histogram_normalized", "histogram_edges", "average_hash", "extract_shape"}

# separable filters: weights by formula, both axes

_FILTER = {
    "bilinear": ("greatest(0, 1 - abs(t))", 1.0),
    "catmullrom": ("CASE WHEN abs(t) < 1 THEN 1.5 * pow(abs(t), 3) - 2.5 * t * t + 1 WHEN abs(t) < 2 THEN -0.5 * pow(abs(t), 3) + 2.5 * t * t - 4 * abs(t) + 2 ELSE 0 END", 2.0),
    "gaussian": ("exp(-2 * t * t)", 3.0),
    "lanczos3": ("CASE WHEN t = 0 THEN 1 ELSE 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * pi() * t * t) END", 3.0),
}


def _axis(name: str, dst: int, src: int = 8) -> str:
    """(i, r, w): weights of source place r for output place i."""
    if name == "area":
        cover = f"greatest(least((i + 1) * {src / dst!r}, r + 1) - greatest(i * {src / dst!r}, r), 0)"
        return f"SELECT i, r, {cover} / sum({cover}) OVER (PARTITION BY i) AS w FROM range({dst}) a(i), range({src}) b(r)"
    f, reach = _FILTER[name]
    grow = max(src / dst, 1.0)
    t = f"((r + 0.5 - (i + 0.5) * {src / dst!r}) / {grow!r})"
    return f"SELECT i, r, f / sum(f) OVER (PARTITION BY i) AS w FROM (SELECT i, r, CASE WHEN abs(t) < {reach!r} THEN {f} ELSE 0 END AS f FROM (SELECT i, r, {t} AS t FROM range({dst}) a(i), range({src}) b(r)))"


def _separable(down: str, across: str, width: int) -> str:
    return f"""SELECT vec_id, CAST(p.i * {width} + q.i AS INTEGER) AS pos, round(sum(p.w * q.w * x[p.r * 8 + q.r + 1]), 6) AS value
FROM ({_X}) s, ({down}) p, ({across}) q GROUP BY vec_id, p.i, q.i"""


_BLUR = "SELECT i, r, sum(w) AS w FROM (SELECT i, least(greatest(i + d - 3, 0), 7) AS r, exp(-(d - 3) * (d - 3) / 2.0) / (SELECT sum(exp(-(e - 3) * (e - 3) / 2.0)) FROM range(7) z(e)) AS w FROM range(8) a(i), range(7) b(d)) GROUP BY i, r"
#: name -> (result, elements, SQL)
FILTERED = {
    **{f"resize_{f}": (lambda f=f: plain().resize(height=5, width=12, filter=f), 60, _separable(_axis(f, 5), _axis(f, 12), 12)) for f in (*_FILTER, "area")},
    "resize_scale": (lambda: plain().resize_scale(scale_x=0.5, scale_y=1.5, filter="bilinear"), 48, _separable(_axis("bilinear", 12), _axis("bilinear", 4), 4)),
    "resize_to_height": (lambda: plain().crop(height=8, width=8).resize_to_height(height=4, filter="bilinear"), 16, _separable(_axis("bilinear", 4), _axis("bilinear", 4), 4)),
    "resize_to_width": (lambda: plain().resize_to_width(width=6, filter="lanczos3"), 36, _separable(_axis("lanczos3", 6), _axis("lanczos3", 6), 6)),
    "resize_max": (lambda: plain().resize_max(max_size=5, filter="area"), 25, _separable(_axis("area", 5), _axis("area", 5), 5)),
    "resize_min": (lambda: plain().resize_min(min_size=12, filter="catmullrom"), 144, _separable(_axis("catmullrom", 12), _axis("catmullrom", 12), 12)),
    "resize_like": (lambda: plain().resize_like(byte().crop(height=4, width=7), filter="bilinear"), 28, _separable(_axis("bilinear", 4), _axis("bilinear", 7), 7)),
    "blur": (lambda: plain().blur(sigma=1.0), 64, _separable(_BLUR, _BLUR, 8)),
    "letterbox": (lambda: plain().letterbox(height=4, width=6, filter="bilinear"), 24, f"SELECT v.vec_id, CAST(g.p AS INTEGER) AS pos, coalesce(value, 0.0) AS value FROM embeddings v CROSS JOIN range(24) g(p) LEFT JOIN ({_separable(_axis('bilinear', 4), _axis('bilinear', 4), 4)}) s ON s.vec_id = v.vec_id AND g.p % 6 BETWEEN 1 AND 4 AND s.pos = (g.p // 6) * 4 + g.p % 6 - 1"),
}


def long_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels above 128 of each image, with their places and a second channel."""
    a = byte()
    out = images(spark, sf_dir).select("vec_id", F.inline(a.channel_merge([a.flip_h(), a.threshold(value=128.0)]).sink("long", names=["v", "mirrored"], where=True)))
    return out.select("vec_id", F.col("row").alias("r"), "col", F.col("v").cast("bigint").alias("v"), F.col("mirrored").cast("bigint").alias("mirrored"))


LONG_SQL = f"SELECT vec_id, CAST(pos // 8 AS INTEGER) AS r, CAST(pos % 8 AS INTEGER) AS col, {HERE} AS v, {FLIP} AS mirrored FROM ({_BASE}) s, unnest(range(0, 64)) AS t(pos) WHERE {HERE} > 128"


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several reductions of one image in one pass."""
    s = byte().statistics(include=("mean", "std", "min", "max", "median", "count"))
    return images(spark, sf_dir).select("vec_id", s.alias("s")).select("vec_id", *[F.round(F.col(f"s.{n}"), 6).alias(f"{n}_") for n in ("mean", "std", "min", "max", "median", "count")])


STATISTICS_SQL = f"SELECT vec_id, round(list_avg(u), 6) AS mean_, round(list_stddev_pop(u), 6) AS std_, CAST(list_min(u) AS DOUBLE) AS min_, CAST(list_max(u) AS DOUBLE) AS max_, CAST(list_median(u) AS DOUBLE) AS median_, 64.0::DOUBLE AS count_ FROM ({_BASE})"


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram buckets as rows."""
    b = images(spark, sf_dir).select("vec_id", F.inline(byte().histogram(bins=4, range=[0.0, 256.0]).sink("native")))
    return b.select("vec_id", "lower_edge", "upper_edge", F.col("count").alias("n"), "normalized")


BUCKETS_SQL = f"SELECT vec_id, pos * 64.0::DOUBLE AS lower_edge, (pos + 1) * 64.0::DOUBLE AS upper_edge, CAST(len(list_filter(u, lambda z: z // 64 = pos)) AS BIGINT) AS n, len(list_filter(u, lambda z: z // 64 = pos)) / 64.0::DOUBLE AS normalized FROM ({_BASE}) s, unnest(range(0, 4)) AS t(pos)"

QUERIES = {
    **{n: (_vector(f) if n in VECTORS else _elements(f, k)) for n, (f, k, _) in ELEMENTS.items()},
    **{n: _elements(f, k) for n, (f, k, _) in FILTERED.items()},
    **{n: _scalars(f) for n, (f, _) in SCALARS.items()},
    "long_pixels": long_pixels,
    "statistics": statistics,
    "histogram_buckets": buckets,
}
ORACLE_SQL = {
    **{n: f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST({e} AS DOUBLE), 6) AS value FROM ({_BASE}) s, unnest(range(0, {k})) AS t(pos)" for n, (_, k, e) in ELEMENTS.items()},
    **{n: q for n, (_, _, q) in FILTERED.items()},
    **{n: f"SELECT vec_id, round(CAST({e} AS DOUBLE), 6) AS value FROM ({_BASE})" for n, (_, e) in SCALARS.items()},
    "long_pixels": LONG_SQL,
    "statistics": STATISTICS_SQL,
    "histogram_buckets": BUCKETS_SQL,
}
