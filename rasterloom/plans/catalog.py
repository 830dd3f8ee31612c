"""Registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import layout as L
from ..functions import pixel as P
from . import images, relational, shapes

#: name -> (column expression over x, DuckDB expression over the element v)
ELEMENT = {
    "scale": (lambda x: P.scale(x, 2.5), "v * 2.5"),
    "relu": (P.relu, "greatest(v, 0.0)"),
    "neg": (P.neg, "-v"),
    "abs": (P.absolute, "abs(v)"),
    "square": (P.square, "v * v"),
    "sqrt": (lambda x: P.sqrt(P.absolute(x)), "sqrt(abs(v))"),
    "reciprocal": (P.reciprocal, "1.0 / v"),
    "sign": (P.sign, "CAST(sign(v) AS DOUBLE)"),
    "floor": (lambda x: P.floor(P.scale(x, 16)), "floor(v * 16)"),
    "ceil": (lambda x: P.ceil(P.scale(x, 16)), "ceil(v * 16)"),
    "round": (lambda x: P.round_even(P.scale(x, 16)), "round_even(v * 16, 0)"),
    "trunc": (lambda x: P.trunc(P.scale(x, 16)), "trunc(v * 16)"),
    "clamp": (lambda x: P.clamp(x, -0.1, 0.1), "least(greatest(v, -0.1), 0.1)"),
    "clamp_min": (lambda x: P.clamp_min(x, -0.05), "greatest(v, -0.05)"),
    "clamp_max": (lambda x: P.clamp_max(x, 0.05), "least(v, 0.05)"),
    "add_constant": (lambda x: P.add_constant(x, 1.5), "v + 1.5"),
    "subtract_constant": (lambda x: P.subtract_constant(x, 1.5), "v - 1.5"),
    "threshold": (lambda x: F.transform(P.threshold(x, 0.05), lambda v: v.cast("double")), "CASE WHEN v > 0.05 THEN 255.0 ELSE 0.0 END"),
    "invert": (P.invert, "1.0 - v"),
    "adjust_gamma": (lambda x: P.adjust_gamma(x, 2.0), "pow(least(greatest(v, 0.0), 1.0), 2.0)"),
    "normalize_range": (lambda x: P.normalize_range(x, -0.25, 0.25), "least(greatest((v + 0.25) / 0.5, 0.0), 1.0)"),
    "cast_u8": (lambda x: F.transform(P.cast_u8(P.scale(x, 512)), lambda v: v.cast("double")), "least(greatest(round(v * 512), 0.0), 255.0)"),
    "normalize_minmax": (P.normalize_minmax, "(v - lo) / (hi - lo)"),
    "normalize_zscore": (P.normalize_zscore, "(v - list_avg(x)) / list_stddev_pop(x)"),
    "adjust_contrast": (lambda x: P.adjust_contrast(x, 1.5), "(v - list_sum(x) / len(x)) * 1.5 + list_sum(x) / len(x)"),
}
#: name -> (column expression over x, DuckDB expression over list x)
REDUCE = {
    "reduce_sum": (P.total, "list_sum(x)"),
    "reduce_mean": (P.mean, "list_avg(x)"),
    "reduce_std": (P.std, "list_stddev_pop(x)"),
    "reduce_var": (P.variance, "list_var_pop(x)"),
    "reduce_min": (P.reduce_min, "list_min(x)"),
    "reduce_max": (P.reduce_max, "list_max(x)"),
    "reduce_argmax": (lambda x: P.argmax(x).cast("double"), "CAST(list_position(x, list_max(x)) - 1 AS DOUBLE)"),
    "reduce_argmin": (lambda x: P.argmin(x).cast("double"), "CAST(list_position(x, list_min(x)) - 1 AS DOUBLE)"),
    "reduce_percentile": (lambda x: P.percentile(x, 90.0), "list_aggregate(x, 'quantile_cont', 0.9)"),
}
PAIR = {"add": (P.add, "a + b"), "subtract": (P.subtract, "a - b"), "multiply": (P.multiply, "a * b"), "divide": (P.divide, "a / b"), "maximum": (P.maximum, "greatest(a, b)"), "minimum": (P.minimum, "least(a, b)")}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _element(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(f(F.col("x"))).alias("pos", "value"))
        return out.select("vec_id", "pos", F.round("value", 6).alias("value"))

    return run


def _reduce(f):
    return lambda spark, sf_dir: _vectors(spark, sf_dir).select("vec_id", F.round(f(F.col("x")), 5).alias("value"))


def _pair(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Each vector with itself reversed: row-aligned operands."""
        out = _vectors(spark, sf_dir).select("vec_id", F.posexplode(f(F.col("x"), F.reverse("x"))).alias("pos", "value"))
        return out.select("vec_id", "pos", F.round("value", 5).alias("value"))

    return run


_X = "SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings"
_LONG = f"SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, x, x[pos] AS v, list_min(x) AS lo, list_max(x) AS hi FROM ({_X}) s, unnest(range(1, len(x) + 1)) AS u(pos)"
_PAIRS = f"SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, x[pos] AS a, x[len(x) + 1 - pos] AS b FROM ({_X}) s, unnest(range(1, len(x) + 1)) AS u(pos)"


def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from line items: area, overlap and IoU with a fixed box, and whether its centre lies inside."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    a = G.bbox(F.col("l_quantity"), F.col("l_quantity") / 2, F.lit(10.0), F.lit(8.0))
    b = G.bbox_from_coords(F.lit(20.0), F.lit(10.0), F.lit(40.0), F.lit(30.0))
    return li.select(
        "l_orderkey", "l_linenumber", F.round(G.bbox_area(a), 6).alias("area"), F.round(G.bbox_overlap(a, b), 6).alias("overlap"), F.round(G.bbox_iou(a, b), 6).alias("iou"),
        G.bbox_contains(b, G.bbox_center(a)).alias("inside"), F.round(G.point_distance(G.bbox_center(a), G.bbox_center(b)), 6).alias("distance"),
    )


BOX_SQL = """
SELECT l_orderkey, l_linenumber, 80.0::DOUBLE AS area, round(o, 6) AS overlap, round(CASE WHEN 480.0 - o > 0 THEN o / (480.0 - o) ELSE 0 END, 6) AS iou,
  (x + 5 >= 20 AND x + 5 <= 40 AND y + 4 >= 10 AND y + 4 <= 30) AS inside, round(sqrt(pow(x + 5 - 30, 2.0) + pow(y + 4 - 20, 2.0)), 6) AS distance
FROM (SELECT *, greatest(least(x + 10, 40.0) - greatest(x, 20.0), 0.0) * greatest(least(y + 8, 30.0) - greatest(y, 10.0), 0.0) AS o
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) / 2 AS y FROM lineitem))
"""


def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming distance of each vector's mean-threshold bits to the reversed ones."""
    b = _vectors(spark, sf_dir).select("vec_id", P.bits(F.col("x")).alias("h"))
    return b.select("vec_id", P.hamming_distance(F.col("h"), F.reverse("h")).cast("bigint").alias("distance"))


HASH_SQL = f"""
SELECT vec_id, CAST(sum(CASE WHEN (a > m) <> (b > m) THEN 1 ELSE 0 END) AS BIGINT) AS distance
FROM (SELECT p.*, m FROM ({_PAIRS}) p JOIN (SELECT vec_id, list_sum(x) / len(x) AS m FROM ({_X}) t) q USING (vec_id)) GROUP BY vec_id
"""

def _at(r: str, c: str) -> str:
    """DuckDB: element (r, c) of x as 8 x 8 image, with replicated edges."""
    return f"x[least(greatest({r}, 0), 7) * 8 + least(greatest({c}, 0), 7) + 1]"


_R, _C = "(pos // 8)", "(pos % 8)"
_AROUND = "[" + ", ".join(_at(f"{_R} + ({a})", f"{_C} + ({b})") for a in (-1, 0, 1) for b in (-1, 0, 1)) + "]"
SOBEL_X = [-1.0, 0.0, 1.0, -2.0, 0.0, 2.0, -1.0, 0.0, 1.0]
#: name -> (column expression over x as 8 x 8 image, elements of the result, DuckDB expression over x and pos)
IMAGE = {
    "flip_h": (lambda x: L.flip_h(x, 8, 8), 64, _at(_R, f"7 - {_C}")),
    "flip_v": (lambda x: L.flip_v(x, 8, 8), 64, _at(f"7 - {_R}", _C)),
    "transpose": (lambda x: L.transpose(x, 8, 8), 64, _at(_C, _R)),
    "rotate90": (lambda x: L.rotate90(x, 8, 8), 64, _at(f"7 - {_C}", _R)),
    "crop": (lambda x: L.crop(x, 8, 8, 1, 2, 4, 5), 20, _at("1 + pos // 5", "2 + pos % 5")),
    "pad_constant": (lambda x: L.pad(x, 8, 8, 1, 1, 2, 2, 0.5), 120, f"CASE WHEN pos // 12 BETWEEN 1 AND 8 AND pos % 12 BETWEEN 2 AND 9 THEN {_at('pos // 12 - 1', 'pos % 12 - 2')} ELSE 0.5 END"),
    "pad_edge": (lambda x: L.pad(x, 8, 8, 1, 1, 2, 2, mode="edge"), 120, _at("pos // 12 - 1", "pos % 12 - 2")),
    "resize_nearest": (lambda x: L.resize_nearest(x, 8, 8, 5, 6), 30, _at("((2 * (pos // 6) + 1) * 8) // 10", "((2 * (pos % 6) + 1) * 8) // 12")),
    "erode": (lambda x: L.erode(x, 8, 8), 64, f"list_min({_AROUND})"),
    "dilate": (lambda x: L.dilate(x, 8, 8), 64, f"list_max({_AROUND})"),
    "morphology_gradient": (lambda x: L.morphology_gradient(x, 8, 8), 64, f"list_max({_AROUND}) - list_min({_AROUND})"),
    "median_filter": (lambda x: L.median_filter(x, 8, 8), 64, f"list_median({_AROUND})"),
    "sobel_x": (lambda x: L.convolve2d(x, 8, 8, SOBEL_X), 64, "list_dot_product(" + _AROUND + ", [" + ", ".join(f"{v}::DOUBLE" for v in SOBEL_X) + "])"),
    "block_mean": (lambda x: L.block_mean(x, 8, 8, 4, 2), 8, "list_avg([" + ", ".join(f"x[((pos // 4) * 4 + {a}) * 8 + (pos % 4) * 2 + {b} + 1]" for a in range(4) for b in range(2)) + "])"),
}


def geometry_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, boxes and rings from line items, one row each."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    a, b = G.point(q, d), G.point(t, q)
    box = G.bbox(q - 20, d, t + 10, q)
    clip, turned, wide, xyxy = G.bbox_clip(box, 25.0, 20.0), G.point_rotate(a, 0.5, b), G.bbox_expand(box, 1.5), G.bbox_to_coords(G.bbox_pad(box, 2.0))
    ring = [G.point(F.lit(0.0), F.lit(0.0)), G.point(q, F.lit(0.0)), G.point(q + t, q), G.point(d, q)]
    value = {
        "manhattan": G.point_manhattan_distance(a, b), "angle": G.point_angle_to(a, b), "turned_x": turned["x"], "turned_y": turned["y"], "between_x": G.point_interpolate(a, b, 0.25)["x"],
        "clip_area": G.bbox_area(clip), "clip_x": clip["x"], "wide_x": wide["x"], "wide_area": G.bbox_area(wide), "right": xyxy[2],
        "ring_area": G.ring_signed_area(ring), "ring_length": G.polygon_perimeter(ring), "ring_width": G.ring_bounding_box(ring)["width"], "box_ring_area": G.polygon_area(G.bbox_corners(box)),
    }
    return li.select("l_orderkey", "l_linenumber", *[F.round(v, 5).alias(k) for k, v in value.items()])


GEOMETRY_SQL = """
SELECT l_orderkey, l_linenumber, round(abs(q - t) + abs(d - q), 5) AS manhattan, round(atan2(q - d, t - q), 5) AS angle,
  round(t + (q - t) * cos(0.5) - (d - q) * sin(0.5), 5) AS turned_x, round(q + (q - t) * sin(0.5) + (d - q) * cos(0.5), 5) AS turned_y, round(q + (t - q) * 0.25, 5) AS between_x,
  round(greatest(least(q + t - 10, 25.0) - least(greatest(q - 20, 0.0), 25.0), 0.0) * greatest(least(d + q, 20.0) - least(d, 20.0), 0.0), 5) AS clip_area,
  round(least(greatest(q - 20, 0.0), 25.0), 5) AS clip_x, round(q - 20 - 0.25 * (t + 10), 5) AS wide_x, round(2.25 * (t + 10) * q, 5) AS wide_area, round(q + t - 8, 5) AS "right",
  round((q * q + (q + t) * q - d * q) / 2, 5) AS ring_area, round(q + sqrt(t * t + q * q) + abs(q + t - d) + sqrt(d * d + q * q), 5) AS ring_length,
  round(greatest(q + t, d) - 0.0, 5) AS ring_width, round((t + 10) * q, 5) AS box_ring_area
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) * 100 AS d, CAST(l_tax AS DOUBLE) * 100 AS t FROM lineitem)
"""

QUERIES = {
    "bbox_stats": box_stats,
    "geometry_ops": geometry_ops,
    **{f"image_{n}": _element(f) for n, (f, _, _) in IMAGE.items()},
    "hash_distance": hash_distance,
    **{n: _element(f) for n, (f, _) in ELEMENT.items()},
    **{n: _reduce(f) for n, (f, _) in REDUCE.items()},
    **{f"pair_{n}": _pair(f) for n, (f, _) in PAIR.items()},
    **images.QUERIES,
    **shapes.QUERIES,
    **relational.QUERIES,
}
ORACLE_SQL = {
    "bbox_stats": BOX_SQL,
    "geometry_ops": GEOMETRY_SQL,
    **{f"image_{n}": f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round({e}, 6) AS value FROM ({_X}) s, unnest(range(0, {k})) AS u(pos)" for n, (_, k, e) in IMAGE.items()},
    "hash_distance": HASH_SQL,
    **{n: f"SELECT vec_id, pos, round({e}, 6) AS value FROM ({_LONG})" for n, (_, e) in ELEMENT.items()},
    **{n: f"SELECT vec_id, round({e}, 5) AS value FROM ({_X})" for n, (_, e) in REDUCE.items()},
    **{f"pair_{n}": f"SELECT vec_id, pos, round({e}, 5) AS value FROM ({_PAIRS})" for n, (_, e) in PAIR.items()},
    **images.ORACLE_SQL,
    **shapes.ORACLE_SQL,
    **relational.ORACLE_SQL,
}
