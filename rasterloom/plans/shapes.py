"""Queries of points, boxes and contours in sets, and their DuckDB SQL.

Line items give boxes b (x = quantity, y = 100 discount, width = tax + 3, height = 4), one set for each order. Parts give
single boxes from their size and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.shapes import bbox, contour, contour_from_coords, mask_dice, mask_iou, point
from .graph import Pipeline, cv

_L = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) * 100 AS y, CAST(l_tax AS DOUBLE) * 100 + 3 AS w, 4.0::DOUBLE AS h FROM lineitem"


_P = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 11 AS DOUBLE) AS y, CAST(p_partkey % 9 + 3 AS DOUBLE) AS w, 4.0::DOUBLE AS h FROM part"
#: With a place of its own for each box of an order, as sets() sorts them.
_N = f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x, y, w, h) AS n FROM ({_L})"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_discount").cast("double") * 100).alias("y"), (F.col("l_tax").cast("double") * 100 + 3).alias("w"), F.lit(4.0).alias("h"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    num = lambda c, n: c.cast("double").alias(n)
    return p.select("p_partkey", num(F.col("p_size"), "x"), num(F.col("p_partkey") % 11, "y"), num(F.col("p_partkey") % 9 + 3, "w"), F.lit(4.0).alias("h"))


def each_shape(spark: SparkSession, sf_dir: str, measure) -> DataFrame:
    """measure(frame of x, y, w, h) for every part: equal shapes are measured once, spread over all cores (the tables are
    small in bytes, so that scans give one task), and every part gets its shape's row."""
    shape = ["x", "y", "w", "h"]
    p = parts(spark, sf_dir)
    # by number, so that small shuffles are not joined to a few tasks
    shapes = p.select(*shape).distinct().repartition(4 * spark.sparkContext.defaultParallelism)
    got = measure(shapes)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in shape]
    return p.alias("p").join(got.alias("m"), same).select("p.p_partkey", *[F.col(f"m.{c}") for c in got.columns if c not in shape])


def _box() -> Column:
    return G.bbox(F.col("x"), F.col("y"), F.col("w"), F.col("h"))


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's boxes, in order of the line number, with a score."""
    one = F.struct("l_linenumber", _box().alias("b"))
    got = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("s"))
    return got.select("l_orderkey", F.transform("s", lambda v: v["b"]).alias("boxes"), F.transform("s", lambda v: (v["b"]["x"] * 7 + v["l_linenumber"]).cast("double")).alias("scores"))


def ring(*points) -> Column:
    """A contour from pairs of columns or numbers."""
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return contour_from_coords(F.array(*[F.array(c(x), c(y)) for x, y in points]))


def rect(x, y, w, h) -> Column:
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def _cols():
    return F.col("x"), F.col("y"), F.col("w"), F.col("h")


def contour_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of a box with a notch, and of a box with a hole."""
    x, y, w, h = _cols()
    notched = ring((x, y), (x + w, y), (x + w, y + h), (x + w / 2, y + 1), (x, y + h))
    c = contour(notched)
    d = lambda shapes: shapes.select(
        "x", "y", "w", "h", c.area().alias("area"), c.area(signed=True).alias("signed"), contour(c.flip()).area(signed=True).alias("flipped"), c.perimeter().alias("length"),
        c.winding().alias("winding"), contour(c.flip()).winding().alias("other_winding"), c.is_convex().alias("convex"), contour(rect(x, y, w, h)).is_convex().alias("box_convex"),
        c.bounding_box().alias("b"), contour(c.convex_hull()).area().alias("hull"), contour(c.translate(2.0, 3.0)).bounding_box().alias("t"), contour(rect(x, y, w, h)).centroid().alias("m"),
        contour(contour(rect(x, y, w, h)).scale(2.0, 3.0)).bounding_box().alias("s"), contour(contour(rect(x, y, w, h)).smooth()).area().alias("smooth"),
        F.size(contour(rect(x, y, w, h)).densify(1.5)["exterior"]).alias("dense"), contour(c.normalize(w, h)).area().alias("unit"), contour(contour(notched).ensure_winding("cw")).winding().alias("turned"),
        F.size(contour(ring((x, y), (x + w / 2, y), (x + w, y), (x + w, y + h), (x, y + h))).simplify(0.01)["exterior"]).alias("corners"),
    )
    r = lambda v, n: F.round(v, 5).alias(n)
    return each_shape(spark, sf_dir, d).select(
        "p_partkey", *[r(F.col(n), n) for n in ("area", "signed", "flipped", "length", "hull", "smooth", "unit")], "winding", "other_winding", "turned", "convex", "box_convex", "dense", "corners",
        r(F.col("b.width"), "b_width"), r(F.col("t.x"), "t_x"), r(F.col("t.y"), "t_y"), r(F.col("m.x"), "m_x"), r(F.col("m.y"), "m_y"), r(F.col("s.x"), "s_x"), r(F.col("s.height"), "s_height"),
    )


CONTOUR_MEASURES_SQL = f"""SELECT p_partkey, round(w * h - w * (h - 1) / 2, 5) AS area, round(w * h - w * (h - 1) / 2, 5) AS signed, round(w * (h - 1) / 2 - w * h, 5) AS flipped,
 round(w + 2 * h + 2 * sqrt(w * w / 4 + 9), 5) AS length, round(w * h, 5) AS hull, round(w * h * 7 / 8, 5) AS smooth, round(1 - (h - 1) / h / 2, 5) AS unit,
 'ccw' AS winding, 'cw' AS other_winding, 'cw' AS turned, FALSE AS convex, TRUE AS box_convex, CAST(2 * ceil(round(w / 1.5, 9)) + 2 * ceil(h / 1.5) AS INTEGER) AS dense, 4 AS corners,
 round(w, 5) AS b_width, round(x + 2, 5) AS t_x, round(y + 3, 5) AS t_y, round(x + w / 2, 5) AS m_x, round(y + h / 2, 5) AS m_y, round(x - w / 2, 5) AS s_x, round(3 * h, 5) AS s_height FROM ({_P})"""


def contour_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of what two boxes give, of grown and shrunk boxes and of strokes; IoU, Dice and vertex distances."""
    x, y, w, h = _cols()
    a, b = rect(x, y, w, h), rect(F.lit(10.0), F.lit(2.0), F.lit(20.0), F.lit(5.0))
    pair = lambda op: getattr(cv(F.array(F.col("a"))).pipe(Pipeline().source("contour")), op)(cv(F.array(F.col("b"))).pipe(Pipeline().source("contour"))).contour_area().reduce_sum().sink("native")
    total = lambda s: F.aggregate(contour(s, many=True).area(), F.lit(0.0), lambda t, v: t + v)
    p, q = contour(F.col("a")), contour(F.col("b"))
    line = contour(contour_from_coords(F.array(F.array(x, y), F.array(x + w, y)), is_closed=False))
    d = lambda shapes: shapes.select("x", "y", "w", "h", a.alias("a"), b.alias("b")).select(
        "x", "y", "w", "h", pair("union").alias("either"), pair("intersection").alias("both"), pair("difference").alias("only"), pair("symmetric_difference").alias("one"),
        total(contour(F.array("a", "b"), many=True).union_all()).alias("all_"), total(p.offset(1.0, join="miter")).alias("grown"), total(p.offset(-1.0)).alias("shrunk"),
        total(line.stroke(2.0, cap="butt")).alias("stroke"), total(line.stroke(2.0, cap="square")).alias("capped"), p.iou(q).alias("iou"), p.dice(q).alias("dice"), p.hausdorff_distance(contour(p.translate(3.0, 0.0))).alias("hausdorff"),
        contour(p.boundary(), many=True).perimeter()[0].alias("rim"), contour(contour(p.boundary()[0]).close()).area().alias("closed"), contour(contour(F.array("a", "b"), many=True).largest(1), many=True).area()[0].alias("largest"),
        p.contains_point(G.point(F.lit(15.0), F.lit(4.0))).alias("holds"), p.boundary_distances(contour(p.translate(0.0, 1.0)))["hd"].alias("hd"),
    )
    out = each_shape(spark, sf_dir, d)
    return out.select("p_partkey", *[(F.round(F.col(c), 4).alias(c) if c != "holds" else F.col(c)) for c in out.columns[1:]])


CONTOUR_SETS_SQL = f"""SELECT p_partkey, round(s - o, 4) AS either, round(o, 4) AS both, round(w * h - o, 4) AS only, round(s - 2 * o, 4) AS one, round(s - o, 4) AS all_,
 round((w + 2) * (h + 2), 4) AS grown, round((w - 2) * (h - 2), 4) AS shrunk, round(2 * w, 4) AS stroke, round(2 * (w + 2), 4) AS capped, round(o / (s - o), 4) AS iou, round(2 * o / s, 4) AS dice,
 round(least(3.0, w), 4) AS hausdorff, round(2 * (w + h), 4) AS rim, round(w * h, 4) AS closed, round(greatest(w * h, 100), 4) AS largest,
 (15 >= x AND 15 <= x + w AND 4 >= y AND 4 <= y + h) AS holds, 1.0::DOUBLE AS hd
FROM (SELECT *, w * h + 100 AS s, greatest(least(x + w, 30) - greatest(x, 10), 0) * greatest(least(y + h, 7) - greatest(y, 2), 0) AS o FROM ({_P}))"""


def rasterized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Painted pixels of a box with a hole on a canvas of 40 x 20."""
    x, y, w, h = _cols()
    shape = contour_from_coords(F.array(F.array(x / 2, y), F.array(x / 2 + w, y), F.array(x / 2 + w, y + h), F.array(x / 2, y + h)))
    n = cv(shape).pipe(Pipeline().source("contour")).rasterize(height=20, width=40, fill_value=1).reduce_sum().sink("native")
    soft = cv(shape).pipe(Pipeline().source("contour")).rasterize(height=20, width=40, fill_value=100, supersample=2).reduce_max().sink("native")
    return each_shape(spark, sf_dir, lambda shapes: shapes.select("x", "y", "w", "h", n.cast("bigint").alias("painted"), soft.cast("bigint").alias("top")))


def _centres(lo: str, hi: str, n: int) -> str:
    return f"len(list_filter(range(0, {n}), lambda k: k + 0.5 >= {lo} AND k + 0.5 <= {hi}))"


RASTER_SQL = f"SELECT p_partkey, CAST({_centres('x / 2', 'x / 2 + w', 40)} * {_centres('y', 'y + h', 20)} AS BIGINT) AS painted, 100::BIGINT AS top FROM ({_P})"


def box_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each order's boxes: areas, shares of a frame and the IoU matrix, summed."""
    b = bbox("boxes", many=True)
    s = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, v: t + v), 4)
    matrix = F.flatten(b.pairwise_iou(F.col("boxes")))
    corner = F.transform(b.to_coords("cxcywh"), lambda v: v[0])
    return sets(spark, sf_dir).select(
        "l_orderkey", s(b.area()).alias("areas"), s(matrix).alias("ious"), s(corner).alias("centres"), s(bbox(b.normalize(100.0, 50.0), many=True).area()).alias("shares"),
        s(bbox(bbox(b.normalize(100.0, 50.0), many=True).to_absolute(100.0, 50.0), many=True).area()).alias("again"), s(bbox(b.translate(1.0, 2.0), many=True).pairwise_iou(F.slice("boxes", 1, 1))[0]).alias("first"),
        s(bbox(b.scale(2.0, 0.5), many=True).area()).alias("scaled"), s(bbox(b.pad(0.5), many=True).area()).alias("padded"), s(b.iou(F.get("boxes", F.lit(0)))).alias("to_first"),
    )


def _iou(a: str, b: str) -> str:
    o = f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0) * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0))"
    return f"({o} / ({a}.w * {a}.h + {b}.w * {b}.h - {o}))"


BOX_SETS_SQL = f"""WITH l AS ({_N}), p AS (SELECT a.l_orderkey, sum({_iou('a', 'b')}) AS ious, sum(CASE WHEN b.n = 1 THEN {_iou('a', 'b')} END) AS to_first FROM l a JOIN l b USING (l_orderkey) GROUP BY a.l_orderkey),
 t AS (SELECT l_orderkey, {_iou('m', 'a')} AS first FROM (SELECT * FROM l WHERE n = 1) a JOIN (SELECT l_orderkey, x + 1 AS x, y + 2 AS y, w, h FROM l WHERE n = 1) m USING (l_orderkey))
SELECT l_orderkey, round(sum(w * h), 4) AS areas, round(any_value(ious), 4) AS ious, round(sum(x + w / 2), 4) AS centres, round(sum(w * h / 5000), 4) AS shares, round(sum(w * h), 4) AS again,
 round(any_value(first), 4) AS first, round(sum(w * h), 4) AS scaled, round(sum((w + 1) * (h + 1)), 4) AS padded, round(any_value(to_first), 4) AS to_first
FROM l JOIN p USING (l_orderkey) JOIN t USING (l_orderkey) GROUP BY l_orderkey"""


def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes kept of each order, by score, where IoU above 0.2 suppresses."""
    kept = bbox("boxes", many=True).nms(F.col("scores"), 0.2)
    out = sets(spark, sf_dir).select("l_orderkey", "boxes", F.posexplode(kept).alias("place", "i"))
    return out.select("l_orderkey", "place", F.round(F.expr("boxes[i].x"), 4).alias("x"), F.round(F.expr("boxes[i].width"), 4).alias("width"))


BOX_NMS_SQL = f"""WITH l AS ({_N}), s AS (SELECT l_orderkey, list([{{'x': x, 'y': y, 'w': w, 'h': h}}] ORDER BY x * 7 + l_linenumber DESC, n) AS b FROM l GROUP BY l_orderkey),
 k AS (SELECT l_orderkey, list_reduce(b, lambda kept, n: CASE WHEN len(list_filter(kept, lambda a: {_iou('a', 'n[1]')} > 0.2)) = 0 THEN list_concat(kept, n) ELSE kept END) AS b FROM s)
SELECT l_orderkey, CAST(p AS INTEGER) AS place, round(b[p + 1].x, 4) AS x, round(b[p + 1].w, 4) AS width FROM k, unnest(range(0, len(b))) AS u(p)"""


def box_correspond(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's boxes, moved by (1, 0.5), matched with the boxes as they are."""
    b = bbox("boxes", many=True)
    m = sets(spark, sf_dir).select("l_orderkey", bbox(b.translate(1.0, 0.5), many=True).correspond(F.col("boxes"), 0.3).alias("m"))
    marks = F.transform("m.right_idx", lambda v, i: F.when(v.isNull(), 0).otherwise((v + 1) * (i + 1)))
    return m.select(
        "l_orderkey", F.size(F.expr("filter(m.right_idx, v -> v is not null)")).cast("bigint").alias("matched"), F.aggregate(marks, F.lit(0), lambda t, v: t + v).cast("bigint").alias("mark"),
        F.round(F.aggregate("m.overlap", F.lit(0.0), lambda t, v: t + v), 4).alias("overlap"), F.size(F.expr("filter(m.duplicate, v -> v)")).cast("bigint").alias("duplicates"),
    )


#: Each left box in turn takes the first right box of its list that is still free.
BOX_CORRESPOND_SQL = f"""WITH l AS ({_N}), a AS (SELECT l_orderkey, n, x + 1 AS x, y + 0.5 AS y, w, h FROM l),
 c AS (SELECT a.l_orderkey, a.n, list(b.n ORDER BY {_iou('a', 'b')} DESC, b.n) FILTER ({_iou('a', 'b')} >= 0.3) AS r, map_from_entries(list(ROW(b.n, {_iou('a', 'b')}))) AS o FROM a JOIN l b USING (l_orderkey) GROUP BY a.l_orderkey, a.n),
 s AS (SELECT l_orderkey, list(coalesce(r, []::BIGINT[]) ORDER BY n) AS e, list(o ORDER BY n) AS o FROM c GROUP BY l_orderkey),
 m AS (SELECT l_orderkey, e, o, list_reduce(list_prepend([]::BIGINT[], e), lambda acc, y: list_append(acc, coalesce(list_filter(y, lambda q: NOT list_contains(acc, q))[1], -1))) AS t FROM s)
SELECT l_orderkey, CAST(len(list_filter(t, lambda v: v > 0)) AS BIGINT) AS matched, CAST(list_sum(list_transform(t, lambda v, i: CASE WHEN v > 0 THEN v * i ELSE 0 END)) AS BIGINT) AS mark,
 round(list_sum(list_transform(t, lambda v, i: CASE WHEN v > 0 THEN o[i][v] ELSE 0 END)), 4) AS overlap, CAST(len(list_filter(range(1, len(t) + 1), lambda i: t[i] < 0 AND len(e[i]) > 0)) AS BIGINT) AS duplicates FROM m"""


def box_contour_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as contours and back: their areas, the boxes around them, matches by IoU of contours, matches of the boxes moved
    by (1, 0.5) with the boxes as they are by coverage, and the IoU matrix."""
    b = bbox("boxes", many=True)
    moved = bbox(b.translate(1.0, 0.5), many=True).to_contour()
    d = sets(spark, sf_dir).select("l_orderkey", b.to_contour().alias("c"), moved.alias("moved"))
    c = contour("c", many=True)
    s = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda t, u: t + u), 4)
    d = d.select(
        "l_orderkey", c.area().alias("area"), c.pairwise_iou(F.col("c")).alias("iou"), c.correspond(F.col("c"), 0.5).alias("half"), c.correspond(F.col("c"), 0.99).alias("same"),
        c.bounding_box().alias("back"), contour("moved", many=True).correspond_by_coverage(F.col("c"), 0.25, 0.5).alias("by"),
    )
    marks = F.transform("by.right_idx", lambda v, i: F.when(v.isNull(), 0).otherwise((v + 1) * (i + 1)))
    return d.select(
        "l_orderkey", s("area").alias("areas"), s(F.flatten("iou")).alias("ious"), F.size("half.right_idx").alias("n"), s("same.overlap").alias("own"),
        s(F.transform("back", lambda v: v["x"] + 2 * v["y"] + 3 * v["width"] + 4 * v["height"])).alias("boxes"), s("by.overlap").alias("covered"), F.aggregate(marks, F.lit(0), lambda t, v: t + v).cast("bigint").alias("cover_mark"),
    )


def _covered(a: str, b: str) -> str:
    """DuckDB: the share of b's corners in a or within 0.25 of it; no corner lies near that bound beside a corner of a."""
    near = lambda x, y: f"CASE WHEN {x} BETWEEN {a}.x - 0.25 AND {a}.x + {a}.w + 0.25 AND {y} BETWEEN {a}.y - 0.25 AND {a}.y + {a}.h + 0.25 THEN 0.25::DOUBLE ELSE 0 END"
    return "(" + " + ".join(near(x, y) for x in (f"{b}.x", f"{b}.x + {b}.w") for y in (f"{b}.y", f"{b}.y + {b}.h")) + ")"


BOX_CONTOUR_SQL = f"""WITH l AS ({_N}), a AS (SELECT l_orderkey, n, x + 1 AS x, y + 0.5 AS y, w, h FROM l),
 c AS (SELECT a.l_orderkey, a.n, list(b.n ORDER BY {_covered('a', 'b')} DESC, b.n) FILTER ({_covered('a', 'b')} >= 0.5) AS r, map_from_entries(list(ROW(b.n, {_covered('a', 'b')}))) AS o FROM a JOIN l b USING (l_orderkey) GROUP BY a.l_orderkey, a.n),
 s AS (SELECT l_orderkey, list(coalesce(r, []::BIGINT[]) ORDER BY n) AS e, list(o ORDER BY n) AS o FROM c GROUP BY l_orderkey),
 m AS (SELECT l_orderkey, o, list_reduce(list_prepend([]::BIGINT[], e), lambda acc, y: list_append(acc, coalesce(list_filter(y, lambda q: NOT list_contains(acc, q))[1], -1))) AS t FROM s),
 v AS (SELECT l_orderkey, round(list_sum(list_transform(t, lambda v, i: CASE WHEN v > 0 THEN o[i][v] ELSE 0 END)), 4) AS covered, CAST(list_sum(list_transform(t, lambda v, i: CASE WHEN v > 0 THEN v * i ELSE 0 END)) AS BIGINT) AS cover_mark FROM m),
 p AS (SELECT a.l_orderkey, round(sum(CASE WHEN a.n = b.n THEN a.w * a.h END), 4) AS areas, round(sum({_iou('a', 'b')}), 4) AS ious,
  CAST(count(DISTINCT a.n) AS INTEGER) AS n, CAST(count(DISTINCT a.n) AS DOUBLE) AS own, round(sum(CASE WHEN a.n = b.n THEN a.x + 2 * a.y + 3 * a.w + 4 * a.h END), 4) AS boxes FROM l a JOIN l b USING (l_orderkey) GROUP BY a.l_orderkey)
SELECT l_orderkey, areas, ious, n, own, boxes, covered, cover_mark FROM p JOIN v USING (l_orderkey)"""


def point_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a box as a set of points: every point function over sets and single points."""
    x, y, w, h = _cols()
    corners = F.array(G.point(x, y), G.point(x + w, y), G.point(x + w, y + h), G.point(x, y + h))
    p, o = point("p", many=True), point(G.point(F.lit(20.0), F.lit(5.0)))
    s = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, v: t + v), 5)
    xs = lambda c: s(point(c, many=True).x())
    frame = G.bbox(F.lit(10.0), F.lit(2.0), F.lit(20.0), F.lit(5.0))
    target = rect(F.lit(10.0), F.lit(2.0), F.lit(20.0), F.lit(5.0))
    one = point("o")
    d = lambda shapes: shapes.select("x", "y", "w", "h", corners.alias("p"), G.point(x, y).alias("o")).select(
        "x", "y", "w", "h", s(p.x()).alias("xs"), s(p.y()).alias("ys"), xs(p.translate(1.0, 2.0)).alias("moved"), xs(p.scale(2.0, 3.0)).alias("scaled"), xs(p.normalize(50.0, 10.0)).alias("normalized"),
        xs(p.to_absolute(50.0, 10.0)).alias("absolute"), s(p.distance(o)).alias("distances"), s(p.manhattan_distance(o)).alias("manhattan"), s(point(p.midpoint(o), many=True).y()).alias("middles"),
        xs(p.interpolate(o, 0.25)).alias("quarters"), s(F.transform(p.to_coords("yx"), lambda v: v[0])).alias("firsts"), F.size(F.filter(p.within_bbox(bbox(frame)), lambda v: v)).alias("inside"),
        F.round(one.distance_to_contour(target), 5).alias("to_contour"), F.round(one.signed_distance_to_contour(target), 5).alias("signed"), F.round(one.nearest_point_on_contour(target)["x"], 5).alias("nearest_x"),
        F.round(point(one.rotate(0.25)).x(), 5).alias("turned"), F.round(one.angle_to(o), 5).alias("angle"),
    )
    return each_shape(spark, sf_dir, d)


_OUT = "sqrt(pow(greatest(greatest(10 - x, x - 30), 0), 2) + pow(greatest(greatest(2 - y, y - 7), 0), 2))"
_IN = "least(x - 10, 30 - x, y - 2, 7 - y)"
_INSIDE = "(x > 10 AND x < 30 AND y > 2 AND y < 7)"
_D = lambda a, b: f"sqrt(pow({a} - 20, 2) + pow({b} - 5, 2))"
_CORNERS = [("x", "y"), ("x + w", "y"), ("x + w", "y + h"), ("x", "y + h")]
POINT_SETS_SQL = f"""SELECT p_partkey, round(4 * x + 2 * w, 5) AS xs, round(4 * y + 2 * h, 5) AS ys, round(4 * x + 2 * w + 4, 5) AS moved, round(2 * (4 * x + 2 * w), 5) AS scaled, round((4 * x + 2 * w) / 50, 5) AS normalized,
 round((4 * x + 2 * w) * 50, 5) AS absolute, round({' + '.join(_D(f'({a})', f'({b})') for a, b in _CORNERS)}, 5) AS distances, round({' + '.join(f'abs({a} - 20) + abs({b} - 5)' for a, b in _CORNERS)}, 5) AS manhattan,
 round((4 * y + 2 * h + 20) / 2, 5) AS middles, round((4 * x + 2 * w) * 0.75 + 20, 5) AS quarters, round(4 * y + 2 * h, 5) AS firsts,
 CAST({' + '.join(f'CASE WHEN {a} BETWEEN 10 AND 30 AND {b} BETWEEN 2 AND 7 THEN 1 ELSE 0 END' for a, b in _CORNERS)} AS INTEGER) AS inside,
 round(CASE WHEN {_INSIDE} THEN {_IN} ELSE {_OUT} END, 5) AS to_contour, round(CASE WHEN {_INSIDE} THEN -({_IN}) ELSE {_OUT} END, 5) AS signed,
 round(CASE WHEN {_INSIDE} THEN CASE WHEN {_IN} = y - 2 THEN x WHEN {_IN} = 30 - x THEN 30 WHEN {_IN} = 7 - y THEN x ELSE 10 END ELSE least(greatest(x, 10), 30) END, 5) AS nearest_x,
 round(x * cos(0.25) - y * sin(0.25), 5) AS turned, round(atan2(5 - y, 20 - x), 5) AS angle FROM ({_P})"""


def mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU and Dice of where a vector and its mirror image are positive."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda e: (e > 0).cast("int")).alias("m"))
    return v.select("vec_id", F.round(mask_iou(F.col("m"), F.reverse("m")), 6).alias("iou"), F.round(mask_dice(F.col("m"), F.reverse("m")), 6).alias("dice"))


MASK_SQL = """SELECT vec_id, round(b / (o + 1e-7), 6) AS iou, round(2 * b / (a + a + 1e-7), 6) AS dice FROM (SELECT vec_id,
 CAST(len(list_filter(range(1, 65), lambda k: m[k] AND m[65 - k])) AS DOUBLE) AS b, len(list_filter(range(1, 65), lambda k: m[k] OR m[65 - k])) AS o, len(list_filter(m, lambda z: z)) AS a
 FROM (SELECT vec_id, list_transform(embedding, lambda e: e > 0) AS m FROM embeddings))"""

QUERIES = {
    "contour_measures": contour_measures,
    "contour_set_operations": contour_set_operations,
    "rasterized_boxes": rasterized,
    "box_sets": box_sets,
    "box_nms": box_nms,
    "box_correspond": box_correspond,
    "box_contours": box_contour_round_trip,
    "point_sets": point_sets,
    "mask_scores": mask_scores,
}
ORACLE_SQL = {
    "contour_measures": CONTOUR_MEASURES_SQL,
    "contour_set_operations": CONTOUR_SETS_SQL,
    "rasterized_boxes": RASTER_SQL,
    "box_sets": BOX_SETS_SQL,
    "box_nms": BOX_NMS_SQL,
    "box_correspond": BOX_CORRESPOND_SQL,
    "box_contours": BOX_CONTOUR_SQL,
    "point_sets": POINT_SETS_SQL,
    "mask_scores": MASK_SQL,
}
