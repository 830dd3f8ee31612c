"""Queries whose work must stay compiled, spread over the cores, or done once for equal input."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.functions import shapes as shape_functions
from rasterloom.functions.shapes import _MATCH
from rasterloom.operators import batches as B
from rasterloom.operators import contours as C
from rasterloom.operators import planar as P
from rasterloom.plans import arrow as A
from rasterloom.plans import catalog, shapes

DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_geometry_ops_is_compiled(spark):
    assert "lambdafunction" not in plan(catalog.geometry_ops(spark, DIR))
    pts = [G.point(F.col("id") * a, F.col("id") + b) for a, b in ((1, 2), (3, -1), (2, 5), (-4, 7))]
    row = spark.range(1, 9).select(*[F.array(f(pts), f(F.array(*pts))).alias(f.__name__) for f in (G.polygon_area, G.polygon_perimeter, G.ring_signed_area)], F.array(G.ring_bounding_box(pts), G.ring_bounding_box(F.array(*pts))).alias("b"))
    assert all(a == b for r in row.collect() for a, b in r)


@pytest.mark.parametrize("query", [shapes.contour_measures, shapes.contour_set_operations, shapes.point_sets, shapes.rasterized])
def test_equal_shapes_are_measured_once(spark, query):
    before = plan(query(spark, DIR)).split("Arrow")[-1]
    assert "Aggregate(keys=[x#" in before and "REPARTITION_BY_NUM" in before


def _convex(g, kind):
    if kind == "box":
        (x, y), (w, h) = g.integers(0, 12, 2), g.integers(1, 6, 2)
        r = np.asarray([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float)
    else:
        t = g.uniform(0, 1) + np.arange(4) * math.tau / 4 + g.uniform(0, 1.2, 4)
        r = g.uniform(0, 6, 2) + g.uniform(1, 5) * np.stack((np.cos(t), np.sin(t)), 1)
    return P.Shape([r[::-1] if g.integers(2) else r])


@pytest.mark.parametrize("kind", ["box", "turned"])
def test_batches_equal_single_shapes(kind):
    g = np.random.default_rng(6)
    left, right = ([[_convex(g, kind) for _ in range(g.integers(0, 5))] for _ in range(100)] for _ in range(2))
    column = lambda v: pa.array([[C.to_value(s) for s in r] for r in v], pa.list_(A._CONTOUR))
    a, b = B.convex_sets(column(left)), B.convex_sets(column(right))
    for measure, want in ((B.iou, C.overlap), (B.coverage(0.25), lambda s, t: C.coverage(t, s, 0.25))):
        values, begin, n, m = B.matrices(a, b, measure)
        got, matrix = B.nested(values, n, m).to_pylist(), [[[want(s, t) for t in y] for s in x] for x, y in zip(left, right, strict=True)]
        assert [[pytest.approx(z, abs=1e-9) for z in x] for x in matrix] == got
        assert B.greedy(values, begin, n, m, np.full(100, 0.2), _MATCH).to_pylist() == [C.greedy(x, len(y), 0.2) for x, y in zip(got, right, strict=True)]
    odd = [*left[:3], [P.Shape([np.asarray([[0, 0], [4, 0], [1, 1], [0, 4]], float)])]]
    assert B.convex_sets(column(odd)) is None and B.convex_sets(column([[]])) is None


def test_box_contours_run_in_batches(spark, monkeypatch):
    """No row of the query goes through the kernels of single shapes."""
    monkeypatch.setattr(C, "from_value", lambda v: pytest.fail("a single row"))
    c = shape_functions.contour(F.col("c"), many=True)
    boxes = shape_functions.bbox(F.array(*[G.bbox(F.col("id") + i, F.lit(0.0), F.lit(2.0), F.lit(1.0)) for i in range(3)]), many=True)
    runs = []
    monkeypatch.setattr(F, "arrow_udf", lambda run, ddl: lambda *cols: runs.append(run))
    c.area(), c.bounding_box(), c.pairwise_iou(F.col("c")), c.correspond(F.col("c"), 0.5), c.correspond_by_coverage(F.col("c"), 0.1, 0.5)
    col = spark.range(5).select(boxes.to_contour().alias("c")).toArrow()["c"]
    got = [run(*([col] if k < 2 else [col, col] if k == 2 else [col, col, pa.array([0.5] * 5), pa.nulls(5, pa.list_(pa.int32()))])) for k, run in enumerate(runs)]
    assert got[0].to_pylist() == [[2.0] * 3] * 5 and [r["right_idx"] for r in got[4].to_pylist()] == [[0, 1, 2]] * 5


def test_box_contours_match_by_coverage_and_come_back_as_boxes(spark):
    sets = {r.l_orderkey: r.boxes for r in shapes.sets(spark, DIR).where("l_orderkey < 60").collect()}
    got = {r.l_orderkey: r for r in shapes.box_contour_round_trip(spark, DIR).where("l_orderkey < 60").collect()}
    box = lambda b, x=0.0, y=0.0: P.Shape([np.asarray([[u + x, v + y] for u, v in ((b.x, b.y), (b.x + b.width, b.y), (b.x + b.width, b.y + b.height), (b.x, b.y + b.height))])])
    assert got.keys() == sets.keys() and any(r.covered for r in got.values())
    for key, boxes in sets.items():
        matrix = [[C.coverage(box(t), box(a, 1.0, 0.5), 0.25) for t in boxes] for a in boxes]
        want = C.greedy(matrix, len(boxes), 0.5)
        assert got[key].covered == pytest.approx(sum(want["overlap"])) and got[key].cover_mark == sum((j + 1) * (i + 1) for i, j in enumerate(want["right_idx"]) if j is not None)
        assert got[key].boxes == pytest.approx(sum(b.x + 2 * b.y + 3 * b.width + 4 * b.height for b in boxes))
