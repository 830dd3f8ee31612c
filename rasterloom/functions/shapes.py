"""Points, boxes and contours of a column, one value or a set in each row.

Points and boxes are native column expressions. Contours run their kernels in Arrow functions. `many` says that a row
holds a list; a single value meets every member of a set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import OPERATORS
from ..operators import batches as B
from ..operators import contours as C
from ..operators import planar as P
from ..plans import arrow as A
from . import geometry as G

#: The published column types.
POINT_SCHEMA = T.StructType().add("x", "double").add("y", "double")
POINT_SET_SCHEMA = RING_SCHEMA = T.ArrayType(POINT_SCHEMA)
CONTOUR_SCHEMA = T.StructType().add("exterior", RING_SCHEMA).add("holes", T.ArrayType(RING_SCHEMA)).add("is_closed", "boolean")
CONTOUR_SET_SCHEMA = T.ArrayType(CONTOUR_SCHEMA)
BBOX_SCHEMA = T.StructType().add("x", "double").add("y", "double").add("width", "double").add("height", "double")
CORRESPONDENCE_SCHEMA = T.StructType().add("right_idx", T.ArrayType(T.IntegerType())).add("overlap", T.ArrayType(T.DoubleType())).add("duplicate", T.ArrayType(T.BooleanType()))
TENSOR_SCHEMA = T.StructType().add("data", "binary").add("dtype", "string").add("shape", T.ArrayType(T.LongType())).add("strides", T.ArrayType(T.LongType())).add("offset", "long")
_NUMBER, _XY = pa.float64(), pa.struct([("x", pa.float64()), ("y", pa.float64())])
_BOX = pa.struct([(k, pa.float64()) for k in ("x", "y", "width", "height")])
_MATCH = pa.struct([("right_idx", pa.list_(pa.int32())), ("overlap", pa.list_(pa.float64())), ("duplicate", pa.list_(pa.bool_()))])
_DIST = pa.struct([(k, pa.float64()) for k in ("mean_a_to_b", "mean_b_to_a", "assd", "hd", "hd95")])


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rows(f, ddl: str, kind: pa.DataType, columns: dict[str, Column], null: str = "raise", needs: tuple[str, ...] | None = None, batch=None) -> Column:
    """f(**row) of each row; null where one of `needs` (by default all) is null, and on an error where the policy says so.
    `batch` gives the same for whole columns, or None where it does not hold."""
    names = list(columns)
    needs = tuple(names) if needs is None else needs
    quiet = null == "null"

    def run(*cols):
        cols = [A.whole(c) for c in cols]
        done = None if batch is None else batch(*cols)
        if done is not None:
            return done
        out = []
        for values in zip(*(c.to_pylist() for c in cols), strict=True):
            row = dict(zip(names, values, strict=True))
            if any(row[n] is None for n in needs):
                out.append(None)
                continue
            try:
                out.append(f(**row))
            except ValueError:
                if not quiet:
                    raise
                out.append(None)
        return pa.array(out, kind)

    return F.arrow_udf(run, ddl)(*columns.values())


def lift(f, a: Column, b: Column, many_a: bool, many_b: bool) -> Column:
    """f over two values or sets; sets of one row must have one size."""
    if many_a and many_b:
        return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("sets differ in size")))
    if many_a:
        return F.transform(a, lambda p: f(p, b))
    if many_b:
        return F.transform(b, lambda p: f(a, p))
    return f(a, b)


def _guard(ok: Column, out: Column, say: str) -> Column:
    return F.when(ok, out).when(ok.isNull(), None).otherwise(F.raise_error(F.lit(say)))


class Accessor:
    def __init__(self, column: Column | str, many: bool = False, errors: str = "raise"):
        self.column = F.col(column) if isinstance(column, str) else column
        self.many, self.errors = many, errors

    def on_error(self, policy: str):
        if policy not in ("raise", "null"):
            raise ValueError(f"on_error {policy!r} is neither raise nor null")
        return type(self)(self.column, self.many, policy)

    def on_null(self, value: Column):
        """The value that stands for a null."""
        return type(self)(F.coalesce(self.column, value), self.many, self.errors)

    def _each(self, f) -> Column:
        return F.transform(self.column, f) if self.many else f(self.column)

    def _with(self, other, f) -> Column:
        o = other if isinstance(other, Accessor) else type(self)(other)
        return lift(f, self.column, o.column, self.many, o.many)


class point(Accessor):  # noqa: N801
    def x(self) -> Column:
        return self._each(lambda p: p["x"])

    def y(self) -> Column:
        return self._each(lambda p: p["y"])

    def to_coords(self, order: str = "xy") -> Column:
        return self._each(lambda p: F.array(p["x"], p["y"]) if order == "xy" else F.array(p["y"], p["x"]))

    def normalize(self, width, height) -> Column:
        w, h = _col(width), _col(height)
        return self._each(lambda p: _guard((w != 0) & (h != 0), G.point_normalize(p, w, h), "normalize: a size of 0"))

    def to_absolute(self, width, height) -> Column:
        return self._each(lambda p: G.point_scale(p, _col(width), _col(height)))

    def translate(self, dx, dy) -> Column:
        return self._each(lambda p: G.point_translate(p, _col(dx), _col(dy)))

    def scale(self, sx, sy) -> Column:
        return self._each(lambda p: G.point_scale(p, _col(sx), _col(sy)))

    def rotate(self, angle, origin: Column | None = None) -> Column:
        return self._each(lambda p: G.point_rotate(p, angle, origin))

    def distance(self, other) -> Column:
        return self._with(other, G.point_distance)

    def manhattan_distance(self, other) -> Column:
        return self._with(other, G.point_manhattan_distance)

    def angle_to(self, other) -> Column:
        return self._with(other, G.point_angle_to)

    def midpoint(self, other) -> Column:
        return self._with(other, G.point_interpolate)

    def interpolate(self, other, t=0.5) -> Column:
        return self._with(other, lambda a, b: G.point_interpolate(a, b, _col(t)))

    def within_bbox(self, box) -> Column:
        o = box if isinstance(box, Accessor) else bbox(box)
        return lift(lambda p, b: G.bbox_contains(b, p), self.column, o.column, self.many, o.many)

    def _to_contour(self, contour_, f, ddl, kind) -> Column:
        def one(p, c):
            shapes = C.from_value(c)
            s = shapes[0] if shapes else P.Shape([])
            xy = [[q["x"], q["y"]] for q in (p if isinstance(p, list) else [p])]
            out = f(np.asarray(xy, float).reshape(-1, 2), s)
            return out if isinstance(p, list) else out[0]

        c = contour_.column if isinstance(contour_, Accessor) else contour_
        return rows(one, f"array<{ddl}>" if self.many else ddl, pa.list_(kind) if self.many else kind, {"p": self.column, "c": c}, self.errors)

    def distance_to_contour(self, contour_) -> Column:
        """To the boundary; infinite for an empty contour."""
        return self._to_contour(contour_, lambda p, s: P.nearest(p, P.outline(s))[0].tolist(), "double", _NUMBER)

    def signed_distance_to_contour(self, contour_) -> Column:
        """Negative inside."""
        return self._to_contour(contour_, lambda p, s: [-d if i else d for d, i in zip(P.nearest(p, P.outline(s))[0].tolist(), P.inside([s], p).tolist(), strict=True)], "double", _NUMBER)

    def nearest_point_on_contour(self, contour_) -> Column:
        """Null for an empty contour."""

        def near(p, s):
            e = P.outline(s)
            return [{"x": x, "y": y} for x, y in P.nearest(p, e)[1].tolist()] if len(e) else [None] * len(p)

        return self._to_contour(contour_, near, A.POINT, _XY)


class bbox(Accessor):  # noqa: N801
    def area(self) -> Column:
        return self._each(G.bbox_area)

    def to_coords(self, form: str = "xyxy") -> Column:
        return self._each(lambda b: G.bbox_to_coords(b, form))

    def to_contour(self) -> Column:
        return self._each(lambda b: F.struct(G.bbox_to_ring(b).alias("exterior"), F.array().cast(f"array<array<{A.POINT}>>").alias("holes"), F.lit(True).alias("is_closed")))

    def translate(self, dx, dy) -> Column:
        return self._each(lambda b: G.bbox_translate(b, _col(dx), _col(dy)))

    def scale(self, sx, sy) -> Column:
        return self._each(lambda b: _guard((_col(sx) >= 0) & (_col(sy) >= 0), G.bbox_scale(b, _col(sx), _col(sy)), "scale: a negative factor"))

    def normalize(self, width, height) -> Column:
        w, h = _col(width), _col(height)
        return self._each(lambda b: _guard((w != 0) & (h != 0), G.bbox_scale(b, 1 / F.nullif(w.cast("double"), F.lit(0.0)), 1 / F.nullif(h.cast("double"), F.lit(0.0))), "normalize: a size of 0"))

    def to_absolute(self, width, height) -> Column:
        return self._each(lambda b: G.bbox_scale(b, _col(width), _col(height)))

    def clip(self, width, height) -> Column:
        return self._each(lambda b: G.bbox_clip(b, _col(width), _col(height)))

    def pad(self, amount) -> Column:
        return self._each(lambda b: G.bbox_pad(b, _col(amount)))

    def expand(self, factor) -> Column:
        return self._each(lambda b: G.bbox_expand(b, _col(factor)))

    def iou(self, other) -> Column:
        return self._with(other, G.bbox_iou)

    def pairwise_iou(self, other) -> Column:
        """One list for each box, with its IoU to every box of the other set."""
        o = other.column if isinstance(other, Accessor) else other
        return F.transform(self.column, lambda a: F.transform(o, lambda b: G.bbox_iou(a, b)))

    def correspond(self, other, threshold=0.5, order: Column | None = None) -> Column:
        """Greedy exclusive matches by IoU, in the given order of the left boxes."""
        o = other.column if isinstance(other, Accessor) else other

        def one(a, b, threshold, order):
            return C.greedy([[C.box_iou(x, y) for y in b] for x in a], len(b), threshold, order)

        return rows(one, A.CORRESPONDENCE, _MATCH, {"a": self.column, "b": o, "threshold": _col(threshold).cast("double"), "order": F.lit(None).cast("array<int>") if order is None else order}, self.errors, ("a", "b", "threshold"))

    def nms(self, scores: Column, threshold=0.5) -> Column:
        """Places of the kept boxes, the highest score first."""
        return rows(lambda a, s, t: C.nms(a, s, t), "array<int>", pa.list_(pa.int32()), {"a": self.column, "s": scores, "t": _col(threshold).cast("double")}, self.errors)


def _rings(f):
    """A batch function from one of the rings of a column of sets."""

    def batch(c):
        sets = B.convex_sets(c)
        return None if sets is None else B.lists(sets.start, f(sets))

    return batch


def _boxes(sets: B.Sets) -> pa.StructArray:
    low, high = sets.rings.min(1), sets.rings.max(1)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(v)) for v in (low[:, 0], low[:, 1], *(high - low).T)], fields=list(_BOX))


def _many(ddl: str, kind: pa.DataType, many: bool):
    return (f"array<{ddl}>", pa.list_(kind)) if many else (ddl, kind)


class contour(Accessor):  # noqa: N801
    def _run(self, op: str, ddl: str, kind: pa.DataType, to, batch=None, **params) -> Column:
        """The operator on the row's contours; `to` makes a member's result a value."""
        f, many = OPERATORS[op].run, self.many
        full = {**{k: v for k, v in OPERATORS[op].params.items()}, **params}
        cols = {k: v for k, v in full.items() if isinstance(v, Column)}
        held = {k: v for k, v in full.items() if not isinstance(v, Column)}

        def one(c, **p):
            out = [to(v) for v in f(C.from_value(c), **held, **p)]
            return out if many else out[0] if out else None

        return rows(one, *_many(ddl, kind, many), {"c": self.column, **cols}, self.errors, batch=batch if many and not cols else None)

    def _set(self, op: str, **params) -> Column:
        """An operator whose result is a set."""
        f = OPERATORS[op].run
        full = {**OPERATORS[op].params, **params}
        cols = {k: v for k, v in full.items() if isinstance(v, Column)}
        held = {k: v for k, v in full.items() if not isinstance(v, Column)}
        return rows(lambda c, **p: [C.to_value(s) for s in f(C.from_value(c), **held, **p)], f"array<{A.CONTOUR}>", pa.list_(A._CONTOUR), {"c": self.column, **cols}, self.errors)

    def _number(self, op: str, **params) -> Column:
        return self._run(op, "double", _NUMBER, float, **params)

    def _shape(self, op: str, **params) -> Column:
        return self._run(op, A.CONTOUR, A._CONTOUR, C.to_value, **params)

    def area(self, signed: bool = False) -> Column:
        batch = _rings(lambda s: pa.array(s.area if signed else np.abs(s.area)))
        return self._number("contour_area", batch=batch if isinstance(signed, bool) else None, signed=signed)

    def perimeter(self) -> Column:
        return self._number("contour_perimeter")

    def centroid(self) -> Column:
        return self._run("contour_centroid", A.POINT, _XY, lambda v: {"x": float(v[0]), "y": float(v[1])})

    def bounding_box(self) -> Column:
        return self._run("contour_bounding_box", A.BBOX, _BOX, lambda v: dict(zip(("x", "y", "width", "height"), map(float, v), strict=True)), batch=_rings(_boxes))

    def winding(self) -> Column:
        return self._run("contour_winding", "string", pa.string(), str)

    def is_convex(self) -> Column:
        return self._run("contour_is_convex", "boolean", pa.bool_(), bool)

    def translate(self, dx, dy) -> Column:
        return self._shape("contour_translate", dx=dx, dy=dy)

    def scale(self, sx, sy, origin: str = "centroid") -> Column:
        return self._shape("contour_scale", sx=sx, sy=sy, origin=origin)

    def simplify(self, tolerance) -> Column:
        return self._shape("contour_simplify", tolerance=tolerance)

    def convex_hull(self) -> Column:
        return self._shape("contour_convex_hull")

    def close(self) -> Column:
        return self._shape("contour_close")

    def smooth(self, iterations: int = 1) -> Column:
        return self._shape("contour_smooth", iterations=iterations)

    def densify(self, max_segment_length) -> Column:
        return self._shape("contour_densify", max_segment_length=max_segment_length)

    def flip(self) -> Column:
        return self._shape("contour_flip")

    def ensure_winding(self, direction: str) -> Column:
        return self._shape("contour_ensure_winding", direction=direction)

    def normalize(self, width, height) -> Column:
        return self._shape("contour_normalize", width=width, height=height)

    def to_absolute(self, width, height) -> Column:
        return self._shape("contour_to_absolute", width=width, height=height)

    def boundary(self) -> Column:
        return self._set("contour_boundary")

    def union_all(self) -> Column:
        return self._set("contour_union_all")

    def offset(self, distance, join: str = "round") -> Column:
        return self._set("contour_offset", distance=distance, join=join)

    def stroke(self, width=1.0, cap: str = "round", join: str = "round") -> Column:
        return self._set("contour_stroke", width=width, cap=cap, join=join)

    def largest(self, k: int = 1) -> Column:
        return self._set("contour_largest", k=k)

    def single(self, label: Column) -> Column:
        """The one contour of a set; another number is an error that names the label."""
        return F.when(F.size(self.column) == 1, F.get(self.column, F.lit(0))).when(self.column.isNotNull(), F.raise_error(F.concat(F.lit("not one contour: "), label.cast("string"))))

    def to_coords(self, order: str = "xy") -> Column:
        many = self.many

        def one(c):
            out = []
            for s in C.from_value(c):
                if len(s.rings) > 1:
                    raise ValueError("to_coords: a contour with holes")
                out.append((s.rings[0] if order == "xy" else s.rings[0][:, ::-1]).tolist())
            return out if many else out[0]

        return rows(one, *_many("array<array<double>>", pa.list_(pa.list_(_NUMBER)), self.many), {"c": self.column}, self.errors)

    def close_along_border(self, width, height, arc: str = "shortest", max_snap=2.0) -> Column:
        cols = {"c": self.column, "w": _col(width).cast("double"), "h": _col(height).cast("double"), "snap": _col(max_snap).cast("double")}
        many = self.many

        def one(c, w, h, snap):
            out = [C.to_value(C.close_along_border(s, w, h, arc, snap)) for s in C.from_value(c)]
            return out if many else out[0]

        return rows(one, *_many(A.CONTOUR, A._CONTOUR, self.many), cols, self.errors)

    def contains_point(self, p) -> Column:
        """Inside the region or on its boundary."""
        o = p if isinstance(p, Accessor) else point(p)
        many = self.many

        def one(c, p):
            several = isinstance(p, list)
            xy = np.asarray([[q["x"], q["y"]] for q in (p if several else [p])], float).reshape(-1, 2)
            hits = [(P.inside([s], xy) | (P.nearest(xy, P.outline(s))[0] == 0)).tolist() for s in C.from_value(c)]
            if many:
                return [h[0] for h in hits] if not several else [h[i % len(h)] for i, h in enumerate(hits)]
            return hits[0] if several else hits[0][0]

        return rows(one, *_many("boolean", pa.bool_(), self.many or o.many), {"c": self.column, "p": o.column}, self.errors)

    def _pairs(self, other, f, ddl, kind) -> Column:
        """f of two shapes; a single one meets every member of a set."""
        o = other if isinstance(other, Accessor) else contour(other)
        left, right = self.many, o.many
        many = left or right

        def one(a, b):
            x, y = C.from_value(a), C.from_value(b)
            if not many:
                return f(x[0], y[0])
            if left and right and len(x) != len(y):
                raise ValueError("sets differ in size")
            return [f(x[i if left else 0], y[i if right else 0]) for i in range(len(x) if left else len(y))]

        return rows(one, *_many(ddl, kind, many), {"a": self.column, "b": o.column}, self.errors)

    def iou(self, other) -> Column:
        return self._pairs(other, lambda a, b: C.overlap(a, b, "iou"), "double", _NUMBER)

    def dice(self, other) -> Column:
        return self._pairs(other, lambda a, b: C.overlap(a, b, "dice"), "double", _NUMBER)

    def hausdorff_distance(self, other) -> Column:
        return self._pairs(other, C.hausdorff, "double", _NUMBER)

    def boundary_distances(self, other, sample_step: float | None = None, frame: Column | None = None) -> Column:
        if frame is None:
            return self._pairs(other, lambda a, b: C.boundary_distances([a], [b], sample_step), A.DISTANCES, _DIST)
        o = other.column if isinstance(other, Accessor) else other
        return rows(lambda a, b, f: C.boundary_distances(C.from_value(a)[:1], C.from_value(b)[:1], sample_step, f), A.DISTANCES, _DIST, {"a": self.column, "b": o, "f": frame}, self.errors)

    def set_boundary_distances(self, other, sample_step: float | None = None, frame: Column | None = None) -> Column:
        o = other.column if isinstance(other, Accessor) else other
        cols = {"a": self.column, "b": o, "f": F.lit(None).cast(A.BBOX) if frame is None else frame}
        return rows(lambda a, b, f: C.boundary_distances(C.from_value(a), C.from_value(b), sample_step, f), A.DISTANCES, _DIST, cols, self.errors, ("a", "b"))

    def _match(self, other, matrix, measure, threshold, order) -> Column:
        o = other.column if isinstance(other, Accessor) else other
        cols = {"a": self.column, "b": o, "threshold": _col(threshold).cast("double"), "order": F.lit(None).cast("array<int>") if order is None else order}

        def one(a, b, threshold, order):
            x, y = C.from_value(a), C.from_value(b)
            return C.greedy(matrix(x, y), len(y), threshold, order)

        def batch(a, b, threshold, order):
            if measure is None or threshold.null_count or order.null_count < len(order):
                return None
            got = B.met(a, b, measure, (measure.__name__, measure.reach))
            return None if got is None else B.greedy(*got, threshold.to_numpy(), _MATCH)

        return rows(one, A.CORRESPONDENCE, _MATCH, cols, self.errors, ("a", "b", "threshold"), batch)

    def pairwise_iou(self, other) -> Column:
        o = other.column if isinstance(other, Accessor) else other

        def batch(a, b):
            got = B.met(a, b, B.iou, (B.iou.__name__, B.iou.reach))
            return None if got is None else B.nested(got[0], got[2], got[3])

        return rows(lambda a, b: C.pairwise(C.from_value(a), C.from_value(b)), "array<array<double>>", pa.list_(pa.list_(_NUMBER)), {"a": self.column, "b": o}, self.errors, batch=batch)

    def correspond(self, other, threshold=0.5, order: Column | None = None) -> Column:
        return self._match(other, C.pairwise, B.iou, threshold, order)

    def correspond_by_coverage(self, other, tolerance: float, threshold=0.5, order: Column | None = None, sample_step: float | None = None) -> Column:
        return self._match(other, lambda a, b: [[C.coverage(t, c, tolerance, sample_step) for t in b] for c in a], None if sample_step else B.coverage(tolerance), threshold, order)

    def label_reduce(self, image: Column, reduction: str = "max", region_mode: str = "interior") -> Column:
        """Scores of the contours over an image column (blob, image bytes, tensor or nested list)."""
        many, f, open_ = self.many, OPERATORS["label_reduce"].run, A.reader("auto", {})

        def run(shapes, images):
            get, out = open_(images), []
            for i, c in enumerate(A.whole(shapes).to_pylist()):
                x = get(i)
                v = None if c is None or x is None else f(x, C.from_value(c), reduction, region_mode).tolist()
                out.append(v if many or v is None else v[0])
            return pa.array(out, pa.list_(_NUMBER) if many else _NUMBER)

        return F.arrow_udf(run, "array<double>" if many else "double")(self.column, image)


def contour_from_coords(ring: Column, holes: Column | None = None, is_closed: bool = True) -> Column:
    """From a list of [x, y] pairs (and a list of such lists)."""
    pts = lambda r: F.transform(r, lambda p: G.point(p[0], p[1]))
    inner = F.array().cast(f"array<array<{A.POINT}>>") if holes is None else F.transform(holes, pts)
    return F.when(ring.isNotNull(), F.struct(pts(ring).alias("exterior"), inner.alias("holes"), F.lit(is_closed).alias("is_closed")))


def contour_set_from_coords(rings: Column) -> Column:
    return F.transform(rings, lambda r: contour_from_coords(r))


def mask_iou(a: Column, b: Column) -> Column:
    """Of two flat 0/1 arrays: both over either, with 1e-7 added below."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("double")), F.lit(0.0), lambda s, v: s + v)
    one = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) | (y > 0)).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return both / (one + 1e-7)


def mask_dice(a: Column, b: Column) -> Column:
    both = F.aggregate(F.zip_with(a, b, lambda x, y: ((x > 0) & (y > 0)).cast("double")), F.lit(0.0), lambda s, v: s + v)
    count = lambda m: F.aggregate(F.transform(m, lambda x: (x > 0).cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 2 * both / (count(a) + count(b) + 1e-7)


def region_stats(regions: Column, maps: dict[str, tuple[Column, str]]) -> Column:
    """Struct of lists: for each name the reduction of an image over every region."""
    return F.struct(*[contour(regions, many=True).label_reduce(image, reduction=how).alias(name) for name, (image, how) in maps.items()])


def validate_point(p: dict) -> bool:
    return isinstance(p, dict) and all(isinstance(p.get(k), (int, float)) for k in ("x", "y"))


def validate_contour(c: dict) -> bool:
    return isinstance(c, dict) and isinstance(c.get("exterior"), list) and all(validate_point(p) for r in [c["exterior"], *(c.get("holes") or [])] for p in r)


def contour_from_points(points: list, holes: list | None = None, is_closed: bool = True) -> dict:
    """The struct of a contour from (x, y) pairs."""
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    return {"exterior": ring(points), "holes": [ring(h) for h in holes or []], "is_closed": is_closed}


def tagged(column: Column, name: str, kind: str) -> Column:
    """The column under a name, with what it holds (ndarray, point, contour or bbox) as metadata."""
    if kind not in ("ndarray", "point", "contour", "bbox"):
        raise ValueError(f"tag {kind!r} is none of ndarray, point, contour, bbox")
    return column.alias(name, metadata={"rasterloom": kind})
