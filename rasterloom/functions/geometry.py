"""Points and boxes as native column expressions. A point has x and y; a box has x, y, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0)))


def bbox(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def bbox_from_coords(a: Column, b: Column, c: Column, d: Column, form: str = "xyxy") -> Column:
    """Corner pairs (xyxy), corner and size (xywh), or centre and size (cxcywh)."""
    if form == "xyxy":
        return bbox(a, b, c - a, d - b)
    if form == "cxcywh":
        return bbox(a - c / 2, b - d / 2, c, d)
    return bbox(a, b, c, d)


def bbox_area(a: Column) -> Column:
    return a["width"] * a["height"]


def bbox_center(a: Column) -> Column:
    return point(a["x"] + a["width"] / 2, a["y"] + a["height"] / 2)


def bbox_overlap(a: Column, b: Column) -> Column:
    """Area that both boxes cover."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = bbox_overlap(a, b)
    union = bbox_area(a) + bbox_area(b) - both
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(0.0)


def bbox_contains(a: Column, p: Column) -> Column:
    return (p["x"] >= a["x"]) & (p["x"] <= a["x"] + a["width"]) & (p["y"] >= a["y"]) & (p["y"] <= a["y"] + a["height"])


def _around(ring, term) -> tuple[Column, Column]:
    """The size of a ring and the sum of term(point, next point) around it. The ring is an array column, or the list of
    its points: then the sum is written out, and Spark compiles it instead of building the array for every element."""
    if isinstance(ring, list):
        total = F.lit(0.0)
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            total = term(total, p, q)
        return F.lit(len(ring)), total
    n = F.size(ring)
    return n, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: term(s, ring[i], ring[(i + 1) % n]))


def _turn(s: Column, p: Column, q: Column) -> Column:
    return s + p["x"] * q["y"] - q["x"] * p["y"]


def polygon_area(ring: Column | list) -> Column:
    """Of an implicitly closed array (or list) of points, by the shoelace sum."""
    n, turn = _around(ring, _turn)
    return F.when(n < 3, 0.0).otherwise(F.abs(turn) / 2)


def polygon_perimeter(ring: Column | list) -> Column:
    n, length = _around(ring, lambda s, p, q: s + point_distance(p, q))
    return F.when(n < 2, 0.0).otherwise(length)


def point_manhattan_distance(a: Column, b: Column) -> Column:
    return F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])


def point_translate(a: Column, dx, dy) -> Column:
    return point(a["x"] + dx, a["y"] + dy)


def point_scale(a: Column, sx, sy) -> Column:
    return point(a["x"] * sx, a["y"] * sy)


def point_normalize(a: Column, width, height) -> Column:
    return point(a["x"] / width, a["y"] / height)


def point_angle_to(a: Column, b: Column) -> Column:
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


def point_rotate(a: Column, angle: float, origin: Column | None = None) -> Column:
    """By radians about the origin or a point."""
    angle = angle if isinstance(angle, Column) else F.lit(float(angle))
    c, s = F.cos(angle), F.sin(angle)
    ox, oy = (F.lit(0.0), F.lit(0.0)) if origin is None else (origin["x"], origin["y"])
    dx, dy = a["x"] - ox, a["y"] - oy
    return point(ox + dx * c - dy * s, oy + dx * s + dy * c)


def point_interpolate(a: Column, b: Column, t=0.5) -> Column:
    """The midpoint by default."""
    return point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)


def bbox_to_coords(a: Column, form: str = "xyxy") -> Column:
    x, y, w, h = a["x"], a["y"], a["width"], a["height"]
    return F.array(*{"xyxy": (x, y, x + w, y + h), "xywh": (x, y, w, h), "cxcywh": (x + w / 2, y + h / 2, w, h)}[form])


def bbox_corners(a: Column) -> list[Column]:
    x, y, w, h = a["x"], a["y"], a["width"], a["height"]
    return [point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)]


def bbox_to_ring(a: Column) -> Column:
    return F.array(*bbox_corners(a))


def bbox_translate(a: Column, dx, dy) -> Column:
    return bbox(a["x"] + dx, a["y"] + dy, a["width"], a["height"])


def bbox_scale(a: Column, sx, sy) -> Column:
    """About the origin; factors from 0 up."""
    return bbox(a["x"] * sx, a["y"] * sy, a["width"] * sx, a["height"] * sy)


def bbox_expand(a: Column, factor) -> Column:
    """About its centre."""
    w, h = a["width"] * factor, a["height"] * factor
    return bbox(a["x"] + (a["width"] - w) / 2, a["y"] + (a["height"] - h) / 2, w, h)


def bbox_pad(a: Column, amount) -> Column:
    """By the amount on every side; a shrink past zero is refused."""
    w, h = a["width"] + 2 * amount, a["height"] + 2 * amount
    kind = "struct<x:double,y:double,width:double,height:double>"
    return F.when((w >= 0) & (h >= 0), bbox(a["x"] - amount, a["y"] - amount, w, h)).when(a.isNull() | w.isNull() | h.isNull(), None).otherwise(F.raise_error(F.lit("a box shrinks below nothing")).cast(kind))


def bbox_clip(a: Column, width, height) -> Column:
    """The part inside the image; a box outside shrinks to size 0 on the nearest edge."""
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), (top if isinstance(top, Column) else F.lit(top)).cast("double"))
    x, y = inside(a["x"], width), inside(a["y"], height)
    return bbox(x, y, inside(a["x"] + a["width"], width) - x, inside(a["y"] + a["height"], height) - y)


def ring_signed_area(ring: Column | list) -> Column:
    n, turn = _around(ring, _turn)
    return F.when(n < 3, 0.0).otherwise(turn / 2)


def ring_bounding_box(ring: Column | list) -> Column:
    if isinstance(ring, list):
        xs, ys = F.array(*[p["x"] for p in ring]), F.array(*[p["y"] for p in ring])
    else:
        xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def ring_translate(ring: Column, dx, dy) -> Column:
    return F.transform(ring, lambda p: point_translate(p, dx, dy))
