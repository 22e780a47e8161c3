"""Boxes, polygons and quadrilaterals as native expressions; y points down.

A point is struct(x, y), a polygon an array of points, a box an array of
x0, y0, x1, y1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkledger.functions.text import let


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_polygon(box: Column) -> Column:
    return F.array(point(box[0], box[1]), point(box[2], box[1]), point(box[2], box[3]), point(box[0], box[3]))


def box_area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def box_intersection(a: Column, b: Column) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    """0 where the union is empty."""
    both = box_intersection(a, b)
    return F.coalesce(F.try_divide(both, box_area(a) + box_area(b) - both), F.lit(0.0))


def box_cover(box: Column, target: Column) -> Column:
    """Share of the target inside the box."""
    return F.coalesce(F.try_divide(box_intersection(box, target), box_area(target)), F.lit(0.0))


def scale_box(box: Column, wide: Column, high: Column) -> Column:
    return F.array(box[0] * wide, box[1] * high, box[2] * wide, box[3] * high)


def normalize_box(box: Column, wide: Column, high: Column) -> Column:
    return F.array(box[0] / wide, box[1] / high, box[2] / wide, box[3] / high)


def clip_box(box: Column, wide: Column, high: Column) -> Column:
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return F.array(inside(box[0], wide), inside(box[1], high), inside(box[2], wide), inside(box[3], high))


def crop_window(box: Column, wide: Column, high: Column) -> Column:
    """Whole pixels around a box: a margin of 6 or 15% of its height, clipped."""
    margin = F.greatest(F.lit(6.0), 0.15 * (box[3] - box[1]))
    low = lambda v: F.greatest(F.floor(v - margin), F.lit(0)).cast("int")
    top = lambda v, most: F.least(F.ceil(v + margin), most).cast("int")
    return F.array(low(box[0]), low(box[1]), top(box[2], wide), top(box[3], high))


def half_turn_box(box: Column, wide: Column, high: Column) -> Column:
    return F.array(wide - box[2], high - box[3], wide - box[0], high - box[1])


def following(points: Column) -> Column:
    """Each point's successor, the first one after the last."""
    return F.transform(points, lambda p, i: F.get(points, (i + 1) % F.size(points)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def signed_area(points: Column) -> Column:
    """Positive for clockwise as seen with y down."""
    return let(points, lambda ps: total(F.zip_with(ps, following(ps), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2)


def polygon_area(points: Column) -> Column:
    return F.abs(signed_area(points))


def clip_half(points: Column, keep, cross) -> Column:
    """The part of a polygon where keep(point) >= 0."""

    def edge(p: Column, q: Column) -> Column:
        def joined(k: Column) -> Column:
            met = F.array(cross(p, q, k[0] / F.nullif(k[0] - k[1], F.lit(0.0))))
            return F.when((k[0] >= 0) & (k[1] >= 0), F.array(q)).when((k[0] >= 0) & (k[1] < 0), met).when((k[0] < 0) & (k[1] >= 0), F.concat(met, F.array(q))).otherwise(F.slice(F.array(q), 1, 0))

        return let(F.array(keep(p), keep(q)), joined)

    return let(points, lambda ps: F.flatten(F.zip_with(ps, following(ps), edge)))


def between(p: Column, q: Column, share: Column) -> Column:
    return point(p["x"] + (q["x"] - p["x"]) * share, p["y"] + (q["y"] - p["y"]) * share)


def clip_to_frame(points: Column, wide: Column, high: Column) -> Column:
    """A polygon inside the frame 0, 0, wide, high."""
    for keep in (lambda p: p["x"], lambda p: wide - p["x"], lambda p: p["y"], lambda p: high - p["y"]):
        points = clip_half(points, keep, between)
    return points


def clip_convex(points: Column, quad: Column) -> Column:
    """A polygon inside a convex quadrilateral of either winding."""
    for k in range(4):

        def side(p: Column, k: int = k) -> Column:
            a, b = quad[k], quad[(k + 1) % 4]
            return F.signum(signed_area(quad)) * ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))

        points = clip_half(points, side, between)
    return points


def quad_intersection(a: Column, b: Column) -> Column:
    return polygon_area(clip_convex(a, b))


def quad_iou(a: Column, b: Column) -> Column:
    """Of convex quadrilaterals; 0 where either has no area."""
    both = quad_intersection(a, b)
    return F.coalesce(F.try_divide(both, polygon_area(a) + polygon_area(b) - both), F.lit(0.0))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def side_lengths(quad: Column) -> Column:
    return F.zip_with(quad, following(quad), distance)


def short_side(quad: Column) -> Column:
    """The lesser mean of opposite sides."""
    s = side_lengths(quad)
    return F.least((s[0] + s[2]) / 2, (s[1] + s[3]) / 2)


def long_side(quad: Column) -> Column:
    s = side_lengths(quad)
    return F.greatest((s[0] + s[2]) / 2, (s[1] + s[3]) / 2)


def centre(points: Column) -> Column:
    mean = lambda k: total(F.transform(points, lambda p: p[k])) / F.size(points)
    return point(mean("x"), mean("y"))


def bounds(points: Column) -> Column:
    def box(ps: Column) -> Column:
        xs, ys = F.transform(ps, lambda p: p["x"]), F.transform(ps, lambda p: p["y"])
        return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

    return let(points, box)


def is_convex(quad: Column) -> Column:
    """All turns of one sign."""
    after = following(quad)
    ahead = following(after)
    legs = F.zip_with(quad, after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    turns = F.zip_with(legs, ahead, lambda s, r: (s["q"]["x"] - s["p"]["x"]) * (r["y"] - s["q"]["y"]) - (s["q"]["y"] - s["p"]["y"]) * (r["x"] - s["q"]["x"]))
    return F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)


def clockwise(quad: Column) -> Column:
    """Corners by angle about the centre, from the upper left."""
    middle = centre(quad)
    keyed = F.transform(quad, lambda p: F.struct(F.pmod(F.atan2(p["y"] - middle["y"], p["x"] - middle["x"]) + math.pi, F.lit(2 * math.pi)).alias("angle"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def in_frame(points: Column, wide: Column, high: Column) -> Column:
    return F.transform(points, lambda p: p["x"].between(0, wide) & p["y"].between(0, high))


def best_shift(pred: Column, truth: Column, mask: Column) -> Column:
    """struct(mean, shift, max) of the cyclic shift with the least mean corner distance over masked corners; ties to the smaller shift."""

    def shifted(k: int) -> Column:
        turned = F.array(*[pred[(i + k) % 4] for i in range(4)])
        away = F.zip_with(turned, truth, distance)
        seen = F.filter(away, lambda d, i: F.get(mask, i))
        return F.struct((total(seen) / F.nullif(F.size(seen), F.lit(0))).alias("mean"), F.lit(k).alias("shift"), F.array_max(seen).alias("max"))

    return F.when(F.exists(mask, lambda m: m), F.array_min(F.array(*[shifted(k) for k in range(4)])))


def rotation_degrees(quad: Column) -> Column:
    """Clockwise angle of the top side."""
    return F.pmod(F.degrees(F.atan2(quad[1]["y"] - quad[0]["y"], quad[1]["x"] - quad[0]["x"])), F.lit(360.0))


def orientation_class(degrees: Column) -> Column:
    return ((F.bround(degrees / 90).cast("int") % 4) * 90).cast("int")


def apply_homography(h: Column, p: Column) -> Column:
    """A point under a row-major 3 by 3 homography."""
    w = h[6] * p["x"] + h[7] * p["y"] + h[8]
    return point((h[0] * p["x"] + h[1] * p["y"] + h[2]) / w, (h[3] * p["x"] + h[4] * p["y"] + h[5]) / w)


def letterbox(wide: Column, high: Column, side: float) -> Column:
    """(scale, dx, dy) that fits an image into a square, centred."""
    scale = F.least(side / wide, side / high)
    return F.struct(scale.alias("scale"), ((side - wide * scale) / 2).alias("dx"), ((side - high * scale) / 2).alias("dy"))


def invert_letterbox(fit: Column, p: Column) -> Column:
    return point((p["x"] - fit["dx"]) / fit["scale"], (p["y"] - fit["dy"]) / fit["scale"])


def keypoints(quad: Column, wide: Column, high: Column) -> Column:
    """x, y, 2 of corners in the frame, else 0, 0, 0."""
    one = lambda p: F.when(p["x"].between(0, wide) & p["y"].between(0, high), F.array(p["x"], p["y"], F.lit(2.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return F.flatten(F.transform(quad, one))


def sigmoid(logit: Column) -> Column:
    held = F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))
    return 1 / (1 + F.exp(-held))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
