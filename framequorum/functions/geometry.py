"""Boxes and quadrilaterals as column expressions. A box is (x1, y1, x2, y2), a quad TL, TR, BR, BL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Box = tuple[Column, Column, Column, Column]
Quad = tuple[tuple[Column, Column], ...]


def finite(c: Column, default: float = 0.0) -> Column:
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(float(default))).otherwise(d)


def area(box: Box) -> Column:
    x1, y1, x2, y2 = box
    return F.greatest(x2 - x1, F.lit(0)) * F.greatest(y2 - y1, F.lit(0))


def canonical(box: Box) -> Box:
    """Corners in order, rounded half to even."""
    x1, y1, x2, y2 = (F.bround(c.cast("double"), 0).cast("int") for c in box)
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def clipped(box: Box, width: int, height: int) -> Box:
    """Rounded and held inside the picture, at least one pixel wide and high; NaN and infinity count as 0."""
    x1, y1, x2, y2 = (F.bround(finite(c), 0).cast("int") for c in box)
    left, top = F.greatest(F.lit(0), F.least(x1, F.lit(width - 1))), F.greatest(F.lit(0), F.least(y1, F.lit(height - 1)))
    right, bottom = F.greatest(left + 1, F.least(x2, F.lit(width))), F.greatest(top + 1, F.least(y2, F.lit(height)))
    return left, top, right, bottom


def expanded(box: Box, margin: float, width: int, height: int) -> Box:
    x1, y1, x2, y2 = box
    dx, dy = (x2 - x1) * F.lit(float(margin)), (y2 - y1) * F.lit(float(margin))
    return clipped((x1 - dx, y1 - dy, x2 + dx, y2 + dy), width, height)


def lower_part(box: Box, ratio: float) -> Box:
    """Where a plate is expected in a vehicle: the lowest ``ratio`` of its box."""
    x1, y1, x2, y2 = box
    ratio = min(1.0, max(0.0, ratio))
    if ratio >= 1.0:
        return box
    part = F.greatest(F.lit(1), F.bround((y2 - y1) * F.lit(ratio), 0).cast("int"))
    return x1, F.greatest(y1, y2 - part), x2, y2


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, (w * h) / union.cast("double")).otherwise(F.lit(0.0))


def containment(vehicle: Box, plate: Box) -> Column:
    """IoU, and 1 more if the plate's centre lies in the vehicle."""
    cx, cy = (plate[0] + plate[2]) / F.lit(2.0), (plate[1] + plate[3]) / F.lit(2.0)
    inside = cx.between(vehicle[0], vehicle[2]) & cy.between(vehicle[1], vehicle[3])
    return iou(vehicle, plate) + F.when(inside, 1.0).otherwise(0.0)


def corner_picks(points: list[tuple[Column, Column]]) -> dict[str, Column]:
    """The points of least and largest x + y (tl, br), largest and least x - y (tr, bl).

    Each is a struct (k, i, x, y) of its key, which is least, its place and itself; the first of
    equal points counts.
    """

    def pick(key, sign: int) -> Column:
        return F.array_min(F.array(*[F.struct((sign * key(x, y)).alias("k"), F.lit(i).alias("i"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(points)]))

    return {"tl": pick(lambda x, y: x + y, 1), "tr": pick(lambda x, y: x - y, -1), "br": pick(lambda x, y: x + y, -1), "bl": pick(lambda x, y: x - y, 1)}


def corner_order(points: list[tuple[Column, Column]]) -> Column:
    """TL, TR, BR, BL of four points as an array of (x, y), as picked by ``corner_picks``."""
    return F.array(*[F.struct(p["x"].alias("x"), p["y"].alias("y")) for p in corner_picks(points).values()])


def _turns(q: Quad) -> list[Column]:
    out = []
    for i in range(4):
        (ax, ay), (bx, by), (cx, cy) = q[i], q[(i + 1) % 4], q[(i + 2) % 4]
        out.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return out


def convex(q: Quad) -> Column:
    """All corners turn the same way; three in a line do not count."""
    turns = _turns(q)
    return (F.least(*turns) > 0) | (F.greatest(*turns) < 0)


def convex_within(q: Quad, tolerance: float = 1e-6) -> Column:
    """As convex, but corners may be flat."""
    turns = _turns(q)
    return (F.least(*turns) >= -tolerance) | (F.greatest(*turns) <= tolerance)


def shoelace(q: Quad) -> Column:
    total = sum((q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(4)), F.lit(0))
    return F.abs(total) / F.lit(2.0)


def bounding(q: Quad) -> Box:
    xs, ys = [x for x, _ in q], [y for _, y in q]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def as_quad(box: Box) -> Quad:
    x1, y1, x2, y2 = box
    return (x1, y1), (x2, y1), (x2, y2), (x1, y2)


def angle(q: Quad) -> Column:
    """Degrees of the upper edge."""
    return F.degrees(F.atan2((q[1][1] - q[0][1]).cast("double"), (q[1][0] - q[0][0]).cast("double")))


def band(degrees: Column) -> Column:
    a = F.abs(degrees)
    return F.when(a < 5, "<5").when(a < 15, "5-15").otherwise(">15")


def corner_error(a: Quad, b: Quad) -> Column:
    """Mean distance of corresponding corners."""
    return sum((F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) for (ax, ay), (bx, by) in zip(a, b, strict=True)), F.lit(0.0)) / F.lit(4.0)


def to_state(box: Box) -> Box:
    """Centre, area and aspect ratio, as a tracker keeps them."""
    w, h = (F.greatest((box[i + 2] - box[i]).cast("double"), F.lit(1e-3)) for i in (0, 1))
    return box[0] + w / 2, box[1] + h / 2, F.greatest(w * h, F.lit(1e-6)), F.greatest(w / h, F.lit(1e-6))


def from_state(u: Column, v: Column, s: Column, r: Column) -> Box:
    w = F.sqrt(F.greatest(s, F.lit(1e-6)) * F.greatest(r, F.lit(1e-6)))
    h = F.when(w > 1e-9, F.greatest(s, F.lit(1e-6)) / w).otherwise(1e-3)
    return u - w / 2, v - h / 2, u + w / 2, v + h / 2


def box_line(points: list[tuple[Column, Column]], kind: Column) -> Column:
    """``class cx cy w h`` of a polygon in relative units, 6 decimals."""
    xs, ys = [x for x, _ in points], [y for _, y in points]
    x1, x2, y1, y2 = F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)
    return F.format_string("%d %.6f %.6f %.6f %.6f", kind, (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1)


def pose_line(q: Quad, width: Column, height: Column) -> Column:
    """``0 cx cy w h`` and ``x y 2`` of each corner, relative, held in [0, 1], 6 decimals."""
    unit = lambda c, n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / n.cast("double")))
    x1, y1, x2, y2 = bounding(q)
    box = [unit((x1 + x2) / 2, width), unit((y1 + y2) / 2, height), unit(x2 - x1, width), unit(y2 - y1, height)]
    corners = [c for x, y in q for c in (unit(x, width), unit(y, height))]
    return F.format_string("0 %.6f %.6f %.6f %.6f" + " %.6f %.6f 2" * 4, *box, *corners)


def pose_values(line: Column) -> Column:
    """The numbers of a pose line; null unless there are 17."""
    parts = F.split(F.trim(line), r"\s+")
    return F.when(F.size(parts) == 17, F.transform(parts, lambda p: p.try_cast("double")))
