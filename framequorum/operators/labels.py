"""Label sources of five shapes made one table, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions.text import label_text

CORNERS = ("tl_x", "tl_y", "tr_x", "tr_y", "br_x", "br_y", "bl_x", "bl_y")
COLUMNS = ("image", "plate_text", *CORNERS)
POLYGON = "array<struct<points: array<array<double>>, original_width: int, original_height: int>>"


def quad_of(prefix: str = "") -> G.Quad:
    return tuple((F.col(f"{prefix}{c}_x"), F.col(f"{prefix}{c}_y")) for c in ("tl", "tr", "br", "bl"))


def has_quad() -> Column:
    return F.greatest(*[F.abs(F.col(c)) for c in CORNERS]) > 0


def has_plate(text: Column) -> Column:
    return F.coalesce(~label_text(text).isin("no_plate", ""), F.lit(False))


def has_text(text: Column) -> Column:
    return F.coalesce(~label_text(text).isin("no_plate", "unreadable", ""), F.lit(False))


def open_polygon(points: Column) -> Column:
    """Without a closing point that repeats the first, if there are more than four."""
    near = (F.abs(points[0][0] - F.element_at(points, -1)[0]) < 1e-6) & (F.abs(points[0][1] - F.element_at(points, -1)[1]) < 1e-6)
    return F.when((F.size(points) > 4) & near, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def from_pixels(rows: DataFrame) -> DataFrame:
    """Rows that already have corner columns; no plate means no corners."""
    text = label_text(F.col("plate_text"))
    return rows.select("image", text.alias("plate_text"), *[F.when(text == "no_plate", 0).otherwise(F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).cast("int")).alias(c) for c in CORNERS])


def from_polygons(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a JSON polygon in percent of the picture, put into pixels and corner order."""
    parsed = rows.withColumn("_l", F.from_json(F.col(label), POLYGON)[0]).withColumn("_p", open_polygon(F.col("_l.points")))
    points = [((F.col("_p")[i][0] / 100 * F.col("_l.original_width")), (F.col("_p")[i][1] / 100 * F.col("_l.original_height"))) for i in range(4)]
    parsed = parsed.withColumn("_q", F.when(F.size("_p") >= 4, G.corner_order(points)))
    corner = [F.coalesce(F.round(F.col("_q")[i][axis]).cast("int"), F.lit(0)).alias(name) for (i, axis), name in zip([(i, a) for i in range(4) for a in "xy"], CORNERS, strict=True)]
    return from_pixels(parsed.select("image", "plate_text", *corner))


def from_percent(rows: DataFrame, width: str, height: str) -> DataFrame:
    """Rows with corners in percent of a known picture size."""
    scaled = [(F.col(c) / 100 * F.col(width if c.endswith("x") else height)).alias(c) for c in CORNERS]
    return from_pixels(rows.select("image", "plate_text", *scaled))


def unified(*sources: DataFrame) -> DataFrame:
    """One table of all sources; repeated images stay, for the checks to find."""
    out = sources[0].select(*COLUMNS)
    for s in sources[1:]:
        out = out.unionByName(s.select(*COLUMNS))
    return out


def problems(rows: DataFrame, width: str, height: str) -> DataFrame:
    """Per check: how many rows fail it, and PASS or FAIL."""
    q = quad_of()
    inside = F.lit(True)
    for x, y in q:
        inside = inside & x.between(0, F.col(width)) & y.between(0, F.col(height))
    plate = has_plate(F.col("plate_text"))
    checks = {"out_of_bounds": plate & ~inside, "not_convex": plate & ~G.convex_within(q), "no_plate_with_corners": ~plate & has_quad(), "plate_without_corners": plate & ~has_quad()}
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in checks]))
    return counts.select(stacked.alias("r")).select("r.check", "r.failures", F.when(F.col("r.failures") == 0, "PASS").otherwise("FAIL").alias("verdict"))


def ccpd_fields(name: Column) -> Column:
    """Struct of what a CCPD file name says: tilt, box, corners (TL, TR, BR, BL), brightness and blur; null unless it has 7 parts of numbers."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "-")
    number = lambda c: c.try_cast("int")
    pair = lambda c: F.split(c, "&")
    tilt, box, corners = F.split(parts[1], "_"), F.split(parts[2], "_"), F.split(parts[3], "_")
    order = (2, 3, 0, 1)
    points = F.array(*[F.struct(number(pair(corners[i])[0]).alias("x"), number(pair(corners[i])[1]).alias("y")) for i in order])
    whole = name.rlike(r"^[^-]*-\d+_\d+-\d+&\d+_\d+&\d+-\d+&\d+_\d+&\d+_\d+&\d+_\d+&\d+-[^-]*-\d+-\d+\.[^.]*$")
    fields = F.struct(number(tilt[0]).alias("tilt_h"), number(tilt[1]).alias("tilt_v"), number(pair(box[0])[0]).alias("x1"), number(pair(box[0])[1]).alias("y1"), number(pair(box[1])[0]).alias("x2"), number(pair(box[1])[1]).alias("y2"), points.alias("corners"), number(parts[5]).alias("bright"), number(parts[6]).alias("blur"))
    return F.when(whole, fields)


def label_line(line: Column) -> Column:
    """``kind`` of a label line by its numbers: box (5), pose (17), polygon (odd, at least 9), else bad; and the numbers."""
    numbers = F.transform(F.split(F.trim(line), r"\s+"), lambda p: p.try_cast("double"))
    n = F.size(numbers)
    whole = ~F.exists(numbers, lambda x: x.isNull())
    kind = F.when(whole & (n == 5), "box").when(whole & (n == 17), "pose").when(whole & (n >= 9) & (n % 2 == 1), "polygon").otherwise("bad")
    return F.struct(kind.alias("kind"), numbers.alias("numbers"))


def province_codes(text: DataFrame, column: str = "value") -> DataFrame:
    """Distinct two-digit codes of lines separated by commas or white space."""
    tokens = text.select(F.explode(F.split(column, r"[,\s]+")).alias("code"))
    return tokens.where(F.col("code").rlike("^[0-9]{2}$")).distinct()
