from framequorum.config import BestFrameRules, FrameRules
from framequorum.operators import frames as FR, labels as L, tracks as TR
from pyspark.sql import functions as F


def test_kept_frames(spark):
    dark, blurry = {10, 11, 40}, {20, 21, 50}
    rows = [("v", i, 10.0 if i in dark else 120.0, 5.0 if i in blurry else 300.0) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id string, frame_index long, brightness double, blur_score double")
    kept = sorted(r.frame_index for r in FR.kept(df, FrameRules(interval=5), 30.0).collect())
    assert kept == [i for i in range(0, 60, 5) if i not in dark | blurry]
    assert FR.kept(df, FrameRules(interval=5, max_frames=3), 30.0).count() == 3
    assert FR.kept(df.limit(0), FrameRules(), 30.0).count() == 0
    s = FR.extraction_stats(df, FrameRules(interval=5), 30.0).first()
    assert (s.scanned, s.sampled, s.dark, s.blurry, s.kept) == (60, 12, 2, 2, 8)


def test_frame_gap():
    assert [BestFrameRules().gap(n) for n in (0, 1, 5)] == [2, 2, 10] and BestFrameRules(min_frame_gap=3).gap(5) == 3


def _filled(spark, values):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "track_id long, ord long, v double")
    return [r.v for r in TR.interpolated(df, "v").orderBy("ord").collect()]


def test_interpolation(spark):
    assert _filled(spark, [0.0, None, 10.0]) == [0, 5, 10]
    assert _filled(spark, [None, 4.0, None]) == [4, 4, 4]
    assert _filled(spark, [None, None]) == [0, 0]


def test_split_keeps_groups_whole_and_is_stable(spark):
    g = spark.range(100).withColumnRenamed("id", "track_id")
    a, b = ({r.track_id: r.split for r in TR.split_by_group(g, "track_id", 0.2).collect()} for _ in range(2))
    assert a == b and sum(v == "val" for v in a.values()) == 20


def test_sequence_numbers(spark):
    df = spark.createDataFrame([(t, r) for t in (3, 1) for r in (2, 1)], "track_id long, rank long")
    assert [(r.image, r.track_id, r["rank"]) for r in TR.numbered(df, "track_id", "rank").orderBy("image").collect()] == [("000001.jpg", 1, 1), ("000002.jpg", 1, 2), ("000003.jpg", 3, 1), ("000004.jpg", 3, 2)]


def test_ranks_over_many_parts(spark):
    """Repeated and missing keys, more parts than cores, and long numbers keep their digits."""
    keys = [None, *range(200), *[7] * 50]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(5)
    got = sorted((r._place, r.k) for r in TR.ranked(df, "k", "i").collect())
    assert [p for p, _ in got] == list(range(1, 252)) and [k for _, k in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    before = {r.k: (r._before, r._n) for r in TR.counts_before(df, "k").collect()}
    assert before == {k: (sum((x is not None, x or 0) < (k is not None, k or 0) for x in keys), keys.count(k)) for k in keys}
    assert {len(r.image) for r in TR.numbered(df, "k", "i", digits=2).collect()} == {6, 7}
    assert TR.ranked(df.limit(0), "k").count() == 0


def test_budget_ends_within_a_track(spark):
    rows = [(t, o) for t in (None, 3, 1, 2) for o in range(5)]
    df = spark.createDataFrame(rows, "track_id long, ord long")
    for most in (0, 5, 12, 99):
        want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:most]
        assert sorted(map(repr, map(tuple, TR.budgeted(df, most).collect()))) == sorted(map(repr, want))


def test_values_at_places(spark):
    """One band with nearly all rows, many equal values, nulls, a band of nulls, and one without a name."""
    import random

    from framequorum.operators import evaluate as E

    rng = random.Random(4)
    rows = [("a", float(rng.randrange(40))) for _ in range(900)] + [("a", None), ("b", 2.5), ("c", None), (None, 1.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "band string, v double").repartition(6)
    got = {r.band: (r.p95, r.median) for r in E.nearest_ranks(df, "band", "v", p95=0.95, median=0.5).collect()}
    values = {b: sorted(v for x, v in rows if x == b and v is not None) for b in ("a", "b", None)}
    assert got == {b: tuple(v[min(len(v) - 1, int(len(v) * q))] for q in (0.95, 0.5)) for b, v in values.items()}
    total = {r.band: (r.n, r.detected, r.p90) for r in E.banded(df, F.col("v"), F.col("v") > 3).collect()}
    assert set(total) == {"a", "b", "c", None, "all"} and total["c"] == (1, 0, None) and total["all"][0] == len(rows)
    import numpy as np

    assert abs(total["a"][2] - np.percentile([v for v in values["a"] if v > 3], 90)) < 1e-9


def test_ccpd_names(spark):
    good = "025-95_113-154&383_386&473-386&473_177&454_154&383_363&402-0_0_22_27_27_33_16-37-15.jpg"
    rows = spark.createDataFrame([(good,), ("nonsense.jpg",), (None,)], "n string").select(L.ccpd_fields(F.col("n")).alias("f")).collect()
    f = rows[0].f
    assert (f.tilt_h, f.tilt_v, f.x1, f.y2, f.bright, f.blur) == (95, 113, 154, 473, 37, 15)
    assert [tuple(p) for p in f.corners] == [(154, 383), (363, 402), (386, 473), (177, 454)] and rows[1].f is None and rows[2].f is None


def test_quality_checks_find_what_is_wrong(spark):
    cols = "image string, plate_text string, " + ", ".join(f"{c} int" for c in L.CORNERS) + ", w int, h int"
    ok = (1, 1, 50, 1, 50, 20, 1, 20, 100, 40)
    rows = [("a", "51F12345", *ok), ("b", "51F12345", *(0,) * 8, 100, 40), ("c", "no_plate", *ok), ("d", "51F12345", 1, 1, 500, 1, 50, 20, 1, 20, 100, 40), ("e", "51F12345", 1, 1, 1, 20, 50, 1, 50, 20, 100, 40)]
    got = {r.check: r.failures for r in L.problems(spark.createDataFrame(rows, cols), "w", "h").collect()}
    assert got == {"out_of_bounds": 1, "not_convex": 1, "no_plate_with_corners": 1, "plate_without_corners": 1}
