import pytest

import random

from framequorum.config import BestFrameRules
from framequorum.operators import topk
from framequorum.operators.topk import add_crop


def loop(rows, k, gap):
    """The rule word for word, on its own: it shares no step with the operator."""
    kept = []
    for frame, real, score, ord_ in rows:
        if real:
            kept = [r for r in kept if r[1]]
        elif any(r[1] for r in kept):
            continue
        rivals = [r for r in kept if abs(r[0] - frame) < gap]
        if rivals and max(r[2] for r in rivals) >= score:
            continue
        for r in rivals:
            kept.remove(r)
        if len(kept) == k:
            low = min(r[2] for r in kept)
            if low >= score:
                continue
            kept.remove(next(r for r in kept if r[2] == low))
        kept.append((frame, real, score, ord_))
    return sorted(kept, key=lambda r: (-r[1], -r[2]))


def test_fold_matches_a_loop(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for track in range(60):
        frame, mine = 0, []
        for o in range(rng.randrange(1, 25)):
            frame += rng.randrange(1, 9)
            mine.append((frame, rng.random() < 0.6, rng.randrange(6) / 5, o))
        rows += [(track, f, s, "detection" if d else "fallback", o) for f, d, s, o in mine]
        want[track] = [(f, o) for f, _, _, o in loop(mine, 3, 6)]
    df = spark.createDataFrame(rows, "track_id long, frame_index long, score double, source string, ord long")
    got = {}
    for r in topk.best_crops(df, BestFrameRules(k=3, min_frame_gap=6)).orderBy("track_id", "place").collect():
        got.setdefault(r.track_id, []).append((r.frame_index, r.ord))
    assert got == want


def test_odd_crops(spark):
    """Small Arrow batches; no score, no source, no frame, no track; and no rows."""
    rows = [(1, 5, None, "detection", 0), (1, 50, 0.5, "detection", 1), (1, None, 0.9, "detection", 2), (2, 5, 0.5, None, 0), (None, 7, 0.1, "detection", 0), (None, 70, 0.3, "detection", 1)]
    df = spark.createDataFrame(rows, "track_id long, frame_index long, score double, source string, ord long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {(r.track_id, r.place): (r.ord, r.is_detection) for r in topk.best_crops(df, BestFrameRules(k=3, min_frame_gap=6)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(1, 1): (2, True), (1, 2): (1, True), (1, 3): (0, True), (2, 1): (0, False), (None, 1): (1, True), (None, 2): (0, True)}
    assert topk.best_crops(df.limit(0)).count() == 0


def test_invariants():
    rng = random.Random(1)
    rows = [(i * 2, rng.random() < 0.5, rng.random(), i) for i in range(300)]
    kept = loop(rows, 5, 10)
    frames = sorted(r[0] for r in kept)
    assert len(kept) <= 5 and all(b - a >= 10 for a, b in zip(frames, frames[1:], strict=False)) and all(r[1] for r in kept)


def test_a_newcomer_that_beats_several_can_shrink_the_buffer():
    kept = [(0, True, 0.1, 0), (8, True, 0.2, 1)]
    assert add_crop(kept, (4, True, 0.9, 2), 5, 6) == [(4, True, 0.9, 2)]


def test_fallbacks_go_when_a_detection_comes():
    assert add_crop([(0, False, 0.9, 0)], (50, True, 0.1, 1), 5, 6) == [(50, True, 0.1, 1)]
    assert add_crop([(50, True, 0.1, 1)], (99, False, 0.9, 2), 5, 6) == [(50, True, 0.1, 1)]


def test_running_median_over_batches(spark):
    """Tracks in several batches, nulls and a row without any value yet, against a plain loop."""
    import random
    from statistics import median

    from framequorum.operators.topk import running_median

    rng = random.Random(3)
    rows = [(t, i, None if rng.random() < 0.3 else rng.randrange(50) / 7) for t in range(5) for i in range(rng.choice([1, 2, 60]))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.t, r.i): r._median for r in running_median(spark.createDataFrame(rows, "t long, i long, v double"), "v", "t", "i").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for t, i, _ in rows:
        seen = [v for a, b, v in rows if a == t and b <= i and v is not None]
        assert got[t, i] == (pytest.approx(median(seen)) if seen else None)
