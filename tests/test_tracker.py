import numpy as np

from framequorum.config import TrackRules
from framequorum.streaming import tracker as K
from framequorum.streaming.jobs import collected

BOX = np.array([[100, 100, 150, 160]], float)


def step(t, boxes):
    return t.step(np.asarray(boxes, float).reshape(-1, 4), np.ones(len(boxes)), np.full(len(boxes), 2))


def test_confirmed_after_three_hits_in_a_row():
    t = K.Tracker(TrackRules(min_hits=3))
    assert [len(step(t, BOX)) for _ in range(5)] == [0, 0, 1, 1, 1]


def test_a_track_unseen_too_long_goes():
    t = K.Tracker(TrackRules(min_hits=1, max_age=2))
    for _ in range(2):
        step(t, BOX)
    for _ in range(3):
        step(t, [])
    assert t.tracks == []


def test_a_moving_box_keeps_its_number():
    t = K.Tracker(TrackRules(min_hits=1))
    assert {x.number for i in range(6) for x in step(t, BOX + 5 * i)} == {1}


def test_two_boxes_two_numbers():
    t = K.Tracker(TrackRules(min_hits=1))
    for _ in range(4):
        out = step(t, np.vstack([BOX, BOX + 300]))
    assert sorted(x.number for x in out) == [1, 2]


SCHEMA = "video_id long, frame_index long, ord long, x1 int, y1 int, x2 int, y2 int, confidence double, class_id int"


def _rows(frames):
    return [(v, f, o, 100 + 4 * f + 200 * o, 50 + v, 150 + 4 * f + 200 * o, 120 + v, 0.9, 2) for v in range(3) for f in frames for o in range(2)]


def test_numbers_are_never_used_again(spark):
    out = K.track(spark.createDataFrame(_rows(range(12)), SCHEMA), TrackRules(min_hits=2)).collect()
    assert {(r.video_id, r.track_id) for r in out} == {(v, t) for v in range(3) for t in (1, 2)} and len(out) == 3 * 2 * 11


def test_stream_equals_batch(spark, tmp_path):
    """Three batches with empty frames at a border and within; a class that is not tracked; the query ends by itself."""
    rows = [(r[0], r[1], 0, *[None] * 6) if r[1] in (3, 6) else r for r in _rows(range(12)) if r[1] not in (3, 6) or not r[2]]
    rows.append((0, 5, 9, 0, 0, 40, 40, 0.9, 0))
    rules = TrackRules(min_hits=3)
    for i in range(3):
        part = [r for r in rows if 4 * i <= r[1] < 4 * i + 4]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(K.track_stream(stream, rules), "sort_stream", checkpoint=str(tmp_path / "cp")).collect()
    want = K.track(spark.createDataFrame(rows, SCHEMA), rules).collect()
    shown = {r.frame_index for r in want}
    assert sorted(got) == sorted(want) and {2, 11} <= shown and not {0, 1, 3, 6} & shown


def test_numbers_go_on_after_a_long_pause(spark):
    """A video that comes back keeps its counter: the state has no clock."""
    t = K.Tracker(TrackRules(min_hits=1, max_age=1))
    step(t, BOX)
    for _ in range(3):
        step(t, [])
    assert [x.number for x in step(t, BOX)] == [2]


def test_tracking_off(spark):
    rows = K.untracked(spark.createDataFrame(_rows(range(3)), SCHEMA)).collect()
    assert sorted(r.track_id for r in rows if r.video_id == 1) == [1, 2, 3, 4, 5, 6]


def test_small_batches_and_long_videos(spark):
    """Frames that are cut by the border of a batch, and a video without an id, give what single videos give."""
    rows = [(None if r[0] == 2 else r[0], *r[1:]) for r in _rows(range(15))]
    df = spark.createDataFrame(rows, SCHEMA)
    single = [tuple(r) for v in ("0", "1", "null") for r in K.track(df.where(f"video_id <=> {v}"), TrackRules(min_hits=2)).collect()]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        together = [tuple(r) for r in K.track(df, TrackRules(min_hits=2)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(together, key=repr) == sorted(single, key=repr) and len(together) == 3 * 2 * 14
    assert K.track(df.limit(0)).count() == 0


def test_filter_steps_equal_single_tracks():
    """All tracks at once or each in a tracker of its own: the same boxes."""
    paths = [lambda i: (10 + 7 * i, 20 + i, 60 + 8 * i, 50 + i), lambda i: (500 - 3 * i, 400, 560 - 3 * i, 470 + i)]
    both = K.Tracker(TrackRules(min_hits=1))
    alone = [K.Tracker(TrackRules(min_hits=1)) for _ in paths]
    for i in range(9):
        seen = step(both, [p(i) for p in paths])
        for n, (t, p) in enumerate(zip(alone, paths, strict=True)):
            assert seen[n][1:5] == step(t, [p(i)])[0][1:5]
