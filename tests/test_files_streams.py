import json
import zipfile

from framequorum.config import BestFrameRules
from framequorum.operators import reading_order as RO, topk
from framequorum.sources import files
from framequorum.streaming import jobs
from pyspark.sql import functions as F


def test_csv_json_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "51F12345", [1, 2])], "track_id long, plate_text string, supporting_frames array<int>")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c")).first()
    assert (back.track_id, back.plate_text, back.supporting_frames, back.plate_display) == ("1", "51F12345", "[1,2]", None)
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().supporting_frames == [1, 2]
    assert files.report(df.select("track_id", "plate_text")).first().value == "[1]\n  plate_text: 51F12345"


def test_results_and_truth(spark, tmp_path):
    doc = {"video": "a.mp4", "tracks": [{"track_id": 1, "text": "x", "readings": [{"text": "51F1", "confidence": 0.5}, {"text": "51F2"}]}, {"track_id": 2, "readings": []}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    rows = files.read_results(spark, str(tmp_path / "r.json")).orderBy("track_id", "ord").collect()
    assert [(r.track_id, r.text) for r in rows] == [(1, "51F1"), (1, "51F2"), (2, None)]
    (tmp_path / "t.csv").write_text("video,track_id,ground_truth\na,1,51F12345\na,,x\n")
    assert files.read_truth(spark, str(tmp_path / "t.csv")).count() == 1


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>image</t></si><si><t>a.jpg</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    assert tuple(files.read_xlsx(spark, str(tmp_path / "b.xlsx"), ["image", "text", "x"]).first()) == ("a.jpg", None, "7")


def test_frame_folder(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    for n in (3, 12):
        (tmp_path / "v1" / f"frame_{n:06d}.png").write_bytes(b"x" * n)
    rows = files.read_frames(spark, str(tmp_path), fps=10.0).orderBy("frame_index").collect()
    assert [(r.video_id, r.frame_index, r.ts, len(r.image)) for r in rows] == [("v1", 3, 0.3, 3), ("v1", 12, 1.2, 12)]
    assert files.list_files(spark, str(tmp_path), "*.png").count() == 2


def test_label_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 .5 .5 .1 .1\n0 " + ".1 " * 8 + "\nx y\n\n")
    assert [r.kind for r in files.read_label_lines(spark, str(tmp_path)).collect()] == ["box", "polygon", "bad"]


def test_engine_results():
    named = '[{"res": {"rec_texts": ["51F", "123"], "rec_scores": [0.9], "rec_boxes": [[0, 0, 4, 2]]}}]'
    assert RO.parse_result(named) == [{"text": "51F", "confidence": 0.9, "box": [[0.0, 0.0], [4.0, 2.0]]}, {"text": "123", "confidence": 1.0, "box": None}]
    nested = '[[[[[0,0],[4,0],[4,2],[0,2]], ["51F", 0.8]]]]'
    assert RO.parse_result(nested)[0]["text"] == "51F" and RO.parse_result("{") == [] and RO.parse_result(None) == []


def _loop(items, tol=0.6):
    placed = [i for i in items if i[1] is not None]
    if len(placed) < 2:
        return [i[0] for i in items]
    h = sorted(max(1.0, i[3]) for i in placed)
    median = (h[(len(h) - 1) // 2] + h[len(h) // 2]) / 2
    rows = []
    for k, i in sorted(enumerate(placed), key=lambda x: (x[1][2], x[0])):
        row = next((r for r in rows if abs(i[2] - sum(x[1][2] for x in r) / len(r)) <= tol * median), None)
        row.append((k, i)) if row is not None else rows.append([(k, i)])
    rows.sort(key=lambda r: sum(x[1][2] for x in r) / len(r))
    return [i[0] for r in rows for k, i in sorted(r, key=lambda x: (x[1][1], x[0]))] + [i[0] for i in items if i[1] is None]


def test_reading_order_matches_a_loop(spark):
    import random

    rng = random.Random(3)
    cases = [[(f"t{k}", *((None,) * 3 if rng.random() < 0.1 else (float(rng.randrange(90)), float(rng.randrange(60)), float(rng.randrange(5, 20))))) for k in range(rng.randrange(0, 8))] for _ in range(80)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, items array<struct<text: string, x: double, y: double, h: double>>")
    got = {r.i: list(r.o) for r in df.select("i", RO.in_reading_order(F.col("items")).alias("o")).collect()}
    assert got == {i: _loop(c) for i, c in enumerate(cases)}


def _events(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "a", float(i)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "e"))
    return str(tmp_path / "e"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_windows_stream_like_batch(spark, tmp_path):
    path, schema = _events(spark, tmp_path)
    make = lambda e: jobs.windowed(jobs.timed(e), "10 minutes").select("window.start", "n", "total")
    got = jobs.collected(make(spark.readStream.schema(schema).parquet(path)), "tumbling", "complete").collect()
    assert sorted(got) == sorted(make(spark.read.parquet(path)).collect()) and len(got) == 6


def test_repeated_frames_are_dropped(spark, tmp_path):
    path, schema = _events(spark, tmp_path)
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    out = jobs.without_repeats(jobs.timed(spark.readStream.schema(schema).parquet(path + "2"), "2 hours"), "event_id")
    assert jobs.collected(out.select("event_id"), "once").count() == 60


def test_best_crops_stream_like_batch(spark, tmp_path):
    schema = "track_id long, frame_index long, score double, source string, ord long"
    rows = [(t, 4 * o, ((o * 7 + t) % 11) / 10, "fallback" if o % 5 == t else "detection", o) for t in range(4) for o in range(20)]
    for part in (rows[:0] + [r for r in rows if r[4] < 10], [r for r in rows if r[4] >= 10]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    rules = BestFrameRules(k=3, min_frame_gap=6)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "c"))
    got = jobs.collected(jobs.best_crops_stream(stream, rules), "crops", "update").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in topk.best_crops(spark.createDataFrame(rows, schema), rules).select("track_id", "place", "frame_index", "ord", "score", "is_detection").collect())


def test_result_table_has_all_columns():
    assert len(files.RESULT_COLUMNS) == 22


def test_workbook_round_trip(spark):
    rows = [("a", "1<2 & é", None), ("b", None, "x"), ("c", " pad ", "z")]
    df = spark.createDataFrame([(1, *r) for r in rows], "part int, image string, text string, x string")
    assert sorted(tuple(r) for r in files.sheet_rows(files.workbooks(df, "part", "image"), ["image", "text", "x"]).collect()) == sorted(rows, key=lambda r: r[0])


def test_one_failing_picture_fails_no_other(spark):
    from framequorum.operators import modules

    def engine(picture):
        if picture is None:
            raise ValueError("no picture")
        return [{"text": picture.decode(), "box": None}]

    df = spark.createDataFrame([(1, b"a"), (2, None), (3, b"c")], "id int, image binary")
    out = {r.id: r for r in modules.with_items(df, ("only", engine)).collect()}
    assert out[1]["items"][0].text == "a" and out[2]["items"] == [] and out[2].engine is None and out[2].warnings == ["only: no picture"] and out[3].warnings == []


def test_dataset_description():
    assert files.dataset_yaml("/d", ["car", "plate"]).endswith("names:\n  0: car\n  1: plate\n")


def test_no_document_holds_a_whole_video(spark, tmp_path, monkeypatch):
    """All tracks of one video: documents of about 1,000 tracks each, and every reading read back."""
    import json

    import pandas as pd

    from framequorum.plans import storage

    n = 3000
    columns = {"l_orderkey": [16 * (i // 2) for i in range(2 * n)], "l_partkey": range(2 * n), "l_suppkey": range(2 * n), "l_linenumber": [1 + i % 2 for i in range(2 * n)], "l_quantity": 5.0, "l_extendedprice": 1.0, "l_discount": 0.1, "l_tax": 0.0, "l_linestatus": "F", "l_shipdate": pd.Timestamp("2020-01-01")}
    pd.DataFrame(columns).astype({"l_linenumber": "int32"}).to_parquet(tmp_path / "lineitem.parquet")
    monkeypatch.setattr(storage, "shared_folder", lambda spark: f"{tmp_path}/out")
    rows = storage.src6_result_documents(spark, str(tmp_path)).select("video", "track_id", "ord").collect()
    documents = [len(json.loads(line)["tracks"]) for f in (tmp_path / "out").rglob("*.json") for line in f.read_text().splitlines()]
    assert sum(documents) == n and max(documents) < 1500
    assert sorted(map(tuple, rows)) == sorted(("v0", 16 * t, o) for t in range(n) for o in (1, 2))
