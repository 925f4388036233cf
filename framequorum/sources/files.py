"""Readers and writers for the files around recognition data. Paths go to Spark's readers, so any store works."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.labels import ccpd_fields, label_line

# The columns of a result table, in their order.
RESULT_COLUMNS = (
    "track_id", "plate_text", "plate_display", "confidence", "valid_format", "reliable", "is_two_line", "vote_count", "total_readings", "accepted_readings", "hits", "class_id", "label",
    "first_frame", "last_frame", "first_timestamp", "last_timestamp", "vehicle_bbox", "per_char_confidence", "supporting_frames", "fusion_notes", "fusion_used",
)
LABEL_SCHEMA = "image string, plate_text string, tl_x int, tl_y int, tr_x int, tr_y int, br_x int, br_y int, bl_x int, bl_y int"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; all strings unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation labels (video, track_id, ground_truth); rows without a track are skipped."""
    rows = read_csv(spark, path, "video string, track_id string, ground_truth string")
    return rows.where(F.trim(F.coalesce("track_id", F.lit(""))) != "")


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Readings of result documents, one row each, with their video and track; a file is one document, or with ``lines`` one a line."""
    reading = "struct<text: string, raw_text: string, confidence: double, frame_index: bigint, score: double, engine: string>"
    rows = spark.read.schema(f"video string, tracks array<struct<track_id: bigint, text: string, readings: array<{reading}>>>").json(path, multiLine=not lines)
    tracks = rows.select("video", F.explode("tracks").alias("t"))
    return tracks.select("video", "t.track_id", F.posexplode_outer("t.readings").alias("ord", "r")).select("video", "track_id", (F.col("ord") + 1).cast("long").alias("ord"), "r.*")


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of detection, polygon and pose label files: file, kind and numbers."""
    lines = spark.read.text(path).withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]*)$", 1)).where(F.trim("value") != "")
    return lines.withColumn("l", label_line(F.col("value"))).select("file", "l.kind", "l.numbers")


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files under a folder by name, without their content."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(path).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"))


def read_ccpd(spark: SparkSession, path: str) -> DataFrame:
    """What the names of a folder's pictures say; names of another form have null fields."""
    return list_files(spark, path).withColumn("fields", ccpd_fields(F.col("name")))


def frame_index(name):
    """The number in a frame's file name."""
    return F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long")


def read_frames(spark: SparkSession, path: str, fps: float = 25.0, streaming: bool = False) -> DataFrame:
    """A folder of frame_000123.* pictures per video as frames, batch or streaming; bytes stay a column of their own, so they prune."""
    if streaming:
        reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    else:
        reader = spark.read.format("binaryFile")
    rows = reader.option("recursiveFileLookup", True).load(path)
    index = frame_index(F.col("path"))
    return rows.select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("video_id"), index.alias("frame_index"), (index / F.lit(float(fps))).alias("ts"), F.col("content").alias("image")).where("frame_index is not null")


def _sheet(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as text."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        first = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{ns}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{ns}c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                column = 0
                for letter in letters:
                    column = 26 * column + ord(letter) - 64
                cells += [None] * (column - 1 - len(cells))
                value, inline = c.find(f"{ns}v"), c.find(f"{ns}is")
                text = "".join(t.text or "" for t in inline.iter(f"{ns}t")) if inline is not None else None if value is None else value.text
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            out.append(cells)
        return out


def sheet_rows(workbooks: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the first sheets of workbooks (content), header skipped, all columns as text; one task reads a workbook."""
    schema = ", ".join(f"`{c}` string" for c in columns)

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = [(r + [None] * len(columns))[: len(columns)] for r in _sheet(bytes(content))[1:]]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return workbooks.select("content").mapInPandas(run, schema)


def read_xlsx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``sheet_rows`` of the workbooks under a path."""
    return sheet_rows(spark.read.format("binaryFile").load(path), columns)


def _workbook(header: list[str], rows: list[tuple]) -> bytes:
    """A workbook with one sheet of text cells; nulls are left out."""

    def cell(row: int, column: int, value) -> str:
        letters, n = "", column + 1
        while n:
            n, r = divmod(n - 1, 26)
            letters = chr(65 + r) + letters
        return f'<c r="{letters}{row}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = [f'<row r="{i}">{"".join(cell(i, j, v) for j, v in enumerate(r) if v is not None)}</row>' for i, r in enumerate([tuple(header), *rows], 1)]
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    sheet = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{sheet}" xmlns:r="{office}"><sheets><sheet name="labels" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{sheet}"><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def workbooks(rows: DataFrame, by: str, order: str) -> DataFrame:
    """One workbook per value of ``by``: (by, content), rows in order. A sheet is what one person labels, so it fits a task."""
    columns = [c for c in rows.columns if c != by]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")[columns]
        return pd.DataFrame({by: [key[0]], "content": [_workbook(columns, list(part.astype(object).where(part.notna(), None).itertuples(index=False, name=None)))]})

    return rows.groupBy(by).applyInPandas(run, f"{by} {dict(rows.dtypes)[by]}, content binary")


def dataset_yaml(folder: str, names: list[str]) -> str:
    """The description of a detection data set, for trainers."""
    return f"path: {folder}\ntrain: images/train\nval: images/val\ntest: images/test\nnames:\n" + "".join(f"  {i}: {n}\n" for i, n in enumerate(names))


def write_split(rows: DataFrame, path: str) -> None:
    """split.csv (image, track_id, split, has_plate, plate_text) of labelled rows that have their split."""
    rows.select("image", "track_id", "split", F.col("has_plate").cast("int").alias("has_plate"), "plate_text").write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = RESULT_COLUMNS) -> None:
    """The named columns in their order, null where rows has none; nested values as JSON."""
    kinds = dict(rows.dtypes)
    nested = ("array", "struct", "map")
    out = [F.lit(None).cast("string").alias(c) if c not in kinds else (F.to_json(c) if kinds[c].startswith(nested) else F.col(c)).alias(c) for c in columns]
    rows.select(*out).write.mode("overwrite").option("header", True).csv(path)


def report(rows: DataFrame, title: str = "track_id") -> DataFrame:
    """A block of ``name: value`` lines for every row, as one text column."""
    lines = [F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in rows.columns if c != title]
    return rows.select(F.concat_ws("\n", F.concat(F.lit("["), F.col(title).cast("string"), F.lit("]")), *lines).alias("value"))


def write_report(rows: DataFrame, path: str, title: str = "track_id") -> None:
    report(rows, title).write.mode("overwrite").text(path)


def crop_names(crops: DataFrame) -> DataFrame:
    """Add the file name that tells a kept crop's track, place, frame, score and source."""
    source = F.when(F.col("is_detection"), "detection").otherwise("fallback")
    return crops.withColumn("name", F.format_string("track%04d_top%d_frame%06d_score%.3f_%s.jpg", "track_id", "place", "frame_index", "score", source))


def write_crop_manifest(crops: DataFrame, path: str) -> None:
    crop_names(crops).write.mode("overwrite").json(path)


def best_reading_crops(readings: DataFrame, frames: DataFrame) -> DataFrame:
    """Each track's surest reading with its frame; readings without a frame go."""
    best = readings.groupBy("track_id").agg(F.max_by(F.struct("frame_index", "text", "confidence"), F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col("ord")).alias("o"))).alias("b"))
    return best.select("track_id", "b.*").join(frames.drop("confidence"), "frame_index")


def labelling_sheet(crops: DataFrame) -> DataFrame:
    """Rows for hand labelling: the image, empty label columns, and two for reference."""
    blank = [F.lit(None).cast("string").alias(c) for c in ("plate_text", "tl_x", "tl_y", "tr_x", "tr_y", "br_x", "br_y", "bl_x", "bl_y")]
    return crops.select("image", *blank, "track_id", "source")


def snapshots(stream: DataFrame, path: str, every: str = "10 seconds"):
    """A streaming query that replaces a Parquet snapshot of its aggregated state at every trigger."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode("complete").trigger(processingTime=every).foreachBatch(put).start()


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key: repeated lookup keys must not multiply a join."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_p", F.row_number().over(by)).where("_p = 1").drop("_p")
