"""Queries over pictures, engine results, files and streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import pixels as P
from ..operators import labels as L, reading_order as RO
from ..sources import files
from ..streaming import jobs
from .bindings import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _pictures(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Grey pictures of 24 x 60 made of an image's number; ``once``: one for all rows that share an image's name.

    Names are small, so few files hold very many: they are dealt to all tasks, with the numbers
    that a picture is made of, before pixels are made.
    """
    n = F.substring("image", 1, 6).cast("long")
    images = view(spark, sf_dir, "manifest").select("image", (n % 97 + 3).alias("a"), (n % 31).alias("b"))
    images = images.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image")
    pixels = F.expr("transform(sequence(0, 24 * 60 - 1), i -> cast((i * a + (i div 60) * b) % 256 as int))")
    return (images.distinct() if once else images).select("image", pixels.alias("pixels"))


@query(with_views("manifest") + """, p AS (SELECT image, CAST(substr(image, 1, 6) AS BIGINT) AS n, unnest(generate_series(0, 1439)) AS i FROM manifest),
    v AS (SELECT image, (i * (n % 97 + 3) + (i // 60) * (n % 31)) % 256 AS v FROM p)
    SELECT image, round(avg(v), 6) AS brightness, round(least(1, count(*) FILTER (v >= 225) / count(*) + count(*) FILTER (v <= 30) / count(*)), 6) AS exposure FROM v GROUP BY ALL""")
def img1_brightness_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array expressions only: pixels never leave the JVM."""
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / F.size("pixels")
    share = lambda f: F.size(F.filter("pixels", f)) / F.size("pixels")
    glare = F.least(F.lit(1.0), share(lambda x: x >= 225) + share(lambda x: x <= 30))
    return _pictures(spark, sf_dir, once=True).select("image", F.round(mean, 6).alias("brightness"), F.round(glare, 6).alias("exposure"))


# The made pictures as a table: a cell's value follows from its image's number, row and column.
CELLS = with_views("manifest") + """, cells AS (SELECT image, n, r, c, ((r * 60 + c) * (n % 97 + 3) + r * (n % 31)) % 256 AS v FROM (SELECT image, CAST(substr(image, 1, 6) AS BIGINT) AS n FROM manifest), range(24) a(r), range(60) b(c)),
    bins AS (SELECT image, v, count(*) AS k FROM cells GROUP BY ALL),
    sums AS (SELECT image, v, sum(k) OVER (PARTITION BY image ORDER BY v) / 1440e0 AS w, sum(k * v) OVER (PARTITION BY image ORDER BY v) / 1440e0 AS m, sum(k * v) OVER (PARTITION BY image) / 1440e0 AS mean FROM bins),
    split AS (SELECT image, coalesce(arg_max(v, b), 0) AS threshold FROM (SELECT image, v, (mean * w - m) * (mean * w - m) / (w * (1 - w)) AS b FROM sums WHERE w < 1 ORDER BY image, v) GROUP BY ALL)"""


@query(CELLS + """, around AS (SELECT image, r, c, v, ((CASE r WHEN 0 THEN 1 ELSE r - 1 END) * 60 + c) AS up, ((CASE r WHEN 23 THEN 22 ELSE r + 1 END) * 60 + c) AS down, (r * 60 + CASE c WHEN 0 THEN 1 ELSE c - 1 END) AS back, (r * 60 + CASE c WHEN 59 THEN 58 ELSE c + 1 END) AS fore, n FROM cells),
    bend AS (SELECT image, list_sum(list_transform([up, down, back, fore], lambda i: (i * (n % 97 + 3) + (i // 60) * (n % 31)) % 256)) - 4 * v AS d FROM around)
    SELECT image, round((sum(d * d) - sum(d) * sum(d) / 1440e0) / 1440e0, 6) AS sharpness FROM bend GROUP BY ALL""")
def img1_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def sharp(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: round(P.laplacian_variance(np.asarray(p).reshape(24, 60)), 6))

    return _pictures(spark, sf_dir).select("image", sharp("pixels").alias("sharpness"))


def _each_once(pixels: pd.Series) -> tuple[np.ndarray, list[int]]:
    """The different pictures of a batch, (n, 24, 60), and the place of each row's among them: equal ones are measured once a batch."""
    known: dict[bytes, int] = {}
    of = [known.setdefault(np.asarray(p, np.float32).tobytes(), len(known)) for p in pixels]
    return np.frombuffer(b"".join(known), np.float32).astype(float).reshape(-1, 24, 60), of


@query()
def img5_prepared_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every picture's variants for reading: one row each, with its mean."""

    def run(batches):
        for pdf in batches:
            found: list[list[tuple]] = []
            pictures, of = _each_once(pdf["pixels"])
            for g, turn in zip(pictures, P.skews(pictures), strict=True):
                found.append([(name, round(float(v.mean()), 4)) for name, v in P.prepared(g, turn=float(turn)).items()])
            rows = [(i, *r) for i, k in zip(pdf["image"], of, strict=True) for r in found[k]]
            yield pd.DataFrame(rows, columns=["image", "variant", "mean"])

    return _pictures(spark, sf_dir).mapInPandas(run, "image string, variant string, mean double")


@query()
def geo6_quad_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster overlap of every labelled quad with its bounding box."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                q = np.array([[r.tl_x, r.tl_y], [r.tr_x, r.tr_y], [r.br_x, r.br_y], [r.bl_x, r.bl_y]], float)
                (x1, y1), (x2, y2) = q.min(0), q.max(0)
                rows.append((r.image, round(P.quad_iou(q, np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]])), 6)))
            yield pd.DataFrame(rows, columns=["image", "iou"])

    return view(spark, sf_dir, "labeled").where(L.has_quad()).mapInPandas(run, "image string, iou double")


@query(with_views("labeled") + """, q AS (SELECT image, tl_x, tl_y, br_x - tl_x AS ax, br_y - tl_y AS ay, bl_x - tr_x AS bx, bl_y - tr_y AS by_, tr_x - tl_x AS dx, tr_y - tl_y AS dy FROM labeled WHERE greatest(abs(tl_x), abs(tl_y), abs(tr_x), abs(tr_y), abs(br_x), abs(br_y), abs(bl_x), abs(bl_y)) > 0),
    t AS (SELECT *, (dx * by_ - dy * bx) / CAST(ax * by_ - ay * bx AS DOUBLE) AS t FROM q) SELECT image, round(tl_x + t * ax + 1e-9, 6) AS x, round(tl_y + t * ay + 1e-9, 6) AS y FROM t""")
def geo10_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of the unit square under the map of the square's corners to each quad: where its diagonals meet.

    Coordinates are 1e-9 up before they are rounded, as many lie half-way between two steps.
    """

    def run(batches):
        square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                h = P.homography(square, np.array([[r.tl_x, r.tl_y], [r.tr_x, r.tr_y], [r.br_x, r.br_y], [r.bl_x, r.bl_y]], float))
                rows.append((r.image, *np.round(P.applied(h, np.array([[0.5, 0.5]]))[0] + 1e-9, 6).tolist()))
            yield pd.DataFrame(rows, columns=["image", "x", "y"])

    return view(spark, sf_dir, "labeled").where(L.has_quad()).mapInPandas(run, "image string, x double, y double")


@query("SELECT event_id, CAST(event_id % 3 + 1 AS BIGINT) AS items, CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE 0.5e0 END AS confidence FROM events")
def jsn2_result_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named results without scores and nested results with them, made one shape."""
    k = (F.col("event_id") % 3 + 1).cast("int")
    texts = F.array_repeat(F.lit('"AB"'), k)
    named = F.concat(F.lit('[{"res": {"rec_texts": ['), F.array_join(texts, ", "), F.lit("]}}]"))
    nested = F.concat(F.lit("[["), F.array_join(F.array_repeat(F.lit('[[[0,0],[4,0],[4,2],[0,2]], ["AB", 0.5]]'), k), ", "), F.lit("]]"))
    rows = _events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 2 == 0, named).otherwise(nested).alias("payload"))
    return RO.with_items(rows).select("event_id", F.size("items").cast("long").alias("items"), F.col("items")[0]["confidence"].alias("confidence"))


@query(with_views("vehicles").replace("WITH ", "WITH RECURSIVE ", 1) + """, item AS (SELECT video_id, frame_index, 'v' || CAST(ord AS STRING) AS t, (x1 + x2) / 2e0 AS x, (y1 + y2) / 2e0 AS y, y2 - y1 AS h, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY ord) AS k FROM vehicles),
    turn AS (SELECT item.*, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY y, k) AS n, 0.6e0 * quantile_cont(greatest(1, CAST(h AS DOUBLE)), 0.5) OVER (PARTITION BY video_id, frame_index) AS reach FROM item),
    fold AS (SELECT DISTINCT video_id, frame_index, CAST(0 AS BIGINT) AS n, CAST([] AS DOUBLE[]) AS means, CAST([] AS BIGINT[]) AS sizes, CAST([] AS STRUCT(line BIGINT, x DOUBLE, k BIGINT, t VARCHAR)[]) AS words FROM turn
        UNION ALL SELECT video_id, frame_index, n, CASE WHEN line > len(means) THEN list_append(means, y) ELSE list_transform(means, lambda m, i: CASE WHEN i = line THEN (m * sizes[i] + y) / (sizes[i] + 1) ELSE m END) END,
            CASE WHEN line > len(means) THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda s, i: CASE WHEN i = line THEN s + 1 ELSE s END) END, list_append(words, {'line': CAST(line AS BIGINT), 'x': x, 'k': k, 't': t}) FROM (
            SELECT t.*, means, sizes, words, coalesce(nullif(list_position(list_transform(means, lambda m: abs(t.y - m) <= t.reach), true), 0), len(means) + 1) AS line FROM fold JOIN turn t ON t.video_id = fold.video_id AND t.frame_index = fold.frame_index AND t.n = fold.n + 1)),
    done AS (SELECT video_id, frame_index, means, unnest(words) AS w FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY n DESC) AS last FROM fold) WHERE last = 1)
    SELECT video_id, frame_index, string_agg(w.t, ' ' ORDER BY means[w.line], w.line, w.x, w.k) AS words FROM done GROUP BY ALL""")
def win10_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a frame's boxes in reading order: an ordered fold, tested against a loop."""
    item = F.struct(F.concat(F.lit("v"), F.col("ord").cast("string")).alias("text"), ((F.col("x1") + F.col("x2")) / 2.0).alias("x"), ((F.col("y1") + F.col("y2")) / 2.0).alias("y"), (F.col("y2") - F.col("y1")).cast("double").alias("h"))
    frames = view(spark, sf_dir, "vehicles").groupBy("video_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("ord", item.alias("i")))).alias("r"))
    return frames.select("video_id", "frame_index", F.array_join(RO.in_reading_order(F.transform("r", lambda x: x["i"])), " ").alias("words"))


@query("SELECT event_id, CAST(event_id % 90 AS INT) AS tilt_h, CAST(event_id % 300 + 5 AS INT) AS first_x, CAST(event_id % 7 AS INT) AS blur FROM events WHERE event_id % 11 <> 0")
def src8_ccpd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of file names; malformed names (every eleventh) have none."""
    n = lambda m, a=0: (F.col("event_id") % m + a).cast("string")
    corner = lambda x, y: F.concat(x, F.lit("&"), y)
    corners = F.concat_ws("_", corner(n(310, 100), n(90, 60)), corner(n(300, 5), n(80, 60)), corner(n(300, 5), n(80, 5)), corner(n(310, 100), n(90, 5)))
    name = F.concat_ws("-", F.lit("025"), F.concat(n(90), F.lit("_"), n(80)), F.concat(corner(n(300), n(70)), F.lit("_"), corner(n(320, 90), n(95, 60))), corners, F.lit("0_0_22_27"), n(120), n(7))
    name = F.when(F.col("event_id") % 11 == 0, F.lit("broken-name")).otherwise(name)
    rows = _events(spark, sf_dir).select("event_id", L.ccpd_fields(F.concat(name, F.lit(".jpg"))).alias("f")).where("f is not null")
    return rows.select("event_id", "f.tilt_h", F.col("f.corners")[0]["x"].alias("first_x"), "f.blur")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'box' WHEN 1 THEN 'polygon' WHEN 2 THEN 'pose' ELSE 'bad' END AS kind FROM events")
def src7_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.element_at(F.array(F.lit(5), F.lit(9), F.lit(17), F.lit(4)), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.array_join(F.array_repeat(F.lit("0.5"), count), "  ")
    return _events(spark, sf_dir).select("event_id", L.label_line(line)["kind"].alias("kind"))


@query("SELECT DISTINCT code FROM (SELECT lpad(CAST(event_id % 120 AS STRING), 2, '0') AS code FROM events) WHERE length(code) = 2 AND CAST(code AS INT) < 100 AND code NOT IN ('10', '11')")
def src11_province_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("event_id") % 120).cast("string")
    line = F.concat(F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code), F.lit(", x1 7"))
    return L.province_codes(_events(spark, sf_dir).select(line.alias("value"))).where(~F.col("code").isin("10", "11"))


@query(with_views("readings", "frames") + """, b AS (SELECT track_id, arg_max({'f': frame_index, 't': text, 'c': round(confidence, 6)}, coalesce(confidence, 0) * 1e6 - ord) AS b FROM readings GROUP BY ALL)
    SELECT b.track_id, f.video_id, f.brightness FROM b JOIN frames f ON f.frame_index = b.b.f""")
def snk4_best_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.best_reading_crops(view(spark, sf_dir, "readings"), view(spark, sf_dir, "frames")).select("track_id", "video_id", "brightness")


@query(with_views("manifest") + "SELECT image, CAST(NULL AS STRING) AS plate_text, track_id, source FROM manifest")
def snk8_labelling_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.labelling_sheet(view(spark, sf_dir, "manifest")).select("image", "plate_text", "track_id", "source")


@query(with_views("manifest") + "SELECT '[' || image || ']' || chr(10) || '  source: ' || source || chr(10) || '  width: ' || CAST(width AS STRING) AS value FROM manifest")
def snk3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.report(view(spark, sf_dir, "manifest").select("image", "source", "width"), "image")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stm_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.windowed(jobs.timed(_events(spark, sf_dir)), "1 hour")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, * FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def stm_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.windowed(jobs.timed(_events(spark, sf_dir)), "1 hour", "30 minutes")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS hits, max(value) AS best FROM s GROUP BY user_id, sid""")
def stm_track_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.track_sessions(jobs.timed(_events(spark, sf_dir)), "2 hours")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "hits", "best")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stm_repeated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.without_repeats(_events(spark, sf_dir), "user_id", "event_type").select("user_id", "event_type")
