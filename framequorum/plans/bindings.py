"""Plate-shaped views of the benchmark tables, in SQL that Spark and DuckDB read alike.

Each view names its base tables as {table}; Spark puts a Parquet path there, the oracle the
table's name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _plate(key: str) -> str:
    """The plate that a track truly has."""
    return f"(lpad(CAST({key} % 89 + 11 AS STRING), 2, '0') || chr(CAST(65 + {key} % 26 AS INT)) || lpad(CAST(({key} * 7919) % 100000 AS STRING), 5, '0'))"


_NOISY = """CASE l_suppkey % 10
            WHEN 0 THEN translate(plate, '01', 'Ol')
            WHEN 1 THEN substr(plate, 1, 2) || '-' || substr(plate, 3, 2) || ' ' || substr(plate, 5)
            WHEN 2 THEN substr(plate, 1, 5)
            WHEN 3 THEN substr(plate, 1, 7) || CAST(l_partkey % 10 AS STRING)
            WHEN 4 THEN ''
            WHEN 5 THEN substr(plate, 1, 3) || '-' || substr(plate, 4, 3) || '.' || substr(plate, 7)
            ELSE plate END"""

VIEWS = {
    # OCR readings: one per line item, its order the track.
    "readings": f"""
        SELECT track_id, ord, 5 * ord AS frame_index, text, text AS raw_text, confidence, score, engine
        FROM (SELECT l_orderkey AS track_id, l_quantity, l_discount, l_partkey,
                     row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS ord,
                     {_NOISY} AS text,
                     CASE WHEN l_partkey % 37 = 0 THEN CAST(NULL AS DOUBLE) ELSE 3e-1 + 7e-1 * l_quantity / 5e1 END AS confidence,
                     1e0 - 5e0 * l_discount AS score,
                     CASE WHEN l_linestatus = 'F' THEN 'first' ELSE 'second' END AS engine
              FROM (SELECT *, {_plate("l_orderkey")} AS plate FROM {{lineitem}}))""",
    "truth": f"SELECT o_orderkey AS track_id, {_plate('o_orderkey')} AS truth, o_orderstatus AS split, CAST(o_totalprice AS DOUBLE) AS total FROM {{orders}}",
    "frames": """
        SELECT user_id % 7 AS video_id, event_id AS frame_index, event_id / 3e1 AS ts,
               CAST((event_id * 37) % 256 AS DOUBLE) AS brightness, CAST((event_id * 91) % 400 AS DOUBLE) AS blur_score
        FROM {events}""",
    # Vehicles: about four boxes a frame, one set of frames per video.
    "vehicles": """
        SELECT event_id % 5 AS video_id, CAST(floor(event_id / 2e1) AS BIGINT) AS frame_index, CAST(floor((event_id % 20) / 5e0) AS BIGINT) AS ord, event_id % 20 AS track_id,
               CAST(100 * floor((event_id % 20) / 5e0) + (event_id * 13) % 60 AS INT) AS x1, CAST((event_id * 29) % 300 AS INT) AS y1,
               CAST(100 * floor((event_id % 20) / 5e0) + (event_id * 13) % 60 + 40 + (event_id * 7) % 160 AS INT) AS x2,
               CAST((event_id * 29) % 300 + 30 + (event_id * 11) % 120 AS INT) AS y2,
               (event_id % 100) / 1e2 AS confidence, CAST(CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 0 END AS INT) AS class_id
        FROM {events}""",
    "plates": """
        SELECT event_id % 5 AS video_id, CAST(floor(event_id / 2e1) AS BIGINT) AS frame_index, event_id % 20 AS ord,
               CAST(100 * floor((event_id % 20) / 5e0) + (event_id * 17) % 120 AS INT) AS x1, CAST((event_id * 31) % 330 AS INT) AS y1,
               CAST(100 * floor((event_id % 20) / 5e0) + (event_id * 17) % 120 + 20 + event_id % 60 AS INT) AS x2,
               CAST((event_id * 31) % 330 + 10 + event_id % 40 AS INT) AS y2, ((event_id * 3) % 100) / 1e2 AS confidence
        FROM {events} WHERE event_id % 3 <> 0""",
    # Candidate crops of a track: one supplier's line items in order.
    "candidates": """
        SELECT track_id, 3 * ord AS frame_index, ord, source, w, h, confidence, variance, exposure, score
        FROM (SELECT l_suppkey AS track_id,
                     row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS ord,
                     CASE WHEN l_partkey % 3 = 0 THEN 'fallback' ELSE 'detection' END AS source,
                     CAST(20 + l_partkey % 180 AS INT) AS w, CAST(10 + l_quantity AS INT) AS h, 1e0 - 5e0 * l_discount AS confidence,
                     CAST(l_partkey % 2000 AS DOUBLE) AS variance, CAST(l_tax AS DOUBLE) AS exposure, l_quantity / 5e1 AS score
              FROM {lineitem})""",
    # Hand labels and the crops they belong to.
    "labeled": f"""
        SELECT lpad(CAST(p_partkey AS STRING), 6, '0') || '.jpg' AS image,
               CASE p_size % 7 WHEN 0 THEN 'No Plate' WHEN 1 THEN 'unreadable' ELSE {_plate('p_partkey')} END AS plate_text,
               CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 10 + p_size % 13 END AS INT) AS tl_x, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 12 + p_partkey % 9 END AS INT) AS tl_y,
               CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 90 + p_size END AS INT) AS tr_x, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 10 + p_partkey % 31 END AS INT) AS tr_y,
               CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 92 + p_size % 11 END AS INT) AS br_x, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 50 + p_partkey % 17 END AS INT) AS br_y,
               CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 8 + p_size % 5 END AS INT) AS bl_x, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 48 + p_partkey % 7 END AS INT) AS bl_y
        FROM {{part}}""",
    "manifest": """
        SELECT lpad(CAST(p_partkey AS STRING), 6, '0') || '.jpg' AS image, p_partkey % 311 AS track_id, p_size % 5 AS rank, 7 * p_partkey AS frame_index,
               CASE WHEN p_partkey % 3 = 0 THEN 'fallback' ELSE 'detection' END AS source, p_retailprice / 2e3 AS score, CAST(40 + p_size AS INT) AS width, CAST(15 + p_size % 40 AS INT) AS height
        FROM {part} WHERE p_partkey % 10 <> 7""",
}

DEPENDS = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str, *also: str) -> DataFrame:
    """A view over the tables of a folder; ``also`` names columns of its outer SELECT's table to be added."""
    sql = VIEWS[name].replace("SELECT ", f"SELECT {', '.join(also)}, ", 1) if also else VIEWS[name]
    return spark.sql(DEPENDS.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def with_views(*names: str, also: str = "") -> str:
    """The head of an oracle query: the views as common table expressions."""
    parts = [f"{n} AS ({DEPENDS.sub(lambda m: m[1], VIEWS[n])})" for n in names]
    return "WITH " + ",\n".join([*parts, *([also] if also else [])]) + "\n"


# What normalisation means, for the oracle: text in, plate out.
_VALID = "(regexp_matches({0}, '^[0-9]{{2}}[A-Z]{{1,2}}[0-9]{{3,6}}$') AND length({0}) BETWEEN 6 AND 10)"


def _valid(x: str) -> str:
    return _VALID.format(x)


def plates_of(source: str, text: str = "text", out: str = "plated") -> str:
    """CTEs that add ``plate`` to all columns of a source."""
    digits, head = "translate(substr(_c, {0}), 'OILBS', '01185')", "translate(substr(_c, 1, 2), 'OILBS', '01185') || translate(substr(_c, 3, 1), '012568', 'OIZSGB')"
    return f"""{out}_1 AS (
            SELECT *, regexp_replace(upper(coalesce({text}, '')), '[^0-9A-Z]', '', 'g') AS _c,
                   regexp_replace(regexp_replace(upper(coalesce({text}, '')), '[-. _/:\\s]', '-', 'g'), '[^-0-9A-Z]', '', 'g') AS _s FROM {source}),
        {out}_2 AS (
            SELECT *, CASE WHEN length(_c) < 6 THEN _c ELSE {head} || {digits.format(4)} END AS _one,
                   CASE WHEN length(_c) < 6 THEN _c ELSE {head} || substr(_c, 4, 1) || {digits.format(5)} END AS _two,
                   CASE WHEN regexp_matches(_s, '^-*[0-9A-Z]-*[0-9A-Z]-*[0-9A-Z]-') THEN 1 WHEN regexp_matches(_s, '^-*([0-9A-Z]-*){{3}}[0-9A-Z]-') THEN 2 END AS _l FROM {out}_1),
        {out}_3 AS (SELECT *, CASE _l WHEN 1 THEN _one WHEN 2 THEN _two END AS _a FROM {out}_2),
        {out} AS (
            SELECT * EXCLUDE (_c, _s, _one, _two, _l, _a),
                   CASE WHEN length(_c) < 6 THEN _c WHEN {_valid("_a")} THEN _a WHEN {_valid("_c")} THEN _c WHEN {_valid("_two")} THEN _two WHEN {_valid("_one")} THEN _one ELSE _c END AS plate
            FROM {out}_3)"""


def gate_of(source: str, out: str = "gated", least: float = 0.35) -> str:
    """CTE that adds the reason for which voting refuses a reading."""
    return f"""{out} AS (
            SELECT *, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN coalesce(confidence, 0) < {least} THEN 'low_confidence' WHEN plate = '' THEN 'empty_after_normalize'
                           WHEN NOT {_valid("plate")} THEN 'invalid_format' END AS reason FROM {source})"""
