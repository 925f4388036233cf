"""Keys and row numbers beyond the digits of a name: queries still give their SQL's rows."""

import duckdb
import pandas as pd
import pytest

from framequorum.operators import tracks as TR
from framequorum.plans import boxes, media

from .test_queries import plain


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Parts 100000 to 100039, of six digits, and 1000000 to 1000399, whose images bear the same names."""
    folder = tmp_path_factory.mktemp("parts")
    keys = pd.Series([*range(100_000, 100_040), *range(1_000_000, 1_000_400)])
    pd.DataFrame({"p_partkey": keys, "p_size": (1 + keys * 31 % 47).astype("int32"), "p_retailprice": 900.0 + keys % 1000}).to_parquet(folder / "part.parquet")
    return str(folder)


def rows_of(columns, rows):
    return sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in rows)


def same_as_sql(spark, folder, table, query, sql):
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = query(spark, folder), con.sql(sql)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_labels_round_trip_by_the_name(spark, parts):
    same_as_sql(spark, parts, "part", boxes.src_label_round_trip, boxes.ORACLES["src_label_round_trip"])


def test_rows_of_one_image_are_one_quad(spark, parts):
    same_as_sql(spark, parts, "part", boxes.geo2_corner_order, boxes.ORACLES["geo2_corner_order"])


def test_numbers_are_cut_as_in_sql(spark, monkeypatch):
    ranked, base = TR.ranked, 12_345_670
    monkeypatch.setattr(TR, "ranked", lambda *a: (df := ranked(*a)).withColumn("_place", df["_place"] + base))
    sql = boxes.ORACLES["win8_sequence_numbers"].replace("row_number() OVER (ORDER BY track_id, ord)", f"{base} + row_number() OVER (ORDER BY track_id, ord)")
    same_as_sql(spark, "/root/testdata/sf0.001", "lineitem", boxes.win8_sequence_numbers, sql)


def test_one_row_an_image(spark, parts):
    same_as_sql(spark, parts, "part", media.img1_brightness_exposure, media.ORACLES["img1_brightness_exposure"])


def test_changes_of_split_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Keys that share image and track: of two such rows the earlier frame comes first, whatever the order of the file."""
    pairs = [(p, 10 * p + j) for p in range(100_000, 101_000) for j in range(10) if (9 * p + j) % 311 == 0 and 7 not in (p % 10, j)]
    keys = sorted(k for pair in pairs for k in pair)
    rows = pd.DataFrame({"p_partkey": keys, "p_size": [1 + k // 3 % 5 for k in keys], "p_retailprice": 1.0})
    seen, changes = {}, 0
    for image, key, size in sorted((f"{k}"[:6], k, z) for k, z in zip(rows["p_partkey"], rows["p_size"], strict=True)):
        split = size % 5 % 2
        changes += seen.get(key % 311, split) != split
        seen[key % 311] = split
    got = []
    for name, part in (("up", rows), ("down", rows[::-1])):
        (tmp_path / name).mkdir()
        part.astype({"p_size": "int32"}).to_parquet(tmp_path / name / "part.parquet", index=False)
        got.append(boxes.agg24_split_consistency(spark, str(tmp_path / name)).collect()[0]["changes"])
    assert len(pairs) > 10 and got == [changes, changes]
