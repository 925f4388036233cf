import pytest

from framequorum.functions import text as T
from framequorum.operators.vote import vote
from framequorum.config import VoteRules
from pyspark.sql import functions as F

# Readings and the plates they stand for.
NORMAL = {
    "51F-12345": "51F12345", "51F-123.45": "51F12345", "5IF-12345": "51F12345", "5lF-l2345": "51F12345", "S1F-12345": "51F12345", "S1F12345": "51F12345", "5OF-12345": "50F12345",
    "51LD-1234": "51LD1234", "29-B1 12345": "29B112345", "": "", "51F-12ấ": "51F12", "ABC123": "ABC123", "AAC123": "AAC123", "ABCDEFGH": "ABCDEFGH",
}
VALID = {"51F12345": True, "29H1234": True, "29B112345": True, "51F12": False, "51123456": False, "51F-1234": False, "51F1234567": False}


def test_normalise(spark):
    rows = T.with_plate(spark.createDataFrame([(k,) for k in NORMAL], "text string"), "text").collect()
    assert {r.text: r.plate for r in rows} == NORMAL


def test_normalise_prefers_the_reading_with_separators(spark):
    cases = [("5LFL2345", "5lF-l2345", "51F12345"), ("51LD1234", "51-LD 1234", "51LD1234"), ("29B112345", "29-B1 12345", "29B112345"), ("51F12345", None, "51F12345")]
    rows = T.with_plate(spark.createDataFrame(cases, "text string, raw string, want string"), "text", "raw").collect()
    assert all(r.plate == r.want for r in rows)


def test_normalising_a_valid_plate_changes_nothing(spark):
    good = [k for k, v in VALID.items() if v]
    rows = T.with_plate(spark.createDataFrame([(k,) for k in good], "text string"), "text").collect()
    assert all(r.plate == r.text for r in rows)


def test_valid(spark):
    rows = spark.createDataFrame([(k,) for k in [*VALID, None]], "p string").select("p", T.valid(F.col("p")).alias("v")).collect()
    assert {r.p: r.v for r in rows} == VALID | {None: False}


@pytest.mark.parametrize(("plate", "two", "want"), [("51F12345", False, "51F-12345"), ("29B112345", True, "29-B1 12345"), ("ABC", False, "ABC")])
def test_display(spark, plate, two, want):
    assert spark.range(1).select(T.display(F.lit(plate), two).alias("d")).first().d == want


def test_distances(spark):
    r = spark.range(1).select(T.hamming(F.lit("51F"), F.lit("5IF1")).alias("h"), T.hamming(F.lit(""), F.lit("a")).alias("z"), T.character_errors(F.lit(""), F.lit("")).alias("e"), T.character_errors(F.lit("x"), F.lit("")).alias("f"), T.character_errors(F.lit("ab"), F.lit("abcd")).alias("c")).first()
    assert tuple(r) == (1, 0, 0.0, 1.0, 0.5)


def test_file_of_url(spark):
    r = spark.range(1).select(T.file_of_url(F.lit("/data/local-files/?d=test%5C000407.jpg")).alias("a"), T.file_of_url(F.lit("x/y.png")).alias("b")).first()
    assert tuple(r) == ("000407.jpg", "y.png")


READINGS = [("51F-12345", 0.95), ("51F12345", 0.90), ("5IF-l2345", 0.88), ("51F-1234S", 0.35), ("ABC123", 0.99), ("", 0.99)]


def _readings(spark, rows, track=1):
    return spark.createDataFrame([(track, i + 1, t, c) for i, (t, c) in enumerate(rows)], "track_id long, ord long, text string, confidence double")


def test_vote(spark):
    r = vote(_readings(spark, READINGS), VoteRules(min_confidence=0.4)).first()
    assert (r.plate, r.votes, r.accepted, r.total, r.rejected, r.reliable) == ("51F12345", 3, 3, 6, 3, True)


def test_short_track_is_not_reliable(spark):
    r = vote(_readings(spark, [("29H1234", 0.9)] * 2), VoteRules(min_readings=3)).first()
    assert (r.plate, r.votes, r.reliable) == ("29H1234", 2, False)


def test_ties_go_to_the_surer_then_the_first(spark):
    assert vote(_readings(spark, [("51F12345", 0.5), ("51F12346", 0.9)])).first().plate == "51F12346"
    assert vote(_readings(spark, [("51F12346", 0.9), ("51F12345", 0.9)])).first().plate == "51F12346"


def test_nothing_accepted(spark):
    r = vote(_readings(spark, [(None, None), ("x", 0.9)])).first()
    assert (r.plate, r.votes, r.accepted, r.mean_confidence, r.reliable) == ("", 0, 0, 0.0, False)


def test_empty_table(spark):
    assert vote(_readings(spark, READINGS).limit(0)).count() == 0


def test_similarity_of_readings(spark):
    """Twice the matched characters over all of them; the longest run first, then what is left and right of it."""
    from framequorum.operators.evaluate import with_ratio

    # Pairs and their similarity, worked out by hand.
    want = {("abcd", "bcde"): 0.75, ("51F12345", "51F12345"): 1.0, ("51F12345", "51F12346"): 0.875, ("abxcd", "abcd"): 8 / 9, ("ab", "cd"): 0.0, ("", ""): 1.0, (None, ""): 1.0, (None, "a"): 0.0}
    rows = spark.createDataFrame([*want, *want], "a string, b string")
    got = [((r.a, r.b), r.ratio) for r in with_ratio(rows, "a", "b").collect()]
    assert len(got) == 2 * len(want) and all(v == pytest.approx(want[k]) for k, v in got)
