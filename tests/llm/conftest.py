import pytest

WORDS = "the and of to in that with for was on are by this from or an be at is it his her which have not had were they but one all would there their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value long, doc string, bucket string, _salt int, row string, key string"


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    extra = (7, "d", "b", 1, "r", "k")
    long = prose(1, 30_000)
    rows = [(1, prose(2, 200), "en", "a", 5), (2, prose(2, 200), "en", "a", 5), (2, prose(2, 200), "en", "a", 5), (3, None, "en", "a", None), (4, "", None, None, 0), (None, prose(3, 50), "en", "b", 1), (None, None, None, None, None), (5, long, "en", "b", 9), (6, "x" * 300, "en", "b", 1), (7, " \t\n", "fr", "c", 1), (8, "é日本😀 " * 40, "ja", "c", 1), (9, "one", "en", "", 1)]
    return [r + extra for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
