"""Plate strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Letters read for digits, digits read for letters, separators, and the plate format.
DIGIT_FOR = ("OILBS", "01185")
LETTER_FOR = ("012568", "OIZSGB")
SEPARATORS = r"[-. _/:\s]"
PLATE = "^[0-9]{2}[A-Z]{1,2}[0-9]{3,6}$"
SHORTEST, LONGEST = 6, 10


def charset(text: Column, keep: str = "") -> Column:
    """Upper case, only 0-9 and A-Z (and the characters of ``keep``)."""
    return F.regexp_replace(F.upper(text), f"[^0-9A-Z{keep}]", "")


def as_digits(text: Column) -> Column:
    return F.translate(text, *DIGIT_FOR)


def as_letters(text: Column) -> Column:
    return F.translate(text, *LETTER_FOR)


def by_position(text: Column, letters: int) -> Column:
    """Two digits, ``letters`` series letters (the second may be a digit), digits: read each character as its place wants."""
    from_here = lambda n: as_digits(text.substr(F.lit(n), F.length(text)))
    head = F.concat(as_digits(F.substring(text, 1, 2)), as_letters(F.substring(text, 3, 1)))
    fixed = F.concat(head, F.substring(text, 4, 1), from_here(5)) if letters == 2 else F.concat(head, from_here(4))
    return F.when(F.length(text) < SHORTEST, text).otherwise(fixed)


def series_letters(raw: Column) -> Column:
    """1 or 2 if the first separator that follows the third or fourth kept character tells; else null."""
    marked = F.regexp_replace(F.regexp_replace(F.upper(raw), SEPARATORS, "-"), "[^-0-9A-Z]", "")
    one = marked.rlike("^-*[0-9A-Z]-*[0-9A-Z]-*[0-9A-Z]-")
    two = marked.rlike("^-*(?:[0-9A-Z]-*){3}[0-9A-Z]-")
    return F.when(one, 1).when(two, 2)


def valid(plate: Column) -> Column:
    return F.coalesce(F.length(plate).between(SHORTEST, LONGEST) & plate.rlike(PLATE), F.lit(False))


def with_plate(df: DataFrame, text: str, raw: str | None = None, out: str = "plate") -> DataFrame:
    """Add the normalised plate of a text (``raw``: the reading with its separators, where known).

    The variant that the separators ask for wins if valid, then the cleaned text, then the
    variant with fewer changes; with no valid one the cleaned text stays. A Generate after
    the variants and one after the plate keep later filters from copying the expression,
    which would outgrow a compiled method.
    """
    source = F.col(text) if raw is None else F.when(F.trim(F.coalesce(F.col(raw), F.lit(""))) != "", F.col(raw)).otherwise(F.col(text))
    names = df.columns
    first = df.select("*", F.coalesce(source, F.lit("")).alias("_raw"))
    cleaned = charset(F.col("_raw"))
    first = first.select("*", cleaned.alias("_cleaned"))
    parts = F.struct(F.col("_cleaned").alias("_c"), by_position(F.col("_cleaned"), 1).alias("_one"), by_position(F.col("_cleaned"), 2).alias("_two"), series_letters(F.col("_raw")).alias("_letters"))
    second = first.select(*names, F.inline(F.array(parts)))
    c, one, two = F.col("_c"), F.col("_one"), F.col("_two")
    asked = F.when(F.col("_letters") == 1, one).when(F.col("_letters") == 2, two)
    plate = F.when(F.length(c) < SHORTEST, c).when(valid(asked), asked).when(valid(c), c).when(valid(two), two).when(valid(one), one).otherwise(c)
    return second.select(*names, F.inline(F.array(F.struct(plate.alias(out)))))


def display(plate: Column, two_line: Column | bool = False) -> Column:
    """``51F-12345``; on two lines and with more than four digits ``29-B1 12345``; others as they are."""
    head, series, digits = (F.regexp_extract(plate, "^([0-9]{2})([A-Z]{1,2})([0-9]{3,6})$", i) for i in (1, 2, 3))
    two = F.lit(two_line) if isinstance(two_line, bool) else two_line
    long = F.concat(head, F.lit("-"), series, F.substring(digits, 1, 1), F.lit(" "), digits.substr(F.lit(2), F.length(digits)))
    return F.when(~valid(plate), plate).when(two & (F.length(digits) > 4), long).otherwise(F.concat(head, series, F.lit("-"), digits))


def hamming(a: Column, b: Column) -> Column:
    """Places in which the common length of two strings differs."""
    n = F.least(F.length(a), F.length(b))
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(places, lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))))


def character_errors(predicted: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; with no truth 0 if nothing was read, else 1."""
    empty = F.when(F.length(predicted) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(truth) == 0, empty).otherwise(F.levenshtein(predicted, truth) / F.length(truth))


def label_text(text: Column) -> Column:
    """Trimmed; the ways to write that there is no plate become one."""
    trimmed = F.trim(text)
    return F.when(F.lower(trimmed).isin("no plate", "no_plate", "noplate"), "no_plate").otherwise(trimmed)


def file_of_url(url: Column) -> Column:
    """Base name of what follows the first ``=`` of the decoded query (or of the url, if it has none)."""
    query = F.url_decode(F.replace(F.regexp_extract(url, r"([^?]*)$", 1), F.lit("+"), F.lit("%2B")))
    value = F.regexp_replace(query, "^[^=]*=", "")
    return F.regexp_extract(F.replace(value, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


def image_range(image: Column) -> Column:
    """Label source of an image, from the number that its name starts with."""
    n = F.substring(image, 1, 6).try_cast("int")
    return F.when(n <= 200, "1-200").when(n <= 400, "201-400").when(n <= 600, "401-600").when(n <= 800, "601-800").when(n.isNotNull(), "801-1701")
