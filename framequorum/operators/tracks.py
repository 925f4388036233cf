"""Track lifecycles and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written


def lifecycle(seen: DataFrame) -> DataFrame:
    """Per track: first and last frame, hits, and the box, class and confidence of the last row."""
    last = F.max_by(F.struct("x1", "y1", "x2", "y2", "class_id", "confidence"), F.struct("frame_index", "ord")).alias("_l")
    out = seen.groupBy("track_id").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count("*").alias("hits"), last)
    return out.select("track_id", "first_frame", "last_frame", "hits", "_l.*")


def streaks(seen: DataFrame, key: str = "track_id") -> DataFrame:
    """Gaps and islands: hits in a row without a missed frame, and frames missed before each row."""
    w = Window.partitionBy(key).orderBy("frame_index")
    gap = F.col("frame_index") - F.lag("frame_index").over(w)
    rows = seen.withColumn("missed", F.coalesce(gap - 1, F.lit(0))).withColumn("_new", F.when(gap == 1, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    return rows.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_island").orderBy("frame_index"))).drop("_new", "_island")


def interpolated(rows: DataFrame, value: str, key: str = "track_id", order: str = "ord") -> DataFrame:
    """Fill gaps of a series: on the line between its neighbours by position; edges take the nearest; a series of nulls is 0."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("_i", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    ends = {"_a": F.last(value, ignorenulls=True).over(before), "_ai": F.last(at, ignorenulls=True).over(before), "_b": F.first(value, ignorenulls=True).over(after), "_bi": F.first(at, ignorenulls=True).over(after)}
    rows = rows.withColumns(ends)
    step = (F.col("_b") - F.col("_a")) / (F.col("_bi") - F.col("_ai")).cast("double")
    inside = F.col("_a") + step * (F.col("_i") - F.col("_ai"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), inside)
    return rows.withColumn(value, F.coalesce(filled, "_a", "_b", F.lit(0.0)).cast("double")).drop("_i", *ends)


def ranked(rows: DataFrame, *order: str, out: str = "_place") -> DataFrame:
    """Add the place of every row, from 1, in the order of the columns (nulls first; equal rows in any order).

    Rows are dealt by range, sorted and written once; a row's place is its index in its part
    and the sizes of the parts before, of which there are as many as shuffle partitions.
    """
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("_part").count().select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(offsets), "_part").withColumn(out, place).drop("_id", "_part", "_before")


def counts_before(rows: DataFrame, key: str) -> DataFrame:
    """(key, _n, _before): rows of every value of key, and of all smaller values (nulls come first).

    The counts are dealt by range and written; each part adds up its own and takes the sums of
    the parts before, so no task sees all values.
    """
    sizes = written(rows.groupBy(key).agg(F.count("*").alias("_n")).repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.groupBy("_part").agg(F.sum("_n").alias("_sum")).select("_part", so_far("_sum", Window.orderBy("_part")).alias("_offset"))
    own = sizes.withColumn("_own", so_far("_n", Window.partitionBy("_part").orderBy(key)))
    return own.join(F.broadcast(offsets), "_part").select(key, "_n", (F.col("_offset") + F.col("_own")).alias("_before"))


def numbered(rows: DataFrame, *order: str, by: str = "image", digits: int = 6, suffix: str = ".jpg") -> DataFrame:
    """Names 000001.jpg, 000002.jpg, … in the order of the given columns; longer numbers keep all their digits."""
    number = F.col("_place").cast("string")
    name = F.concat(F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number), F.lit(suffix))
    return ranked(rows, *order).withColumn(by, name).drop("_place")


def budgeted(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows over all tracks in order of track and ord: a global limit, found by counts per track.

    Whole tracks come through without a sort; only the track at the limit is ranked. Rows
    without a track come first.
    """
    sizes = counts_before(rows, "track_id").where(F.col("_before") < most).withColumnRenamed("track_id", "_track")
    near = rows.join(sizes, F.col("track_id").eqNullSafe(F.col("_track")))
    whole = F.col("_before") + F.col("_n") <= most
    cut = ranked(near.where(~whole).withColumnRenamed("_before", "_smaller"), "ord").where(F.col("_smaller") + F.col("_place") <= most)
    return near.where(whole).select(rows.columns).unionByName(cut.select(rows.columns))


def split_by_group(groups: DataFrame, key: str, fraction: float, seed: str = "42") -> DataFrame:
    """Whole groups to ``val`` or ``test``: round(n * fraction) of them, in the order of a hash, are ``val``.

    groups has one row per group. The cut is a rank over hashed ids; ranks come from counts per
    hash prefix, so groups are not sorted in one task.
    """
    hashed = groups.select(key, F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))).alias("_h")).withColumn("_s", F.substring("_h", 1, 2))
    sizes = hashed.groupBy("_s").count()
    total = F.sum("count").over(Window.partitionBy())
    offsets = sizes.select("_s", F.coalesce(F.sum("count").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), total.alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_h", key))
    out = hashed.withColumn("_r", rank).join(F.broadcast(offsets), "_s")
    return out.select(key, F.when(F.col("_before") + F.col("_r") <= F.bround(F.col("_n") * F.lit(fraction), 0), "val").otherwise("test").alias("split"))


def every_step(rows: DataFrame, order: str, step: int, extremes: list[Column], each: int) -> DataFrame:
    """Systematic sample by order, and the ``each`` first rows by each of the extreme orders, without repetition.

    Sampling is the feature; ``order`` tells rows apart.
    """
    out = ranked(rows, order).where((F.col("_place") - 1) % step == 0).drop("_place")
    for e in extremes:
        out = out.unionByName(rows.orderBy(e, order).limit(each))
    return out.dropDuplicates([order])
