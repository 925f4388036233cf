"""Accuracy of readings against truth, agreement of label sets, banded metrics."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import character_errors
from ..session import written


def with_ratio(rows: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """Ratcliff-Obershelp similarity of two strings, in Arrow batches; pairs repeat, so each is measured once a batch."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        for pair in zip(x.fillna(""), y.fillna(""), strict=True):
            if pair not in known:
                known[pair] = SequenceMatcher(None, *pair).ratio()
        return pd.Series([known[p] for p in zip(x.fillna(""), y.fillna(""), strict=True)])

    return rows.withColumn(out, ratio(F.col(a), F.col(b)))


def accuracy(rows: DataFrame, *keys: str, got: str = "got", truth: str = "truth") -> DataFrame:
    """Per key: rows, exact and empty ones, summed edit distance over summed truth length."""
    g, t = F.col(got), F.col(truth)
    n, distance, length = F.count("*"), F.sum(F.levenshtein(g, t).cast("long")), F.sum(F.length(t).cast("long"))
    return rows.groupBy(*keys).agg(n.alias("n"), F.count_if(g == t).alias("exact"), F.count_if(g == "").alias("empty"), distance.alias("distance"), length.alias("characters"), F.round(distance / length, 6).alias("cer"), F.round(F.count_if(g == t) / n, 6).alias("accuracy"))


def mean_cer(rows: DataFrame, *keys: str, got: str = "got", truth: str = "truth") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(character_errors(F.col(got), F.col(truth))).alias("mean_cer"))


def labelled(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner lookup of tracks (video, track) in labels (video, track, ground_truth) under three keys.

    The whole video path, then its base name, then an empty one; a label that is there but
    empty counts. One label per key: the greatest.
    """
    one = labels.groupBy("video", "track").agg(F.max("ground_truth").alias("label"), F.lit(True).alias("there"))
    base = F.regexp_extract("video", "([^/]*)$", 1)
    out = tracks
    for i, key in enumerate((F.col("video"), base, F.lit(""))):
        side = one.select(F.col("video").alias(f"_v{i}"), F.col("track").alias("_t"), F.col("label").alias(f"_l{i}"), F.col("there").alias(f"_h{i}"))
        out = out.withColumn("_key", key)
        out = out.join(side, (out["_key"] == side[f"_v{i}"]) & (out["track"] == side["_t"]), "left").drop("_t", "_key", f"_v{i}")
    pick = F.when(F.col("_h0"), F.col("_l0")).when(F.col("_h1"), F.col("_l1")).when(F.col("_h2"), F.col("_l2"))
    return out.where("_h0 or _h1 or _h2").withColumn("label", pick).drop(*[f"_{c}{i}" for c in "lh" for i in range(3)])


def agreement(model: DataFrame, human: DataFrame, key: str) -> DataFrame:
    """Full outer join of two flags per key; a missing side says no."""
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return model.select(key, "detected").join(human.select(key, "has_plate"), key, "full").select(key, flag("detected"), flag("has_plate"))


def two_by_two(rows: DataFrame) -> DataFrame:
    d, h = F.col("detected"), F.col("has_plate")
    return rows.agg(F.count_if(d & h).alias("both"), F.count_if(d & ~h).alias("model_only"), F.count_if(~d & h).alias("human_only"), F.count_if(~d & ~h).alias("neither"))


def values_at(rows: DataFrame, by: list[str], value: str, **places) -> DataFrame:
    """One row per group with its values in sorted order at the given places.

    places: column names and functions from the group's count of values to a place from 1.
    Nulls are left out, and so are groups without any other value. Equal values are counted
    before the shuffle; the counts are dealt by range of group and value and written, and only
    the parts that hold a wanted place are searched: a group may hold all rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    counts = written(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    parts = counts.groupBy(*by, "_part").agg(F.sum("_k").alias("_in"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_in").over(group))
    wanted = F.explode(F.create_map(*[c for name, place in places.items() for c in (F.lit(name), place(F.col("_all")).cast("long"))])).alias("_name", "_at")
    hits = parts.select(*by, "_part", "_before", "_in", wanted).where((F.col("_before") < F.col("_at")) & (F.col("_at") <= F.col("_before") + F.col("_in")))
    hits = hits.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_where"), "_name", (F.col("_at") - F.col("_before")).alias("_at"))
    same = counts["_part"] == hits["_where"]
    for c in by:
        same &= counts[c].eqNullSafe(hits[f"_{c}"])
    near = counts.join(hits, same)
    so_far = F.sum("_k").over(Window.partitionBy(*by, "_name").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = near.withColumn("_so_far", so_far).where(F.col("_so_far") >= F.col("_at"))
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in places])


def banded(rows: DataFrame, value: Column, detected: Column, by: str = "band") -> DataFrame:
    """Per band and over all (``all``): rows, detected, rate, mean and linear 90th percentile of the value."""
    each = rows.select(F.col(by), detected.alias("_d"), F.when(detected, value).cast("double").alias("_v"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_total"))
    each = each.withColumn(by, F.when(F.col("_total") == 0, F.col(by)))
    out = each.groupBy(by, "_total").agg(F.count("*").alias("n"), F.count_if("_d").alias("detected"), F.avg("_v").alias("mean"), F.count("_v").alias("_m"))
    at = lambda m: (m - 1) * F.lit(0.9)
    ends = values_at(each, [by, "_total"], "_v", low=lambda m: F.floor(at(m)) + 1, high=lambda m: F.ceil(at(m)) + 1)
    ends = ends.select(F.col(by).alias("_b"), F.col("_total").alias("_t"), "low", "high")
    out = out.join(ends, out[by].eqNullSafe(ends["_b"]) & (out["_total"] == ends["_t"]), "left")
    part = at(F.col("_m")) - F.floor(at(F.col("_m")))
    p90 = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    name = F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col(by))
    return out.select(name.alias(by), "n", "detected", "mean", p90.alias("p90"), (F.col("detected") / F.col("n")).alias("rate"))


def error_class(detected: Column, quad_iou: Column, box_iou: Column, least: float = 0.5) -> Column:
    """``miss``, ``good`` corners, right box with wrong corners, or a box elsewhere."""
    return F.when(~detected, "miss").when(quad_iou >= least, "good").when(box_iou >= least, "a_regression").otherwise("b_falsepos")


def nearest_ranks(rows: DataFrame, by: str, value: str, **shares: float) -> DataFrame:
    """Per group, for each name and share q: sorted[min(n - 1, int(n * q))] of its n values."""
    place = lambda q: lambda n: F.least(n, F.floor(n * F.lit(q)) + 1)
    return values_at(rows, [by], value, **{name: place(q) for name, q in shares.items()})


def bucket(value: Column, edges: list[float]) -> Column:
    """``<e`` below the first edge, ``a-b`` between, ``>=e`` from the last on."""
    label = lambda e: f"{e:g}"
    out = F.when(value < edges[0], f"<{label(edges[0])}")
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when((value >= a) & (value < b), f"{label(a)}-{label(b)}")
    return out.when(value >= edges[-1], f">={label(edges[-1])}")
