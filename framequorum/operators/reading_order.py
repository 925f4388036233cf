"""Items of one picture: shapes of engine results, and the order to read them in."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

ITEMS = "array<struct<text: string, confidence: double, box: array<array<double>>>>"


def points(box: Any) -> list[list[float]] | None:
    """A box as points: four numbers are two corners, more (an even count) are pairs; anything else is none."""
    if box is None:
        return None
    if all(isinstance(v, (int, float)) for v in box):
        return [[float(a), float(b)] for a, b in zip(box[::2], box[1::2], strict=True)] if len(box) >= 4 and len(box) % 2 == 0 else None
    flat = [float(v) for p in box for v in p]
    return [[a, b] for a, b in zip(flat[::2], flat[1::2], strict=True)]


def _named(entry: dict) -> list[dict] | None:
    for source in (entry, entry.get("res")):
        if not isinstance(source, dict):
            continue
        texts = next((source[k] for k in ("rec_texts", "rec_text") if source.get(k) is not None), None)
        if texts is None:
            continue
        texts = [texts] if isinstance(texts, str) else texts
        scores = next((source[k] for k in ("rec_scores", "rec_score") if source.get(k) is not None), [])
        scores = [scores] if isinstance(scores, (int, float)) else scores
        boxes = next((source[k] for k in ("rec_polys", "dt_polys", "rec_boxes") if source.get(k) is not None), [])
        return [{"text": str(t), "confidence": float(scores[i]) if i < len(scores) and isinstance(scores[i], (int, float)) else 1.0, "box": points(boxes[i]) if i < len(boxes) else None} for i, t in enumerate(texts)]
    return None


def _nested(node: Any) -> Iterator[dict]:
    if not isinstance(node, list):
        return
    if len(node) == 2 and isinstance(node[1], list) and len(node[1]) == 2 and isinstance(node[1][0], str):
        yield {"text": node[1][0], "confidence": float(node[1][1]), "box": points(node[0])}
        return
    for part in node:
        yield from _nested(part)


def parse_result(payload: str | None) -> list[dict]:
    """Items of an engine's JSON result, named fields or nested [box, [text, score]] lists; none for anything else."""
    try:
        raw = json.loads(payload) if payload else None
    except ValueError:
        return []
    entries = raw if isinstance(raw, list) else [raw]
    named = [item for e in entries if isinstance(e, dict) for item in _named(e) or ()]
    return named or list(_nested(raw))


def with_items(rows: DataFrame, payload: str = "payload", out: str = "items") -> DataFrame:
    @F.pandas_udf(ITEMS)
    def parsed(p: pd.Series) -> pd.Series:
        return p.map(parse_result)

    return rows.withColumn(out, parsed(F.col(payload)))


def in_reading_order(items: Column, tolerance: float = 0.6) -> Column:
    """Items of an array of (text, x, y, h) row by row, each from left to right, those without a place last.

    A fold over the items by height: an item joins the first row whose running mean is
    within ``tolerance`` of the median height; with fewer than two places nothing moves.
    """
    placed = F.filter(items, lambda i: i["x"].isNotNull() & i["y"].isNotNull())
    heights = F.array_sort(F.transform(placed, lambda i: F.greatest(F.lit(1.0), F.coalesce(i["h"], F.lit(0.0)))))
    n = F.size(heights)
    median = (F.get(heights, F.floor((n - 1) / 2).cast("int")) + F.get(heights, F.floor(n / 2).cast("int"))) / 2
    by_height = F.array_sort(F.transform(placed, lambda i, k: F.struct(i["y"].alias("y"), k.alias("k"), i["x"].alias("x"), i["text"].alias("text"))))
    none = F.array().cast("array<struct<mean: double, n: int, items: array<struct<x: double, k: int, text: string>>>>")
    item = lambda i: F.struct(i["x"].alias("x"), i["k"].alias("k"), i["text"].alias("text"))

    def add(rows: Column, i: Column) -> Column:
        fits = F.transform(rows, lambda r: F.abs(i["y"] - r["mean"]) <= median * tolerance)
        at = F.array_position(fits, True)
        joined = F.transform(rows, lambda r, k: F.when(k + 1 == at, F.struct(((r["mean"] * r["n"] + i["y"]) / (r["n"] + 1)).alias("mean"), (r["n"] + 1).alias("n"), F.concat(r["items"], F.array(item(i))).alias("items"))).otherwise(r))
        fresh = F.struct(i["y"].alias("mean"), F.lit(1).alias("n"), F.array(item(i)).alias("items"))
        return F.when(at > 0, joined).otherwise(F.concat(rows, F.array(fresh)))

    rows = F.array_sort(F.transform(F.aggregate(by_height, none, add), lambda r, k: F.struct(r["mean"].alias("mean"), k.alias("k"), r["items"].alias("items"))))
    ordered = F.flatten(F.transform(rows, lambda r: F.transform(F.array_sort(r["items"]), lambda i: i["text"])))
    rest = F.transform(F.filter(items, lambda i: i["x"].isNull() | i["y"].isNull()), lambda i: i["text"])
    return F.when(F.size(placed) < 2, F.transform(items, lambda i: i["text"])).otherwise(F.concat(ordered, rest))
