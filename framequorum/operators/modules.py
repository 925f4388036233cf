"""Boundaries of what can be plugged in: functions from a picture to items, their failures, and the warnings they leave."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .reading_order import ITEMS

#: A detector, reader or recognition engine: bytes of a picture to items (dicts of text, confidence and box).
Engine = Callable[[bytes | None], list[dict]]
ITEM = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("box", pa.list_(pa.list_(pa.float64())))]))


def with_items(frames: DataFrame, *engines: tuple[str, Engine], image: str = "image", prefix: str = "") -> DataFrame:
    """Add ``items``, ``engine`` and ``warnings``: the first engine that does not fail gives a picture's items.

    Each failure leaves a warning and the next engine is asked; if all fail, items are empty
    and engine is null. Engines run in Arrow batches; one failing picture fails no other.
    """
    named = list(engines)

    def run(batches):
        for batch in batches:
            found, used, told = [], [], []
            for picture in batch.column(batch.schema.get_field_index(image)).to_pylist():
                items, name, warnings = [], None, []
                for name_, engine in named:
                    try:
                        items, name = [{"text": i.get("text"), "confidence": i.get("confidence"), "box": i.get("box")} for i in engine(picture)], name_
                        break
                    except Exception as e:  # a broken engine must not end the video
                        warnings.append(f"{name_}: {e}")
                found.append(items)
                used.append(name)
                told.append(warnings)
            for column, values, kind in (("items", found, ITEM), ("engine", used, pa.string()), ("warnings", told, pa.list_(pa.string()))):
                batch = batch.append_column(prefix + column, pa.array(values, kind))
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.mapInArrow(run, f"{fields}, {prefix}items {ITEMS}, {prefix}engine string, {prefix}warnings array<string>")


def ordered_union(*lists: Column) -> Column:
    """Every warning once, where it comes first; null lists are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]))
