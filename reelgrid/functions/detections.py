"""Arrays of detections of one frame: struct<xyxy, cls, name, conf, track_id>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BALL_CONFIDENCE = 0.3
W_EPSILON = 1e-12


def foot_point(box: Column) -> Column:
    return F.array((F.get(box, 0) + F.get(box, 2)) / 2, F.get(box, 3))


def centre(box: Column) -> Column:
    return F.array((F.get(box, 0) + F.get(box, 2)) / 2, (F.get(box, 1) + F.get(box, 3)) / 2)


def of_classes(dets: Column, names: Sequence[str] | None) -> Column:
    """None keeps all; a null list counts as empty."""
    some = F.coalesce(dets, F.array())
    return some if names is None else F.filter(some, lambda d: d["name"].isin(*names))


def at_least(dets: Column, confidence: float) -> Column:
    return F.filter(dets, lambda d: d["conf"] >= confidence)


def best(dets: Column, kind: str) -> Column:
    """The first of highest confidence, null if there is none; kind is the element's type."""
    return F.aggregate(dets, F.lit(None).cast(kind), lambda a, d: F.when(a.isNull() | (d["conf"] > a["conf"]), d).otherwise(a))


def named(cls: Column, names: Column) -> Column:
    """Name of a class id from a map, else the id as text."""
    return F.coalesce(F.try_element_at(names, cls), cls.cast("string"))


def carried_names(tracked: Column, seen: Column) -> Column:
    """Tracked detections with the name that the last seen detection of their class had."""
    last = F.map_from_entries(F.transform(
        F.array_distinct(F.transform(seen, lambda d: d["cls"])),
        lambda c: F.struct(c, F.element_at(F.filter(seen, lambda d: d["cls"] == c), -1)["name"]),
    ))
    return F.transform(tracked, lambda t: t.withField("name", F.coalesce(F.try_element_at(last, t["cls"]), t["cls"].cast("string"))))


def projected(h: Column, x: Column, y: Column) -> Column:
    """[across, along] of a pixel under a 3 x 3 matrix; 0 where the projective weight vanishes, null without a matrix."""
    row = lambda i: F.get(F.get(h, i), 0) * x + F.get(F.get(h, i), 1) * y + F.get(F.get(h, i), 2)
    w = row(2)
    one = lambda i: F.when(F.abs(w) < W_EPSILON, 0.0).otherwise(F.try_divide(row(i), w))
    return F.when(h.isNotNull(), F.array(one(0), one(1)))
