"""Arrays of keypoints, by position: struct<x, y, v, ...>."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelgrid import court
from reelgrid.schemas import SCHEMA_REF

MIN_CONFIDENCE = 0.25
HULL_PAD = 0.02


def point(x: Column, y: Column, v: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), v.cast("int").alias("v"))


def nothing() -> Column:
    return point(F.lit(0.0), F.lit(0.0), F.lit(0))


def empty_points(count: int = court.COUNT) -> Column:
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("v"), F.lit(0.0).alias("src_conf"))
    return F.array_repeat(none, count)


def canonical_from(points: Column, order: Sequence[str] | None = None) -> Column:
    """A model's own points in canonical order. Without an order there must be exactly 22 already;
    points the model lacks stay (0, 0, 0), positions it has not are skipped."""
    if order is None:
        return F.when(F.size(points) == court.COUNT, points).otherwise(
            F.raise_error(F.concat(F.lit(f"expected {court.COUNT} canonical points, got "), F.size(points).cast("string"))).cast("array<struct<x:double,y:double,v:int>>")
        )
    unknown = [i for i in order if i not in court.INDEX]
    if unknown:
        raise ValueError(f"unknown canonical id: {unknown[0]}")
    at = {cid: k for k, cid in enumerate(order)}
    return F.array(*[F.coalesce(F.get(points, at[c]), nothing()) if c in at else nothing() for c in court.IDS])


def gated(points: Column, decimals: bool = False, least: float = MIN_CONFIDENCE) -> Column:
    """struct<x, y, conf> -> visible (2) at the least confidence, else (0, 0, 0); a missing confidence counts as 1."""

    def gate(p: Column) -> Column:
        seen = F.coalesce(p["conf"], F.lit(1.0)) >= least
        return point(F.when(seen, p["x"]).otherwise(0.0), F.when(seen, p["y"]).otherwise(0.0), F.when(seen, 2).otherwise(0))

    return F.transform(points, gate)


def of_best_instance(instances: Column, point_type: str = "struct<x:double,y:double,conf:double>", count: int = court.COUNT) -> Column:
    """Gated points of the instance of highest conf, the first of equals, of array<struct<conf, points>>; unplaced points where there is none."""
    best = F.aggregate(
        instances, F.lit(None).cast(f"struct<conf:double,points:array<{point_type}>>"), lambda a, i: F.when(a.isNull() | (i["conf"] > a["conf"]), F.struct(i["conf"].cast("double").alias("conf"), i["points"].alias("points"))).otherwise(a),
    )
    return F.coalesce(gated(best["points"]), F.array_repeat(nothing(), count))


def defined(ids: Column, points: Column) -> Column:
    """struct<id, p> by position, as many as the shorter of both has."""
    n = F.least(F.size(points), F.size(ids))
    return F.arrays_zip(F.slice(ids, 1, n).alias("id"), F.slice(points, 1, n).alias("p"))


def visible_count(points: Column) -> Column:
    return F.size(F.filter(points, lambda p: p["v"] > 0))


def cleaned(points: Column) -> Column:
    """Unlabeled points lose their coordinates."""
    zero = lambda p, f: F.when(p["v"] == 0, 0.0).otherwise(F.coalesce(p[f], F.lit(0.0)))
    return F.transform(points, lambda p: F.struct(zero(p, "x").alias("x"), zero(p, "y").alias("y"), p["v"].alias("v"), zero(p, "src_conf").alias("src_conf")))


def conflicts(points: Column, ends: Column, ids: Column, visible_ends: Column) -> Column:
    """Ids of placed points of an end that is not visible, in schema order; points without a definition are left out."""
    n = F.least(F.size(points), F.size(ids))
    zipped = F.arrays_zip(F.slice(ids, 1, n).alias("id"), F.slice(ends, 1, n).alias("end"), F.slice(points, 1, n).alias("p"))
    against = F.filter(zipped, lambda z: (z["p"]["v"] > 0) & z["end"].isin("north", "south") & (z["end"] != visible_ends))
    return F.when(visible_ends == "both", F.array().cast("array<string>")).otherwise(F.transform(against, lambda z: z["id"]))


def clamped(x: Column, size: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(x, size)))


def point_text(points: Column, width: Column, height: Column) -> Column:
    """`x y v` of each point, normalised to six decimals."""

    def one(p: Column) -> Column:
        placed = F.format_string("%.6f %.6f %d", clamped(p["x"], width), clamped(p["y"], height), p["v"])
        return F.when(p["v"] == 0, F.lit("0.000000 0.000000 0")).otherwise(placed)

    return F.array_join(F.transform(points, one), " ")


def hull(points: Column, width: Column, height: Column) -> Column:
    """struct<x_min, x_max, y_min, y_max>, padded and clamped; null without a placed point."""
    placed = F.filter(points, lambda p: p["v"] > 0)

    def bound(axis: str, size: Column, low: bool) -> Column:
        values = F.transform(placed, lambda p: p[axis])
        return F.greatest(F.lit(0.0), F.array_min(values) / size - HULL_PAD) if low else F.least(F.lit(1.0), F.array_max(values) / size + HULL_PAD)

    box = F.struct(bound("x", width, True).alias("x_min"), bound("x", width, False).alias("x_max"), bound("y", height, True).alias("y_min"), bound("y", height, False).alias("y_max"))
    return F.when(F.size(placed) > 0, box)


def box_text(points: Column, width: Column, height: Column, mode: str = "full") -> Column:
    """`cx cy w h` of the whole image or of the hull."""
    whole = F.lit("0.500000 0.500000 1.000000 1.000000")
    if mode != "hull":
        return whole
    h = hull(points, width, height)
    text = F.format_string("%.6f %.6f %.6f %.6f", (h["x_min"] + h["x_max"]) / 2, (h["y_min"] + h["y_max"]) / 2, h["x_max"] - h["x_min"], h["y_max"] - h["y_min"])
    return F.when(h.isNotNull(), text).otherwise(whole)


def flipped(points: Column, order: Sequence[int] | None = None) -> Column:
    order = order if order is not None else court.flip_order()
    return F.array(*[F.get(points, i) for i in order])


def unplaced(p: Column) -> Column:
    return (p["x"] == 0) & (p["y"] == 0) & (p["v"] == 0)


def toggled(v: Column) -> Column:
    """Visible becomes occluded and back."""
    return F.when(v == 2, 1).otherwise(2)


def next_triage(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in ("pending", "keep", "keep", "skip", "skip", "pending")]), F.coalesce(status, F.lit("pending")))


def topmost_within(points: Column, x: Column, y: Column, radius: float = 12.0) -> Column:
    """Index of the last point within the radius; null if none."""
    at = F.filter(F.transform(points, lambda p, i: F.when((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y) <= radius * radius, i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.element_at(at, -1))


def to_screen(v: Column, offset: Column, scale: Column) -> Column:
    return v * scale + offset


def to_image(v: Column, offset: Column, scale: Column) -> Column:
    return F.try_divide(v - offset, scale)


def zoomed(scale: Column, steps: Column) -> Column:
    return F.least(F.lit(20.0), F.greatest(F.lit(0.05), scale * F.pow(F.lit(1.15), steps)))


def diagram_xy(along: Column, across: Column) -> Column:
    """Place on the court diagram of a point in feet: x from across, y from along."""
    return F.array(court.DIAGRAM_ORIGIN[0] + court.DIAGRAM_SCALE * across, court.DIAGRAM_ORIGIN[1] + court.DIAGRAM_SCALE * along)


def id_of(index: Column) -> Column:
    """Canonical id of an index from 0; null beyond."""
    return F.get(F.array(*map(F.lit, court.IDS)), index)


def index_of(cid: Column) -> Column:
    """Index from 0 of a canonical id; null for others."""
    at = F.array_position(F.array(*map(F.lit, court.IDS)), cid).cast("int")
    return F.when(at > 0, at - 1)


def schema_ref() -> Column:
    """Which schema a label was made by."""
    return F.struct(F.lit(court.SCHEMA_NAME).alias("schema_name"), F.lit(court.SCHEMA_VERSION).alias("schema_version")).cast(SCHEMA_REF)
