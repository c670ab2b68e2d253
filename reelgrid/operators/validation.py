"""Rules over label submissions, keypoint schemas, mirror pairs, templates and diagrams, as rows of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import court
from reelgrid.functions import keypoints as K
from reelgrid.operators.catalog import valid_orientation
from reelgrid.schemas import POINTS, VISIBLE_ENDS

RAW_POINTS = "array<struct<x:string,y:string,v:string,src_conf:string>>"


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _not_a_number(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def validate_submissions(submissions: DataFrame, frames: DataFrame, clips: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """submissions (frame_id, visible_ends, keypoints as RAW_POINTS) with code, reason, position, conflicting_ids and cleaned keypoints.

    The first failing rule is reported: visible_ends, number of points, unknown frame, no
    locked orientation, then the first failing point (not numeric, v, bounds), then points
    of an end that is not visible. Fractions of v are cut off as an integer cast does.
    """
    spark = submissions.sparkSession
    table = definitions if definitions is not None else court.keypoint_table(spark)
    rows = sorted(table.select("index", "id", "end").collect())  # of a fixed, small size
    ids, ends, count = F.array(*[F.lit(r["id"]) for r in rows]), F.array(*[F.lit(r["end"]) for r in rows]), len(rows)
    c = clips.select("clip_id", F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h"), valid_orientation(F.col("orientation")).isNotNull().alias("_locked"))
    f = frames.select("frame_id", "clip_id").join(c, "clip_id").withColumn("_frame", F.lit(True)).drop("clip_id")
    # submissions are wide and many may name one frame, or an unknown one: they stream past the narrow frames, unsorted
    out = submissions.join(f.hint("shuffle_hash"), "frame_id", "left")

    def judge(p: Column) -> Column:
        x, y, v = _number(p["x"]), _number(p["y"]), _number(p["v"])
        conf = _number(F.coalesce(p["src_conf"], F.lit("0")))
        infinite = F.abs(v) == float("inf")
        whole = F.when(~_not_a_number(v) & ~infinite & (F.abs(v) < 2e9), v.cast("int"))
        numeric = x.isNotNull() & y.isNotNull() & ~_not_a_number(v) & ~infinite & conf.isNotNull()
        inside = x.between(0.0, F.col("_w")) & y.between(0.0, F.col("_h")) & ~F.isnan(x) & ~F.isnan(y)
        return F.when(~numeric, "not numeric").when(~F.coalesce(whole.isin(0, 1, 2), F.lit(False)), "v").when((whole != 0) & ~inside, "outside")

    judged = F.col("_judged")  # a column of its own, as place and reason are both taken from it
    at = F.array_position(F.transform(judged, lambda j: j.isNotNull()), True)
    clean = K.cleaned(F.transform("keypoints", lambda p: F.struct(
        _number(p["x"]).alias("x"), _number(p["y"]).alias("y"), _number(p["v"]).cast("int").alias("v"), _number(p["src_conf"]).alias("src_conf"),
    ))).cast(POINTS)
    static = (
        F.when(~F.coalesce(F.col("visible_ends").isin(*VISIBLE_ENDS), F.lit(False)), F.struct(F.lit(400).alias("code"), F.lit("visible_ends").alias("reason")))
        .when(~F.coalesce(F.size("keypoints") == count, F.lit(False)), F.struct(F.lit(400).alias("code"), F.lit("number of keypoints").alias("reason")))
        .when(F.col("_frame").isNull(), F.struct(F.lit(404).alias("code"), F.lit("unknown frame").alias("reason")))
        .when(~F.col("_locked"), F.struct(F.lit(409).alias("code"), F.lit("orientation").alias("reason")))
    )
    out = out.withColumns({"_static": static, "_judged": F.transform("keypoints", judge)}).withColumn("_at", F.when(F.col("_static").isNull(), at))
    out = out.withColumn("_clean", F.when(F.col("_static").isNull() & (F.col("_at") == 0), clean))
    out = out.withColumn("conflicting_ids", F.when(F.col("_clean").isNotNull(), K.conflicts(F.col("_clean"), ends, ids, F.col("visible_ends"))))
    point_reason = F.when(F.col("_at") > 0, F.get(judged, (F.col("_at") - 1).cast("int")))
    conflict = F.size(F.coalesce("conflicting_ids", F.array().cast("array<string>"))) > 0
    return out.select(
        *submissions.columns, F.coalesce(F.col("_static.code"), F.when(F.col("_at") > 0, 400), F.when(conflict, 422), F.lit(200)).alias("code"),
        F.coalesce(F.col("_static.reason"), point_reason, F.when(conflict, "conflict")).alias("reason"), F.when(F.col("_at") > 0, F.col("_at").cast("int")).alias("position"),
        "conflicting_ids", F.when(~conflict, F.col("_clean")).alias("cleaned"),
    )


def _violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rule(df: DataFrame, broken: Column, rule: str, subject: str = "id") -> DataFrame:
    return df.where(F.coalesce(broken, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def keypoint_violations(points: DataFrame, length: float, width: float, origin: tuple = court.DIAGRAM_ORIGIN, scale: float = court.DIAGRAM_SCALE, view_box: tuple = court.VIEW_BOX) -> DataFrame:
    """Rows (rule, subject) for each rule of the keypoint schema that a row of it breaks; a null breaks the rule it is needed for."""
    along, across = F.get("court_xy_ft", 0), F.get("court_xy_ft", 1)
    dx, dy = F.get("diagram_xy", 0), F.get("diagram_xy", 1)
    ordinal = points.agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("lo"), F.max("index").alias("hi"), F.count_distinct("index").alias("d"))
    gap = ordinal.where("n = 0 or lo <> 1 or hi <> n or d <> n").select(F.lit("contiguous index").alias("rule"), F.lit("index").alias("subject"))
    twice = points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("unique id").alias("rule"), F.col("id").alias("subject"))
    end_side = {
        "end": ~F.col("end").isin(*court.ENDS), "side": ~F.col("side").isin(*court.SIDES), "feature": F.trim("feature") == "",
        "id starts with end": F.col("end").isin("north", "south") & ~F.startswith("id", F.concat("end", F.lit("_"))),
        "id ends with side": F.col("side").isin("east", "west") & ~F.endswith("id", F.concat(F.lit("_"), "side")),
        "inside the court": ~(along.between(0.0, length) & across.between(0.0, width)),
        "centre axis": (F.col("side") == "center") & (across != width / 2), "mid axis": (F.col("end") == "mid") & (along != length / 2),
        "diagram": (F.abs(dx - (origin[0] + scale * across)) > court.TOLERANCE) | (F.abs(dy - (origin[1] + scale * along)) > court.TOLERANCE),
        "view box": ~(dx.between(view_box[0], view_box[2]) & dy.between(view_box[1], view_box[3])),
    }
    return _violations([gap, twice, *[_rule(points, broken, name) for name, broken in end_side.items()]])


def pair_violations(points: DataFrame, pairs: DataFrame, length: float, width: float) -> DataFrame:
    """Rows (rule, subject) of mirror pairs (pair_set, id_a, id_b) that do not mirror, and of points paired too often or not at all."""
    side = lambda p: points.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "end", "side", "court_xy_ft")])
    both = pairs.join(side("a"), F.col("id_a") == F.col("a_id"), "left").join(side("b"), F.col("id_b") == F.col("b_id"), "left")
    both = both.withColumn("pair", F.concat_ws("|", "pair_set", "id_a", "id_b"))
    ew = F.col("pair_set") == "east_west"
    known = both.where("a_id is not null and b_id is not null")
    swap_a, swap_b = (F.when(ew, F.col(f"{p}_side")).otherwise(F.col(f"{p}_end")) for p in "ab")
    keep_a, keep_b = (F.when(ew, F.col(f"{p}_end")).otherwise(F.col(f"{p}_side")) for p in "ab")
    fixed = F.when(ew, F.lit(0)).otherwise(F.lit(1))
    xy = lambda p, i: F.get(F.col(f"{p}_court_xy_ft"), i)
    other = 1 - fixed
    want = F.when(ew, F.sort_array(F.array(F.lit("east"), F.lit("west")))).otherwise(F.sort_array(F.array(F.lit("north"), F.lit("south"))))
    total = F.when(ew, F.lit(float(width))).otherwise(F.lit(float(length)))
    parts = [
        both.where("a_id is null or b_id is null").select(F.lit("unknown id").alias("rule"), F.col("pair").alias("subject")),
        _rule(known, keep_a != keep_b, "shares", "pair"), _rule(known, F.sort_array(F.array(swap_a, swap_b)) != want, "swaps", "pair"),
        _rule(known, xy("a", fixed) != xy("b", fixed), "keeps coordinate", "pair"), _rule(known, F.abs(xy("a", other) + xy("b", other) - total) > court.TOLERANCE, "mirrors", "pair"),
    ]
    members = pairs.select("pair_set", F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("pair_set", "id").agg(F.count(F.lit(1)).alias("n"))
    parts.append(members.where("n > 1").select(F.lit("in one pair").alias("rule"), F.concat_ws("|", "pair_set", "id").alias("subject")))
    axis = points.select("id", F.explode(F.array(
        F.struct(F.lit("east_west").alias("s"), (F.col("side") == "center").alias("on")), F.struct(F.lit("north_south").alias("s"), (F.col("end") == "mid").alias("on")),
    )).alias("x")).select("id", F.col("x.s").alias("pair_set"), F.col("x.on").alias("on_axis"))
    placed = axis.join(members, ["pair_set", "id"], "left")
    parts.append(placed.where(F.col("n").isNotNull() == F.col("on_axis")).select(F.lit("paired or on the axis").alias("rule"), F.concat_ws("|", "pair_set", "id").alias("subject")))
    return _violations(parts)


def template_violations(template: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (rule, subject) of one template (id, along, across, length, width) against the canonical points and pairs."""
    p = points.select(F.col("id").alias("p_id"), "end", "side")
    both = template.join(p, F.col("id") == F.col("p_id"), "full")
    missing = both.where("id is null").select(F.lit("missing id").alias("rule"), F.col("p_id").alias("subject"))
    extra = both.where("p_id is null").select(F.lit("extra id").alias("rule"), F.col("id").alias("subject"))
    known = both.where("id is not null and p_id is not null")
    off = lambda a, b: F.abs(a - b) > court.TOLERANCE
    parts = [
        missing, extra, _rule(known, ~(F.col("along").between(F.lit(0.0), F.col("length")) & F.col("across").between(F.lit(0.0), F.col("width"))), "inside the court"),
        _rule(known, (F.col("side") == "center") & off(F.col("across"), F.col("width") / 2), "centre axis"),
        _rule(known, (F.col("end") == "mid") & off(F.col("along"), F.col("length") / 2), "mid axis"),
    ]
    t = lambda q: template.select(F.col("id").alias(f"{q}_id"), F.col("along").alias(f"{q}_along"), F.col("across").alias(f"{q}_across"), F.col("length").alias(f"{q}_l"), F.col("width").alias(f"{q}_w"))
    m = pairs.join(t("a"), F.col("id_a") == F.col("a_id")).join(t("b"), F.col("id_b") == F.col("b_id")).withColumn("pair", F.concat_ws("|", "pair_set", "id_a", "id_b"))
    ew = F.col("pair_set") == "east_west"
    keep = F.when(ew, off(F.col("a_along"), F.col("b_along"))).otherwise(off(F.col("a_across"), F.col("b_across")))
    sums = F.when(ew, off(F.col("a_across") + F.col("b_across"), F.col("a_w"))).otherwise(off(F.col("a_along") + F.col("b_along"), F.col("a_l")))
    return _violations([*parts, _rule(m, keep, "shares", "pair"), _rule(m, sums, "mirrors", "pair")])


def marker_violations(markers: DataFrame, points: DataFrame, id_format: str = "kpt-%d") -> DataFrame:
    """Rows (rule, subject) of diagram markers (id, cx, cy, label) against the points: groups, place and label."""
    want = points.select(F.format_string(id_format, "index").alias("w_id"), "index", "diagram_xy")
    both = markers.join(want, F.col("id") == F.col("w_id"), "full")
    groups = both.where("id is null or w_id is null").select(F.lit("marker groups").alias("rule"), F.coalesce("id", "w_id").alias("subject"))
    known = both.where("id is not null and w_id is not null")
    off = (F.abs(F.col("cx") - F.get("diagram_xy", 0)) > court.TOLERANCE) | (F.abs(F.col("cy") - F.get("diagram_xy", 1)) > court.TOLERANCE)
    return _violations([groups, _rule(known, off, "marker place"), _rule(known, F.trim("label") != F.col("index").cast("string"), "marker label")])


def header_violations(header: DataFrame) -> DataFrame:
    """header (schema_name, schema_version, visibility_values, visible_ends_values, flip_uses) of a keypoint schema."""
    rules = {
        "schema_name": F.col("schema_name") != court.SCHEMA_NAME, "schema_version": ~F.startswith("schema_version", F.lit("3.")),
        "visibility_values": F.sort_array("visibility_values") != F.array(F.lit("0"), F.lit("1"), F.lit("2")),
        "visible_ends_values": F.col("visible_ends_values") != F.array(*[F.lit(v) for v in VISIBLE_ENDS]), "flip_uses": ~F.col("flip_uses").isin("east_west", "north_south"),
    }
    return _violations([_rule(header, broken, name, "schema_name") for name, broken in rules.items()])
