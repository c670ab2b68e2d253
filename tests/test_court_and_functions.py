"""Canonical court, scalar functions, keypoints and detections."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reelgrid import court, schemas
from reelgrid.functions import detections as D
from reelgrid.functions import keypoints as K
from reelgrid.functions import scalars as S
from reelgrid.operators import validation as V


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_flip_order_is_the_mirror_image():
    order = court.flip_order()
    assert order == [18, 17, 16, 15, 14, 13, 20, 19, 21, 9, 10, 11, 12, 5, 4, 3, 2, 1, 0, 7, 6, 8]
    # a camera from the west sideline: x grows along the court, y falls across it
    see = lambda along, across, length, flip: ((1920 - (300 + 16 * along)) if flip else 300 + 16 * along, 1000 - 14 * across)
    feet = court.template("nfhs_84x50")
    flipped = [see(*feet[court.IDS[j]], 84, True) for j in order]
    begin = 1920 - 300 - 16 * 84
    mirrored = [(begin + 16 * feet[i][0], 1000 - 14 * feet[i][1]) for i in court.IDS]
    assert flipped == mirrored
    wrong = court.flip_order("east_west")
    assert [see(*feet[court.IDS[j]], 84, True) for j in wrong] != mirrored


def test_templates(spark):
    assert court.templates() == ["nba_94x50", "nfhs_84x50"] and court.COUNT == 22
    nba = court.template("nba_94x50")
    assert nba["north_three_point_apex"] == (29.0, 25.0) and {nba[f"north_lane_baseline_{s}"][1] for s in ("east", "west")} == {17.0, 33.0}
    with pytest.raises(court.UnknownTemplate):
        court.template("none")
    assert court.template_table(spark).count() == 44
    assert [len(v) for v in court.mirror_pairs().values()] == [10, 9]


def test_rules_find_what_is_broken(spark):
    points, pairs = court.keypoint_table(spark), court.pair_table(spark)
    assert V.keypoint_violations(points, 84.0, 50.0).count() == 0 and V.pair_violations(points, pairs, 84.0, 50.0).count() == 0
    bad = points.withColumn("side", F.when(F.col("index") == 1, "west").otherwise(F.col("side"))).withColumn("index", F.when(F.col("index") == 3, 30).otherwise(F.col("index")))
    rules = {(r.rule, r.subject) for r in V.keypoint_violations(bad, 84.0, 50.0).collect()}
    assert {("id ends with side", court.IDS[0]), ("contiguous index", "index")} == rules
    assert {r.rule for r in V.pair_violations(bad, pairs, 84.0, 50.0).collect()} == {"swaps", "shares"}
    moved = court.template_table(spark).where("template = 'nba_94x50'").withColumn("along", F.when(F.col("id") == "north_three_point_apex", 30.0).otherwise(F.col("along"))).where("id <> 'midcourt_sideline_west'")
    got = {(r.rule, r.subject.split("|")[-1]) for r in V.template_violations(moved, points, pairs).collect()}
    assert got == {("missing id", "midcourt_sideline_west"), ("mirrors", "south_three_point_apex")}
    markers = points.select(F.format_string("kpt-%d", "index").alias("id"), F.get("diagram_xy", 0).alias("cx"), (F.get("diagram_xy", 1) + F.when(F.col("index") == 5, 1).otherwise(0)).alias("cy"), F.col("index").cast("string").alias("label")).where("id <> 'kpt-7'")
    assert {(r.rule, r.subject) for r in V.marker_violations(markers, points).collect()} == {("marker groups", "kpt-7"), ("marker place", "kpt-5")}
    header = spark.createDataFrame([("basketball-court-keypoints", "2.1.0", ["0", "1", "2"], ["north", "south", "both"], "north_south")], "schema_name string, schema_version string, visibility_values array<string>, visible_ends_values array<string>, flip_uses string")
    assert [r.rule for r in V.header_violations(header).collect()] == ["schema_version"]


def test_rounding_is_pythons(spark):
    rng = random.Random(1)
    values = [2.675, 0.125, 12.345, 1.005, -0.5, 2.5, float("nan"), None, 1e300] + [rng.uniform(-100, 100) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 4):
        for r in df.select("v", S.round_like_python(F.col("v"), digits).alias("r")).collect():
            assert (r.r is None) if r.v is None else math.isnan(r.r) if math.isnan(r.v) else r.r == round(r.v, digits)


def test_names_and_rates(spark):
    row = one(spark, S.clip_id(F.lit("/a/b/My clip (1).v2.MP4")), S.frame_id(F.lit("c"), F.lit(7)), S.sample_step(F.lit(2.5), F.lit(1.0)), S.sample_step(F.lit(29.97), F.lit(2.0)),
              S.stride(F.lit(30.0), F.lit(0.0)), S.stride(F.lit(30.0), F.lit(5.0)), S.valid_fps(F.lit(float("nan"))), S.valid_fps(F.lit(0.0)), S.frame_limit(F.lit(2.0), F.lit(30.0), F.lit(None).cast("long")),
              S.frame_limit(F.lit(2.0), F.lit(30.0), F.lit(7).cast("long")), S.shard_name(F.lit(3)), S.run_dir(F.lit("v"), F.lit("nba")), S.thumb_height(F.lit(1920), F.lit(1080), F.lit(320)))
    assert tuple(row) == ("My_clip_1_v2", "c_f000007", 2, 60, 1, 6, 30.0, 30.0, 60, 7, "seg_00003.jsonl", "v.nba", 180)
    assert S.resume_key(10, 5.9, {"a": 1}).startswith("10-5-") and S.resume_key(10, 5.9, {"a": 1}) != S.resume_key(10, 5.9, {"a": 2})


def test_split_is_sha1(spark):
    import hashlib

    ids = [f"clip_f{i:06d}" for i in range(300)]
    got = {r.i: r.s for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", S.split_of(F.col("i"), 0.15).alias("s")).collect()}
    assert all(got[i] == ("val" if int(hashlib.sha1(i.encode()).hexdigest(), 16) % 100 < 15 else "train") for i in ids)


def pts(*rows):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(v).alias("v"), F.lit(0.5).alias("src_conf")) for x, y, v in rows])


def test_keypoints(spark):
    p = pts((10, 20, 2), (30, 40, 0), (120, -5, 1))
    row = one(spark, K.visible_count(p), K.point_text(p, F.lit(100.0), F.lit(100.0)), K.box_text(p, F.lit(100.0), F.lit(100.0), "hull"), K.box_text(p, F.lit(100.0), F.lit(100.0)),
              K.box_text(pts((1, 1, 0)), F.lit(9.0), F.lit(9.0), "hull"), K.topmost_within(p, F.lit(31.0), F.lit(41.0)), K.topmost_within(p, F.lit(500.0), F.lit(41.0)))
    assert row[0] == 2 and row[1] == "0.100000 0.200000 2 0.000000 0.000000 0 1.000000 0.000000 1"
    assert row[2] == "0.540000 0.110000 0.920000 0.220000" and row[3] == row[4] == "0.500000 0.500000 1.000000 1.000000" and row[5] == 1 and row[6] is None
    ids, ends = F.array(*map(F.lit, "abc")), F.array(F.lit("north"), F.lit("south"), F.lit("mid"))
    row = one(spark, K.conflicts(p, ends, ids, F.lit("south")), K.conflicts(p, ends, ids, F.lit("both")), K.conflicts(pts((1, 1, 2), (1, 1, 2)), ends, ids, F.lit("north")), K.cleaned(p), K.next_triage(F.lit("skip")), K.toggled(F.lit(2)))
    assert row[0] == ["a"] and row[1] == [] and row[2] == ["b"] and tuple(row[3][1]) == (0.0, 0.0, 0, 0.0) and row[4] == "pending" and row[5] == 1


def test_canonical_order(spark):
    assert len(set(court.EIGHTEEN_POINT_ORDER)) == 18
    own = F.array(*[F.struct(F.lit(float(i)).alias("x"), F.lit(0.0).alias("y"), F.lit(2).alias("v")) for i in range(18)])
    got = one(spark, K.canonical_from(own, court.EIGHTEEN_POINT_ORDER))[0]
    assert len(got) == 22 and sum(p.v for p in got) == 36
    assert all(got[court.INDEX[c]].x == i for i, c in enumerate(court.EIGHTEEN_POINT_ORDER)) and got[8].v == 0
    assert sum(p.v for p in one(spark, K.canonical_from(F.slice(own, 1, 3), court.EIGHTEEN_POINT_ORDER))[0]) == 6
    with pytest.raises(ValueError):
        K.canonical_from(own, ["nowhere"])
    with pytest.raises(PySparkException):
        one(spark, K.canonical_from(own))


def test_gate(spark):
    raw = F.array(*[F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(c).cast("double").alias("conf")) for c in (0.25, 0.24, None)])
    assert [p.v for p in one(spark, K.gated(raw))[0]] == [2, 0, 2]


def dets(*rows):
    return F.array(*[F.struct(F.array(F.lit(0.0), F.lit(1.0), F.lit(4.0), F.lit(9.0)).alias("xyxy"), F.lit(c).alias("cls"), F.lit(n).alias("name"), F.lit(f).alias("conf"), F.lit(t).cast("long").alias("track_id")) for c, n, f, t in rows]).cast(f"array<{schemas.DETECTION}>")


def test_detections(spark):
    d = dets((0, "Player", 0.9, 1), (0, "Player", 0.8, 2), (1, "Scoreboard", 0.95, 3), (2, "Hoop", 0.9, 4))
    row = one(spark, F.size(D.of_classes(d, ("Player",))), F.size(D.of_classes(d, None)), D.best(d, schemas.DETECTION)["track_id"], D.best(D.at_least(d, 0.99), schemas.DETECTION),
              D.best(D.of_classes(d, ("Player", "Hoop")), schemas.DETECTION)["track_id"], D.foot_point(F.get(d, 0)["xyxy"]), D.centre(F.get(d, 0)["xyxy"]), F.transform(D.carried_names(dets((0, "?", 1.0, 1), (7, "?", 1.0, 1)), d), lambda x: x["name"]))
    assert tuple(row) == (2, 4, 3, None, 1, [2.0, 9.0], [2.0, 5.0], ["Player", "7"])
    flat = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in ([2, 0, 1], [0, 2, 3], [0, 0, 1])])
    vanish = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in ([2, 0, 1], [0, 2, 3], [0, 0, 0])])
    row = one(spark, D.projected(flat, F.lit(5.0), F.lit(6.0)), D.projected(vanish, F.lit(5.0), F.lit(6.0)), D.projected(F.lit(None).cast("array<array<double>>"), F.lit(5.0), F.lit(6.0)))
    assert tuple(row) == ([11.0, 15.0], [0.0, 0.0], None)
