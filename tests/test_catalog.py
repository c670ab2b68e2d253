"""Catalog, validation, labeling requests, export and file round trips."""

import json

import pytest
from pyspark.sql import functions as F

from reelgrid import court, schemas
from reelgrid.operators import catalog as C
from reelgrid.operators import export as E
from reelgrid.operators import validation as V
from reelgrid.operators.frames import read_frames, sample_frames
from reelgrid.plans import labeling
from reelgrid.sources import readers, sinks

LOCK = {"schema_version": "3.0.0", "north_convention": "image_left_basket", "anchor_frame_id": "clipA_f000001", "method": "m", "locked_at": "t", "declared_end": None}


def table(spark, ddl, rows):
    names = [x.split(" ")[0] for x in readers._split(ddl)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


@pytest.fixture
def project(spark):
    clips = table(spark, schemas.CLIPS, [{"clip_id": "clipA", "width": 1920, "height": 1080, "orientation": LOCK}, {"clip_id": "clipB", "width": 10, "height": 10, "orientation": {**LOCK, "schema_version": "2.1.0"}}, {"clip_id": "empty"}])
    frames = table(spark, schemas.FRAMES, [
        {"frame_id": f"{c}_f{i:06d}", "clip_id": c, "frame_index": i, "image": f"frames/{c}/{i}.jpg", "triage": t, "label_status": s}
        for c, i, t, s in [("clipA", 1, "keep", "unlabeled"), ("clipA", 2, None, "unlabeled"), ("clipA", 3, "odd", "unlabeled"), ("clipB", 1, "skip", "labeled")]
    ])
    return clips, frames


def points(**changes):
    out = [{"x": str(100 + i), "y": str(200 + i), "v": "2", "src_conf": "0.0"} for i in range(22)]
    for k, v in changes.items():
        out[int(k[1:])] |= v
    return out


def submission(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"frame_id string, visible_ends string, keypoints {V.RAW_POINTS}, seq int")


def test_progress(spark, project):
    clips, frames = project
    got = {r.clip_id: tuple(r)[1:] for r in C.progress_counts(frames, clips).collect()}
    assert got == {None: (3, 4, 1, 1, 1, 1), "clipA": (1, 3, 1, 1, 0, 0), "clipB": (1, 1, 0, 0, 1, 1), "empty": (1, 0, 0, 0, 0, 0)}
    page, counts = labeling.frames_page(frames, clips, "clipA", "keep")
    assert [r.frame_id for r in page.collect()] == ["clipA_f000001"] and counts.first().candidates == 3
    assert [r.candidates for r in labeling.clips_page(clips, frames).collect()] == [3, 1, 0]


def test_submissions(spark, project):
    clips, frames = project
    good = "clipA_f000001"
    cases = [
        (good, None, points(), 400, "visible_ends", None), (good, "both", points()[:21], 400, "number of keypoints", None), ("nope", "both", points(), 404, "unknown frame", None),
        ("clipB_f000001", "both", points(), 409, "orientation", None), (good, "both", points(p4={"x": "x"}, p2={"v": "3"}), 400, "v", 3), (good, "both", points(p4={"x": "99999"}), 400, "outside", 5),
        (good, "both", points(p0={"x": "NaN"}), 400, "outside", 1), (good, "both", points(p0={"v": "1.9"}), 200, None, None), (good, "both", points(p0={"v": "0", "x": "99999"}), 200, None, None),
        (good, "north", points(), 422, "conflict", None), (good, "both", points(p21={"x": None}), 400, "not numeric", 22), (good, "both", points(p0={"v": "Infinity"}), 400, "not numeric", 1),
    ]
    got = V.validate_submissions(submission(spark, [c[:3] for c in cases]), frames, clips).orderBy("seq").collect()
    assert [(r.code, r.reason, r.position) for r in got] == [c[3:] for c in cases]
    assert got[9].conflicting_ids == [i for i in court.IDS if i.startswith("south")] and got[7].cleaned[0].v == 1 and tuple(got[8].cleaned[0]) == (0.0, 0.0, 0, 0.0)
    small = court.keypoint_table(spark).limit(5)
    assert V.validate_submissions(submission(spark, [(good, "both", points()[:5])]), frames, clips, small).first().code == 200


def test_save_prefill_and_migrate(spark, project):
    clips, frames = project
    labels = spark.createDataFrame([], schemas.LABELS)
    judged, labels, frames = labeling.submit_labels(submission(spark, [("clipA_f000001", "both", points(p0={"src_conf": "0.7"})), ("clipA_f000001", "both", points(p1={"x": "5"})), ("zz", "both", points())]), frames, clips, labels, "now")
    assert labels.count() == 1 and labels.first().keypoints[1].x == 5.0 and frames.where("label_status = 'labeled'").count() == 2
    pre = {r.frame_id: r for r in C.prefilled(frames, clips, labels).collect()}
    assert pre["clipA_f000001"].source == "saved" and pre["clipA_f000002"].source == "previous_frame" and pre["clipB_f000001"].code == 409
    assert all(p.src_conf == 0.0 for p in pre["clipA_f000003"].keypoints)
    model = spark.createDataFrame([("clipA_f000002", [(1.0, 1.0, 2, 0.5)] * 22)], f"frame_id string, keypoints {schemas.POINTS}")
    forced = {r.frame_id: r for r in C.prefilled(frames, clips, labels, model, predict=True).collect()}
    assert forced["clipA_f000002"].source == "predicted" and forced["clipA_f000002"].keypoints[0].x == 1.0 and forced["clipA_f000001"].source == "predicted"
    c2, f2, l2, counts = C.migrate(clips, frames, labels)
    assert tuple(counts.first()) == (0, 1, 1, True)
    assert tuple(C.migrate(c2, f2, l2)[3].first()) == (0, 0, 0, False) and c2.where("clip_id = 'clipB'").first().orientation is None


def test_orientation_lock_and_unlock(spark, project):
    clips, frames = project
    asked = spark.createDataFrame([
        ("clipB", "clipB_f000001", "declared", "east", "t", 1), ("clipB", "clipA_f000001", "both_ends_visible", None, "t", 2), ("clipB", "clipB_f000001", "declared", "north", "t", 3),
        ("clipB", "clipB_f000001", "both_ends_visible", None, "t", 4), ("clipA", "clipA_f000002", "both_ends_visible", None, "t", 5), ("none", "x", "both_ends_visible", None, "t", 6), ("clipB", "clipB_f000001", "odd", None, "t", 7),
    ], "clip_id string, frame_id string, mode string, declared_end string, locked_at string, seq int")
    after, verdict = C.lock_orientations(clips, frames, asked)
    assert [(r.code, r.already_locked) for r in verdict.orderBy("seq").collect()] == [(400, False), (400, False), (200, False), (200, True), (200, True), (404, False), (400, False)]
    b = labeling.orientation_of(after, "clipB").first().orientation
    assert (b.method, b.declared_end) == ("operator_declared_single_end", "north") and labeling.orientation_of(after, "clipA").first().orientation.anchor_frame_id == "clipA_f000001"
    free = spark.createDataFrame([("clipA", None), ("clipB", False), ("none", True)], "clip_id string, force boolean")
    unlocked, codes = C.unlock_orientations(after, frames, free)
    assert {r.clip_id: r.code for r in codes.collect()} == {"clipA": 200, "clipB": 409, "none": 404}
    assert {r.clip_id for r in unlocked.where("orientation is not null").collect()} == {"clipB"}


def test_upserts(spark, project):
    clips, frames = project
    ups = spark.createDataFrame([("clipA_f000001", "skip", 1), ("clipA_f000001", "pending", 2), ("clipA_f000002", "bad", 3), ("zz", "keep", 4)], "frame_id string, status string, seq int")
    after, refused = C.apply_triage(frames, ups)
    assert {r.frame_id: r.triage for r in after.collect()}["clipA_f000001"] == "pending" and sorted(r.code for r in refused.collect()) == [400, 404]
    sampled = frames.limit(0).unionByName(frames.where("clip_id = 'clipA'").withColumns({"image": F.lit("new"), "triage": F.lit("pending"), "label_status": F.lit("unlabeled")}).limit(1))
    merged = {r.frame_id: r for r in C.merge_frames(frames, sampled).collect()}
    assert len(merged) == 4 and sum(r.image == "new" for r in merged.values()) == 1 and merged["clipA_f000001"].triage == "keep" and merged["clipA_f000003"].triage == "odd"
    again = C.merge_clips(clips, clips.where("clip_id = 'clipA'").select("clip_id", "width"))
    assert again.where("clip_id = 'clipA'").first().orientation is None and again.count() == 3
    found = spark.createDataFrame([("a", 1, 1.0, 2.0), ("b", 1, 1.0, 2.0), ("c", 1, 1.0, 2.0)], "clip_id string, file_size long, file_mtime double, interval_s double")
    known = found.where("clip_id <> 'c'").withColumn("interval_s", F.when(F.col("clip_id") == "a", 3.0).otherwise(2.0))
    assert {r.clip_id for r in C.stale_clips(found, known).collect()} == {"a", "c"}


def test_sampling_is_cpythons(spark):
    from random import Random

    got = {}
    for r in sample_frames(spark.createDataFrame([("clip x", 30.0, 1.0, 100), ("e", None, 1.0, 0)], "clip_id string, fps double, interval_s double, frame_count long")).collect():
        got.setdefault(r.clip_id, []).append(r.frame_index)
    rng = Random("clip x")
    draws = [w + rng.randrange(30) for w in range(0, 120, 30)]
    assert got == {"clip x": [d for d in draws if d < 100]}
    rows = spark.range(20).select(F.col("id").alias("frame_index"))
    assert [r.frame_index for r in read_frames(rows, 3, None, 6).collect()] == [6, 9, 12, 15, 18]
    with pytest.raises(ValueError):
        read_frames(rows, 0)


def test_export(spark, project, tmp_path):
    clips, frames = project
    _, labels, frames = labeling.submit_labels(submission(spark, [("clipA_f000001", "both", points())]), frames, clips, spark.createDataFrame([], schemas.LABELS), "now")
    out = str(tmp_path / "export")
    counts = E.export(frames, labels, out, 0.5, packed=True)
    assert counts["train"] + counts["val"] == 1 and counts["missing"] == 1
    line = spark.read.text(f"{out}/labels").first().value.split("\t")
    assert line[0] == "clipA_f000001" and line[1].startswith("0 0.500000 0.500000 1.000000 1.000000 0.052083 0.185185 2")
    assert "flip_idx: [18, 17" in (tmp_path / "export" / "data.yaml").read_text()
    split = "train" if counts["train"] else "val"
    assert [tuple(r) for r in readers.read_split_listing(spark, out).collect()] == [("clipA_f000001", split)]
    (tmp_path / "pictures").mkdir()
    (tmp_path / "pictures" / "one.jpg").write_bytes(b"jpg")
    (tmp_path / "schema.json").write_text("{}")
    pictured = frames.withColumn("image", F.lit("one.jpg"))
    assert E.export(pictured, labels, out, 0.5, images=str(tmp_path / "pictures"), schema_file=str(tmp_path / "schema.json")) == counts
    assert (tmp_path / "export" / "labels" / split / "clipA_f000001.txt").read_text().strip() == line[1]
    assert (tmp_path / "export" / "images" / split / "clipA_f000001.jpg").read_bytes() == b"jpg" and (tmp_path / "export" / "schema.json").exists()
    assert [tuple(r) for r in readers.read_split_listing(spark, out).collect()] == [("clipA_f000001", split)]
    with pytest.raises(E.ExportRefused):
        E.export(frames, labels.withColumn("schema", F.lit(None).cast(schemas.SCHEMA_REF)), out)
    with pytest.raises(E.ExportRefused):
        E.export(frames.where("false"), labels, out)


def test_files(spark, project, tmp_path):
    clips, frames = project
    folder = str(tmp_path)
    none = readers.read_manifest(spark, folder)
    assert none[0].count() == none[1].count() == 0 and readers.read_labels(spark, folder).count() == 0 and readers.read_run_manifest(spark, folder) is None
    sinks.save_manifest(clips, frames, folder)
    c, f = readers.read_manifest(spark, folder)
    assert c.count() == 3 and f.where("triage = 'pending'").count() == 1 and c.where("clip_id = 'clipA'").first().orientation.schema_version == "3.0.0"
    for name in ("b.MP4", "a clip.mov", "x.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.clip_id for r in readers.list_videos(spark, folder).collect()] == ["a_clip", "b"]
    with pytest.raises(ValueError):
        readers.list_videos(spark, folder, "zz")
    for split, name in (("train", "f1"), ("train", "f2"), ("val", "f2")):
        (tmp_path / "e" / "labels" / split).mkdir(parents=True, exist_ok=True)
        (tmp_path / "e" / "labels" / split / f"{name}.txt").write_text("0")
    assert {tuple(r) for r in readers.read_split_listing(spark, str(tmp_path / "e")).collect()} == {("f1", "train"), ("f2", "val")}
    (tmp_path / "run" / "weights").mkdir(parents=True)
    assert readers.read_trained_frames(spark, str(tmp_path / "run" / "weights" / "best.pt")).count() == 0
    (tmp_path / "run" / "dataset_manifest.json").write_text(json.dumps({"frames": {"f1": "val"}}))
    assert readers.read_trained_frames(spark, str(tmp_path / "run" / "weights" / "best.pt")).first().trained_split == "val"
    (tmp_path / "d.svg").write_text('<svg xmlns="http://www.w3.org/2000/svg"><g id="kpt-1"><circle cx="475" cy="92"/><text>1</text></g><g id="other"/></svg>')
    assert tuple(readers.read_markers(spark, str(tmp_path / "d.svg")).first()) == ("kpt-1", 475.0, 92.0, "1")
    (tmp_path / "t.json").write_text(json.dumps({"template_name": "t", "length": 84.0, "width": 50.0, "court_xy_ft": {"a": [1.0, 2.0]}}))
    assert tuple(readers.read_template(spark, str(tmp_path / "t.json")).first()) == ("t", "a", 1.0, 2.0, 84.0, 50.0)
    sinks.reset_project(spark, folder)
    assert readers.read_manifest(spark, folder)[0].count() == 0


def test_listings_come_in_order(spark):
    import random

    from reelgrid.operators.catalog import clip_listing, frames_of

    ids = [f"f{i:03d}" for i in range(300)]
    random.Random(1).shuffle(ids)
    frames = spark.createDataFrame([(i, f"c{int(i[1:]) % 40:02d}", "keep", "unlabeled") for i in ids], "frame_id string, clip_id string, triage string, label_status string").repartition(7)
    assert [r.frame_id for r in frames_of(frames).collect()] == sorted(ids)
    clips = spark.createDataFrame([(f"c{i:02d}",) for i in random.Random(2).sample(range(50), 50)], "clip_id string").repartition(5)
    got = clip_listing(clips, frames).collect()
    assert [r.clip_id for r in got] == [f"c{i:02d}" for i in range(50)] and got[45].candidates == 0
