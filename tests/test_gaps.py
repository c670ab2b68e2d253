"""Probe, decode stop, extraction, pictures, label files, migration on disk, instance pick, batches, schema check."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelgrid import court, schemas
from reelgrid.functions import keypoints as K
from reelgrid.plans import extraction
from reelgrid.plans.inference import with_model
from reelgrid.sources import readers, sinks
from reelgrid.sources.video import FrameReader, probed, until_decode_failure


def test_probe(spark):
    def probe(path):
        if "broken" in path:
            raise OSError("no video")
        return {"fps": float("nan") if "odd" in path else 25.0, "width": 640, "height": 360, "frame_count": 100}

    videos = spark.createDataFrame([("a.mp4",), ("odd.mp4",), ("broken.mp4",)], "path string")
    got = {r.path: (r.fps, r.width, r.frame_count, r.probe_error) for r in probed(videos, probe).collect()}
    assert got == {"a.mp4": (25.0, 640, 100, None), "odd.mp4": (30.0, 640, 100, None), "broken.mp4": (None, None, None, "OSError: no video")}
    assert probed(videos.limit(0), probe).count() == 0


def test_reader_asks_the_probe(tmp_path, monkeypatch):
    (tmp_path / "probing.py").write_text("def info(path):\n    return {'fps': 0, 'frame_count': 7}\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    r = FrameReader({"path": "x", "probe": "probing:info"})
    assert (r.fps, r.stop) == (30.0, 7)
    assert FrameReader({"path": "x", "probe": "probing:info", "fps": "12", "frame_count": "3"}).stop == 3


@pytest.mark.parametrize("missing, last", [((), 48), ((0,), None), ((24,), 22), ((20, 22, 24, 26, 28), 18), ((30, 40), 28), ((48,), 46)])
def test_decode_stop(spark, missing, last):
    """Within a range of ten, what follows a missing frame is missing as well, as a range ends there."""
    gone = {x for m in missing for x in range(m, m // 10 * 10 + 10)}
    rows = [(p, i) for p in ("a", "b") for i in range(0, 50, 2) if p == "b" or i not in gone]
    got = until_decode_failure(spark.createDataFrame(rows, "path string, frame_index long"), 2, 0, 10).groupBy("path").agg(F.max("frame_index").alias("m"), F.count("*").alias("n"))
    want = {"b": (48, 25)} | ({"a": (last, last // 2 + 1)} if last is not None else {})
    assert {r.path: (r.m, r.n) for r in got.collect()} == want


def found(spark, rows):
    return spark.createDataFrame([(c, f"{c}.mp4", f"/v/{c}.mp4", 10.0, 640, 360, n, size, 1.0) for c, n, size in rows], "clip_id string, filename string, path string, fps double, width int, height int, frame_count long, file_size long, file_mtime double")


def test_extraction(spark):
    for bad in ({"reset": True, "force": True}, {"reset": True, "clip": "a"}, {"interval_s": 0}, {"interval_s": float("nan")}):
        with pytest.raises(ValueError):
            extraction.Request(**bad)
    none = spark.createDataFrame([], schemas.CLIPS), spark.createDataFrame([], schemas.FRAMES)
    videos = found(spark, [("a", 100, 5), ("b", 40, 6)])
    clips, frames, sampled, counts = extraction.plan(videos, *none, extraction.Request())
    n = sampled.count()
    assert counts.first().asDict() == {"processed": 2, "skipped": 0, "new_frames": n} and frames.count() == n >= 6
    clips, frames = spark.createDataFrame(clips.collect(), schemas.CLIPS), spark.createDataFrame(frames.collect(), schemas.FRAMES)
    assert extraction.plan(videos, clips, frames, extraction.Request())[3].first().asDict() == {"processed": 0, "skipped": 2, "new_frames": 0}
    assert extraction.plan(videos, clips, frames, extraction.Request(force=True, clip="b"))[3].first().asDict() == {"processed": 1, "skipped": 0, "new_frames": 0}
    changed = found(spark, [("a", 100, 5), ("b", 80, 7)])
    c2, f2, s2, counts = extraction.plan(changed, clips, frames, extraction.Request())
    assert (r := counts.first()).processed == 1 and r.skipped == 1 and r.new_frames >= 1
    assert c2.count() == 2 and f2.count() == n + r.new_frames and {x.clip_id for x in s2.collect()} == {"b"}
    assert extraction.plan(videos, clips, frames, extraction.Request(clip="zz"))[3].first().asDict() == {"processed": 0, "skipped": 0, "new_frames": 0}


def test_pictures(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "frames/a/f1.jpg", "thumbs/a/f1.jpg", bytearray(b"xyz")), ("f2", "frames/a/f2.jpg", "thumbs/a/f2.jpg", bytearray(b"pq"))], "frame_id string, image string, thumb string, payload binary")
    for folder in (str(tmp_path / "one"), f"file://{tmp_path}/two"):
        for _ in range(2):
            got = sinks.write_pictures(rows, folder, lambda p, w: bytes(p) + str(w).encode()).collect()
        assert {(r.frame_id, r.image_bytes, r.thumb_bytes) for r in got} == {("f1", 7, 6), ("f2", 6, 5)}
    for name in ("one", "two"):
        assert (tmp_path / name / "frames/a/f1.jpg").read_bytes() == b"xyzNone" and (tmp_path / name / "thumbs/a/f2.jpg").read_bytes() == b"pq320"
        assert sorted(os.listdir(tmp_path / name / "thumbs/a")) == ["f1.jpg", "f2.jpg"]


def label(frame, version):
    return (frame, 10, 10, 1, (court.SCHEMA_NAME, version), None, "both", [(1.0, 2.0, 2, 0.0)], "t")


def test_label_files_and_migration(spark, tmp_path):
    folder = str(tmp_path)
    frames = spark.createDataFrame([(f"f{i}", "a b", i, 0.0, None, None, "keep", "labeled") for i in range(3)], schemas.FRAMES)
    labels = spark.createDataFrame([label("f0", "3.0.0"), label("f1", "2.1.0"), label("unknown", "3.0.0")], schemas.LABELS)
    clip = {"clip_id": "a b", "orientation": ("2.0.0", "image_left_basket", "f0", "m", "t", None)}
    clips = spark.createDataFrame([tuple(clip.get(c) for c in spark.createDataFrame([], schemas.CLIPS).columns)], schemas.CLIPS)
    for _ in range(2):
        assert sinks.write_labels(labels, frames, folder) == 2
    shown = lambda: sorted(n for n in os.listdir(tmp_path / "labels" / "a b") if not n.startswith("."))
    assert shown() == ["f0.json", "f1.json"]
    assert json.loads((tmp_path / "labels" / "a b" / "f0.json").read_text())["keypoints"] == [{"x": 1.0, "y": 2.0, "v": 2, "src_conf": 0.0}]
    back = readers.read_labels(spark, folder)
    assert sorted(back.collect()) == sorted(labels.where("frame_id <> 'unknown'").collect())
    assert sinks.migrate_project(clips, frames, back, folder) == {"removed": 1, "reset": 2, "unlocked": 1, "changed": True}
    assert shown() == ["f0.json"]
    stored = json.loads((tmp_path / "manifest.json").read_text())
    assert {k: v["label_status"] for k, v in stored["frames"].items()} == {"f0": "labeled", "f1": "unlabeled", "f2": "unlabeled"} and "orientation" not in stored["clips"]["a b"]
    clips, frames = clips.withColumn("orientation", F.lit(None).cast(schemas.ORIENTATION)), frames.where("frame_id = 'f0'")
    before = os.stat(tmp_path / "manifest.json").st_mtime_ns
    assert not sinks.migrate_project(clips, frames, readers.read_labels(spark, folder), folder)["changed"]
    assert os.stat(tmp_path / "manifest.json").st_mtime_ns == before


def test_instance_pick(spark):
    kind = "array<struct<conf:double,points:array<struct<x:double,y:double,conf:double>>>>"
    low, high, twin = (0.2, [(1.0, 1.0, 0.9)]), (0.8, [(2.0, 3.0, 0.9), (4.0, 5.0, 0.1), (6.0, 7.0, None)]), (0.8, [(9.0, 9.0, 0.9)])
    rows = spark.createDataFrame([(0, [low, high, twin]), (1, []), (2, None), (3, [(None, None)])], f"k int, s {kind}")
    got = {r.k: [tuple(p) for p in r.p] for r in rows.select("k", K.of_best_instance(F.col("s")).alias("p")).collect()}
    none = [(0.0, 0.0, 0)] * court.COUNT
    assert got == {0: [(2.0, 3.0, 2), (0.0, 0.0, 0), (6.0, 7.0, 2)], 1: none, 2: none, 3: none}


def test_batches(spark):
    def build():
        return lambda b: [len(b)] * len(b)

    got = with_model(spark.range(10).coalesce(1), build, "n", "long", batch=4)
    assert sorted(r.n for r in got.collect()) == [2, 2] + [4] * 8
    assert with_model(spark.range(0), build, "n", "long", batch=4).count() == 0


@pytest.mark.parametrize("indices, good", [([1, 2, 3], True), ([1, 3, 2], False), ([0, 1, 2], False), ([1, 2], False), ([], False)])
def test_schema_check(spark, tmp_path, indices, good):
    path = str(tmp_path / "s.json")
    points = [{"index": i, "id": f"p{i}", "feature": "f", "end": "mid", "side": "east", "court_position": "x", "court_xy_ft": [1, 2], "diagram_xy": [1, 2]} for i in indices]
    with open(path, "w") as f:
        json.dump({"schema_name": "n", "schema_version": "3", "visible_ends_values": [], "reference_court": {"length": 84, "width": 50}, "keypoints": points}, f)
    if good:
        assert readers.read_keypoint_schema(spark, path, 3).count() == 3
    else:
        with pytest.raises(readers.BadSchema):
            readers.read_keypoint_schema(spark, path, 3)


def test_rounding_half_way(spark):
    from reelgrid.functions import scalars as S

    values = [0.5, 1.5, 2.675, 0.125, 1.005, -0.35, 1013.315 / 7, None]
    got = spark.createDataFrame(pd.DataFrame({"x": values})).select(S.round_all_like_python(F.array("x"), 2).alias("a"), S.round_like_python(F.col("x"), 1).alias("b")).collect()
    for v, r in zip(values[:-1], got[:-1], strict=True):
        assert r.a == [round(v, 2)] and r.b == round(v, 1)


def test_tracks_do_not_depend_on_batches(spark):
    """Shots longer than a batch, frames across its edge, frames without boxes, empty input."""
    import numpy as np

    from reelgrid.operators.tracking import Tracker, track

    rng, rows, want = np.random.default_rng(5), [], set()
    for run in ("a", None):
        for shot in range(3):
            tracker = Tracker(5)
            for frame in range(12):
                n = int(rng.integers(0, 4))
                boxes = np.array([[60.0 * i + frame + shot, 5.0, 60.0 * i + frame + shot + 30, 50.0] for i in range(n)]).reshape(n, 4)
                conf = rng.uniform(0.05, 1, n).round(3)
                want |= {(run, shot, frame, i, int(t)) for i, t in enumerate(tracker.update(boxes, conf)) if t}
                rows += [(run, shot, frame, i, *map(float, boxes[i]), float(conf[i])) for i in range(n)] or [(run, shot, frame, None, None, None, None, None, None)]
    ddl = "run_id string, shot_id int, frame_index long, det_no int, x1 double, y1 double, x2 double, y2 double, conf double"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "4", old):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {tuple(r) for r in track(spark.createDataFrame(rows, ddl), 5.0).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert track(spark.createDataFrame([], ddl), 5.0).count() == 0
