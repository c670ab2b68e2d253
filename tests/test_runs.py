"""Runs part by part, frame sources, streams of records, file sinks, and the operators that work on whole batches."""

import json
import math
import pathlib
import random
import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelgrid import court, schemas
from reelgrid.functions import keypoints as K
from reelgrid.functions import scalars as S
from reelgrid.operators import export
from reelgrid.operators import shots as O
from reelgrid.operators.frames import sample_frames
from reelgrid.operators.homography import solve, solve_all, with_homography
from reelgrid.operators.tracking import Tracker
from reelgrid.plans import game
from reelgrid.plans.inference import KINDS, Model, models_of, with_models
from reelgrid.sources import named_files, readers, sinks
from reelgrid.sources.video import video_frames
from tests import decoding
from reelgrid.streaming.records import RunProcessor, record_stream, write_record_stream

NBA = game.profile("nba")
DDL = f"run_id string, frame_index long, timestamp_s double, hist array<double>, keypoints array<struct<x:double,y:double,v:int>>, players array<{schemas.DETECTION}>, balls array<{schemas.DETECTION}>, error string"


def hist(grey):
    return [1.0 if i == grey // 4 else 0.0 for i in range(64)]


def clip(spark, n=24, cuts=(), failing=(), run="clip.nba", seed=1, stride=1):
    """Boxes that drift, cross and go missing, so that what a tracker holds matters."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        boxes = [(20.0 + 5 * k, 10.0, 0.9), (220.0 - 5 * k, 12.0, 0.9 if k % 4 else 0.15), (100.0, 200.0 + 3 * k, 0.5)]
        players = [([x, y, x + 24, y + 50], 0, "Player", c, None) for x, y, c in boxes if rng.random() > 0.2] + [([0.0, 0.0, 9.0, 9.0], 1, "Scoreboard", 0.95, None)]
        keys = [(10.0 + (i % 4) * 20 + k, 10.0 + (i // 4) * 20, 2) if i < 8 else (0.0, 0.0, 0) for i in range(22)]
        ball = [([5.0, 5.0, 15.0, 15.0], 2, "Ball", 0.6 if k % 2 == 0 else 0.1, None)]
        grey = 20 + 200 * (sum(c <= k for c in cuts) % 2)
        rows.append((run, k * stride, round(k * stride / 30, 3), hist(grey), keys, players, ball, "ValueError: bad" if k in failing else None))
    return spark.createDataFrame(rows, DDL)


def lines(folder):
    return [json.loads(x) for n in sorted(pathlib.Path(folder, "records").glob("seg_*.jsonl")) for x in n.read_text().splitlines()]


def expected(spark, frames, config):
    return {r.frame_index: r for r in game.records(frames, NBA, config, config.target_fps).collect()}


@pytest.mark.parametrize(("cuts", "failing", "checkpoint"), [((), (), None), ((7, 13, 14), (3, 11, 12, 13), 6), ((10,), range(8, 16), 25)])
def test_parts_give_the_records_of_the_whole_run(spark, tmp_path, cuts, failing, checkpoint):
    frames = clip(spark, cuts=cuts, failing=failing)
    config = game.Config(target_fps=30.0, segment_frames=8, checkpoint_frames=checkpoint)
    info = {"fps": 30.0, "width": 640, "height": 360, "frame_count": 24}
    m = game.run_game(frames, str(tmp_path), NBA, config, key="k", video_info=info)
    want = expected(spark, frames, config)
    got = lines(tmp_path)
    assert [r["frame_index"] for r in got] == list(range(24)) and m["video_info"] == info
    for r in got:
        w = want[r["frame_index"]]
        assert (r["shot_id"], r["scene_cut"], r["error"]) == (w.shot_id, w.scene_cut, w.error)
        assert [p["track_id"] for p in r["players"]] == [p.track_id for p in w.players]
    assert [s["n_records"] for s in m["segments"]] == [8] * 3 and m["status"] == "done"


def test_blocks_give_the_order_of_the_whole_run(spark):
    frames = clip(spark, 40, (7, 23, 24), (3, 11, 12, 13), "one").unionByName(clip(spark, 30, (5,), range(10, 20), "two"))
    config = game.Config(segment_frames=8, max_consecutive_errors=4)
    shown = lambda f: sorted(f.select("run_id", "frame_index", "shot_id", "scene_cut", "error_run", "segment_index", "aborted").collect())
    assert shown(game.ordered(frames, config)) == shown(game.ordered(frames, config, block=9))


class Killed(BaseException):
    pass


def counting(folder):
    """A model that notes which frames it sees."""

    def build():
        def model(b):
            with open(f"{folder}/seen", "a") as f:
                f.writelines(f"{i}\n" for i in b["frame_index"])
            return [None] * len(b)

        return model

    return [Model("balls", f"array<{schemas.DETECTION}>", build)]


def test_models_see_each_sampled_frame_once(spark, tmp_path):
    config = game.Config(target_fps=10.0, segment_frames=4)
    game.run_game(clip(spark, n=30), str(tmp_path / "run"), NBA, config, key="k", models=counting(tmp_path))
    assert sorted(map(int, (tmp_path / "seen").read_text().split())) == list(range(0, 30, 3))


def test_a_shot_that_never_ends_is_published_by_segments_and_taken_up_again(spark, tmp_path, monkeypatch):
    frames, config = clip(spark), game.Config(target_fps=30.0, segment_frames=8)
    game.run_game(frames, str(tmp_path / "whole"), NBA, config, key="k")
    whole = lines(tmp_path / "whole")
    assert {r["shot_id"] for r in whole} == {0} and len({p["track_id"] for r in whole for p in r["players"]}) < 12  # tracks last over segments
    save, calls = sinks.save_json, []

    def killed(spark, path, data):
        save(spark, path, data)
        if path.endswith("run.json"):
            calls.append(path)
            if len(calls) >= 2:
                raise Killed

    for name, going_on in (("new", False), ("same", True)):
        folder = str(tmp_path / name)
        calls.clear()
        monkeypatch.setattr(game.sinks, "save_json", killed)
        with pytest.raises(Killed):
            game.run_game(frames, folder, NBA, config, key="k")
        monkeypatch.setattr(game.sinks, "save_json", save)
        stored = sinks.load_json(spark, f"{folder}/run.json")
        assert [s["end_frame"] for s in stored["segments"]] == [7, 15] and stored["status"] == "running"
        done = game.run_game(frames, folder, NBA, config, key="k", continue_shot=going_on)
        got = lines(folder)
        assert [r["frame_index"] for r in got] == list(range(24)) and done["status"] == "done" and done["summary"]["frames_processed"] == 24
        if going_on:
            assert got == whole
        else:
            assert [r["shot_id"] for r in got] == [0] * 16 + [1] * 8 and got[16]["scene_cut"] and got[:16] == whole[:16]


def test_a_failed_run_keeps_its_partial_segment(spark, tmp_path):
    def build():
        def model(b):
            if (b["frame_index"] >= 12).any():
                raise SystemExit("the worker ends")  # no failure of a frame
            return [None] * len(b)

        return model

    config = game.Config(target_fps=30.0, segment_frames=8, checkpoint_frames=4)
    broken = [Model("balls", f"array<{schemas.DETECTION}>", build)]
    with pytest.raises(Exception, match="worker"):
        game.run_game(clip(spark), str(tmp_path), NBA, config, key="k", models=broken)
    stored = sinks.load_json(spark, f"{tmp_path}/run.json")
    assert [(s["start_frame"], s["end_frame"], s["n_records"]) for s in stored["segments"]] == [(0, 7, 8), (8, 11, 4)] and stored["status"] == "running"
    done = game.run_game(clip(spark), str(tmp_path), NBA, config, key="k")
    assert [r["frame_index"] for r in lines(tmp_path)] == list(range(24)) and [r["shot_id"] for r in lines(tmp_path)] == [0] * 12 + [1] * 12 and done["summary"]["shots"] == 2


def test_gaps_and_limits(spark, tmp_path):
    frames = clip(spark).where("frame_index not in (13, 14)")
    config = game.Config(target_fps=30.0, segment_frames=8)
    assert game.run_game(frames, str(tmp_path / "a"), NBA, config, key="k", stop_at_gap=True)["summary"]["frames_processed"] == 13
    assert game.run_game(frames, str(tmp_path / "b"), NBA, config, key="k")["summary"]["frames_processed"] == 22
    short = game.Config(target_fps=30.0, segment_frames=8, max_frames=11)
    m = game.run_game(clip(spark), str(tmp_path / "c"), NBA, short, key="k")
    assert [s["n_records"] for s in m["segments"]] == [8, 3]
    empty = game.run_game(clip(spark).limit(0), str(tmp_path / "d"), NBA, config, key="k")
    assert (empty["status"], empty["segments"], empty["summary"]) == ("done", [], {})


# --- frame sources

HOOKS = {"decoder": "tests.decoding:decode", "probe": "tests.decoding:info"}


def test_filters_reach_the_decoder(spark, tmp_path):
    path = str(tmp_path / "a-60")
    frames = video_frames(spark, path=path, frames_per_task=8, **HOOKS)
    got = frames.where("frame_index >= 20 and frame_index < 31 and frame_index % 2 = 0").collect()
    assert [r.frame_index for r in got] == list(range(20, 31, 2)) and decoding.decoded(tmp_path) == [("a", i) for i in range(20, 31)]
    assert [r.frame_index for r in frames.where("frame_index = 7").collect()] == [7] and len(decoding.decoded(tmp_path)) == 12
    strided = video_frames(spark, path=path, stride=6, start_index=10, max_frames=5, **HOOKS)
    assert [r.frame_index for r in strided.where("frame_index > 12 and path is not null").collect()] == [18, 24, 30, 36]
    assert decoding.decoded(tmp_path)[-4:] != [] and strided.where("frame_index < 0").count() == 0


def test_a_game_decodes_its_parts_once_and_stops_at_a_failure(spark, tmp_path):
    path = str(tmp_path / "a-60-45")
    frames = video_frames(spark, path=path, stride=2, frames_per_task=8, **HOOKS).withColumn("run_id", F.lit("a"))
    info = {"fps": 30.0, "width": 2, "height": 6, "frame_count": 60}
    run = lambda **k: game.run_game(frames, str(tmp_path / "run"), NBA, game.Config(target_fps=15.0, segment_frames=10, **k), key="k", video_info=info, stop_at_gap=True, models=counting(tmp_path))
    first = run(max_frames=10)
    assert [(s["start_frame"], s["end_frame"]) for s in first["segments"]] == [(0, 18)] and decoding.decoded(tmp_path) == [("a", i) for i in range(0, 20, 2)]
    whole = run()
    want = list(range(0, 45, 2))
    assert [i for _, i in decoding.decoded(tmp_path)] == want and sorted(map(int, (tmp_path / "seen").read_text().split())) == want
    assert whole["summary"]["frames_processed"] == len(want) and [r["frame_index"] for r in lines(tmp_path / "run")] == want


def stream_of(spark, tmp_path, paths):
    return video_frames(spark, stream=True, paths=[str(tmp_path / p) for p in paths], frames_per_batch=8, stride=2, progress=str(tmp_path / "progress"), **HOOKS)


def test_videos_as_a_stream(spark, tmp_path):
    """Bounded batches, a path that fails, a restart: no frame is decoded twice, none behind a failure."""
    paths = ["a-60", "b-60-13", "c-5", "d-20-0"]
    sizes = []

    def sink(batch, k):
        sizes.append(batch.count() if not batch.isEmpty() else 0)

    def started():
        writer = stream_of(spark, tmp_path, paths).drop("payload").writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={k}")))
        return writer.option("checkpointLocation", str(tmp_path / "check")).start()

    query = started()
    until = time.time() + 60
    while len(list((tmp_path / "out").glob("batch=*/_SUCCESS"))) < 3 and time.time() < until:
        time.sleep(0.05)
    query.stop()
    query = started()
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    name = lambda p: p.rsplit("/", 1)[1].split("-")[0]
    want = sorted([("a", i) for i in range(0, 60, 2)] + [("b", i) for i in range(0, 13, 2)] + [("c", i) for i in (0, 2, 4)])
    assert sorted((name(r.path), r.frame_index) for r in rows) == want
    per = pd.Series([(name(r.path), r.batch) for r in rows]).value_counts()
    assert per.max() <= 4 and all(r.timestamp_s == round(r.frame_index / 30, 3) for r in rows)
    found = decoding.decoded(tmp_path)
    assert sorted(set(found)) == want and len(found) - len(want) <= 3 * 4  # only a batch that the stop broke off is done again


def test_stream_offsets(tmp_path, monkeypatch):
    from reelgrid.sources.video import FrameStream

    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "listing.py").write_text("found = ['x/a-20']\ndef listed():\n    return found\n")
    options = {"lister": "listing:listed", "frames_per_batch": "8", "progress": str(tmp_path / "p"), **HOOKS}
    s = FrameStream(options)
    assert s.initialOffset() == {} and s.latestOffset() == {"x/a-20": 8} == s.latestOffset()
    assert [(r.start, r.stop) for r in s.partitions({}, {"x/a-20": 8})] == [(0, 8)]
    import listing

    listing.found.append("x/b-5")
    assert s.latestOffset() == {"x/a-20": 16, "x/b-5": 5}
    again = FrameStream(options)  # a restarted source knows what was planned
    assert again.latestOffset() == {"x/a-20": 16, "x/b-5": 5}
    assert [(r.path, r.start, r.stop) for r in again.partitions({"x/a-20": 8}, {"x/a-20": 16, "x/b-5": 5})] == [("x/a-20", 8, 16), ("x/b-5", 0, 5)]
    from reelgrid.sources.files import shared_write

    shared_write(again.mark("x/a-20"), b"12")
    assert again.latestOffset() == {"x/a-20": 16, "x/b-5": 5}


# --- streams of records


def test_stream_and_batch_give_the_same_records(spark, tmp_path):
    config = game.Config(target_fps=30.0, segment_frames=8, max_consecutive_errors=4)
    runs = [clip(spark, 40, (7, 23), (3, 11, 12), "one", 1), clip(spark, 30, (), (), "two", 2), clip(spark, 30, (5,), range(10, 20), "three", 3)]
    frames = runs[0].unionByName(runs[1]).unionByName(runs[2])
    want = {(r.run_id, r.frame_index): r for r in game.records(frames, NBA, config, config.target_fps).collect()}
    assert max(i for run, i in want if run == "three") == 13  # aborted
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    rng, at = random.Random(9), 0
    while at < 40:  # a stream that ends and starts again for every micro-batch; some frames come twice
        size = rng.randint(4, 14)
        frames.where(f"frame_index >= {at - 2} and frame_index < {at + size}").coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(DDL).json(src)
        query = write_record_stream(record_stream(stream, NBA, config), out, check)
        query.awaitTermination()
        at += size
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(want) and {(r.run_id, r.frame_index) for r in rows} == set(want)
    fields = [f for f in next(iter(want.values())).asDict() if f not in ("court",)]
    for r in rows:
        w = want[r.run_id, r.frame_index]
        assert {f: r[f] for f in fields} == {f: w[f] for f in fields} and r.court.used_keypoint_ids == w.court.used_keypoint_ids
        assert np.allclose(r.court.homography or 0, w.court.homography or 0, atol=2e-6)
    assert {r.frame_index for r in rows if r.aborted} == {13}


def test_a_stream_ends_by_itself_at_an_abort(spark, tmp_path):
    src = str(tmp_path / "in")
    config = game.Config(target_fps=30.0, max_consecutive_errors=4)
    clip(spark, 30, (), range(10, 20)).coalesce(1).write.json(src)
    stream = spark.readStream.schema(DDL).json(src)
    query = write_record_stream(record_stream(stream, NBA, config), str(tmp_path / "out"), str(tmp_path / "check"), available_now=False, until_abort=True)
    assert query.awaitTermination(60) and query.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == 14


class Handle:
    """Just enough of a state store for one key."""

    def __init__(self):
        self.stored, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.stored is not None
    get = lambda self: self.stored
    listTimers = lambda self: list(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)
    getCurrentProcessingTimeInMs = lambda self: 5000

    def update(self, value):
        self.stored = value


def test_a_timer_closes_lost_tracks():
    handle, p = Handle(), RunProcessor(0.5, 8, 100, 5.0, idle_s=2)
    p.init(handle)
    rows = lambda lo, hi: pd.DataFrame([("r", i, 0.0, hist(20), None, [10.0 + i, 10, 40 + i, 80, 0.9], "{}") for i in range(lo, hi)], columns=["run_id", "frame_index", "timestamp_s", "hist", "error", "boxes", "packed"])
    first = next(p.handleInputRows(("r",), iter([rows(0, 2), rows(2, 5)]), handle))
    assert first.shot_id.tolist() == [0] * 5 and first.track_id.tolist() == [[1]] * 5 and handle.timers == [7000]
    second = next(p.handleInputRows(("r",), iter([rows(3, 7)]), handle))
    assert second.frame_index.tolist() == [5, 6] and second.track_id.tolist() == [[1]] * 2 and handle.timers == [7000]
    assert next(p.handleExpiredTimer(("r",), handle, None)).empty
    third = next(p.handleInputRows(("r",), iter([rows(7, 9)]), handle))
    assert third.shot_id.tolist() == [1, 1] and third.scene_cut.tolist() == [True, False] and third.segment_index.tolist() == [0, 1]


def test_tracker_state_comes_back_as_it_was():
    rng, t = np.random.default_rng(3), Tracker(5)
    other = Tracker.load(t.dump())
    for _ in range(25):
        n = int(rng.integers(0, 5))
        boxes = rng.uniform(0, 60, (n, 2)).repeat(2, 1)[:, [0, 2, 1, 3]] + [0, 0, 30, 50]
        conf = rng.uniform(0, 1, n)
        assert t.update(boxes, conf).tolist() == other.update(boxes, conf).tolist()
        other = Tracker.load(other.dump())
        assert other.dump() == t.dump()


# --- files


def test_named_files(spark, tmp_path):
    folder = tmp_path / "out"
    rows = spark.range(200, numPartitions=6).select(F.concat(F.lit("d"), F.col("id") % 7, F.lit("/x y "), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("n"), "id").alias("content"))
    files = lambda f=folder: {str(p.relative_to(f)): p.read_text() for p in f.rglob("*") if p.is_file()}
    assert named_files.write_files(rows, str(folder), overwrite=True) == 200
    assert files() == {f"d{i % 7}/x y {i}.txt": f"n{i}" for i in range(200)}
    more = spark.range(2).select(F.concat(F.lit("d0/x y "), F.col("id") * 7, F.lit(".txt")).alias("name"), F.lit("new").alias("content"))
    assert named_files.write_files(more, f"file://{folder}") == 2 and files()["d0/x y 7.txt"] == "new" and len(files()) == 200
    copies = spark.createDataFrame([("copy", f"{folder}/d0/x y 7.txt")], "name string, source string")
    assert named_files.write_files(copies, str(folder)) == 1 and files()["copy"] == "new"
    assert named_files.delete_files(rows.where("id < 50"), str(folder)) == 50 and named_files.delete_files(rows.where("id < 50"), str(folder)) == 0 and len(files()) == 151
    assert named_files.write_files(rows.limit(0), str(folder), overwrite=True) == 0 and files() == {}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]


@pytest.mark.parametrize("overwrite", [True, False])
def test_a_job_that_fails_leaves_no_file(spark, tmp_path, overwrite):
    folder = tmp_path / "out"
    before = spark.createDataFrame([("old", "kept")], "name string, content string")
    named_files.write_files(before, str(folder), overwrite=True)
    broken = spark.createDataFrame([(f"f{i}", "x" if i < 9 else None, "/not/there" if i == 9 else None) for i in range(10)], "name string, content string, source string").coalesce(1)
    with pytest.raises(Exception, match="not/there"):
        named_files.write_files(broken, str(folder), overwrite=overwrite)
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["out/old"] and [p.name for p in tmp_path.iterdir()] == ["out"] and len(list(folder.iterdir())) == 1


def test_export_replaces_the_former_one_whole(spark, tmp_path):
    out, images = tmp_path / "set", tmp_path / "project"
    for i in range(4):
        (images / "frames").mkdir(parents=True, exist_ok=True)
        (images / "frames" / f"f{i}.jpg").write_bytes(bytes([i]))
    (tmp_path / "schema.json").write_text("{}")
    frames = spark.createDataFrame([(f"f{i}", "c", i, 0.0, f"frames/f{i}.jpg", None, "keep", "labeled") for i in range(4)], schemas.FRAMES)
    points = [(float(i), float(i), 2, 0.0) for i in range(22)]
    labels = spark.createDataFrame([(f"f{i}", 100, 100, 22, (court.SCHEMA_NAME, court.SCHEMA_VERSION), None, "both", points, "t") for i in range(4)], schemas.LABELS)
    out.mkdir()
    (out / "stale").write_text("x")
    counts = export.export(frames, labels, str(out), 0.5, images=str(images), schema_file=str(tmp_path / "schema.json"))
    assert counts["train"] + counts["val"] == 4 and counts["missing"] == 0
    found = {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()}
    split = {r.frame_id: r.split for r in export.export_lines(frames, labels, 0.5).collect()}
    assert found == {"data.yaml", "schema.json"} | {f"labels/{s}/{f}.txt" for f, s in split.items()} | {f"images/{s}/{f}.jpg" for f, s in split.items()}
    listing = readers.read_split_listing(spark, str(out))
    assert {(r.frame_id, r.trained_split) for r in listing.collect()} == set(split.items())
    lost = frames.withColumn("image", F.lit("frames/none.jpg"))
    with pytest.raises(Exception, match="none.jpg"):
        export.export(lost, labels, str(out), 0.5, images=str(images))
    assert {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()} == found
    packed = export.export(frames, labels, str(tmp_path / "packed"), 0.5, packed=True)
    assert packed == counts and (tmp_path / "packed" / "data.yaml").exists() and spark.read.text(str(tmp_path / "packed" / "labels")).count() == 4


def test_overlays(spark, tmp_path):
    frames = clip(spark, n=3).withColumn("payload", F.encode(F.concat(F.lit("p"), "frame_index"), "utf-8"))
    draw = lambda payload, points, players: payload + f" {len(points)} {[d['name'] for d in players].count('Scoreboard')}".encode()
    assert game.write_overlays(frames.where("frame_index = 1"), str(tmp_path), draw) == 1
    assert (tmp_path / "overlay" / "clip.nba_f000001.jpg").read_bytes() == b"p1 22 1"


def test_training_manifest(spark):
    rows = spark.createDataFrame([("b", "val"), ("a", "train")], "frame_id string, split string")
    r = export.training_manifest(rows, "now", "set/data.yaml", "base").first()
    assert (r.trained_at, r.data, r.model_init, r.frames) == ("now", "set/data.yaml", "base", {"a": "train", "b": "val"})
    assert export.training_manifest(rows.limit(0), "now", "d", "m").first().frames == {}


# --- models


def test_models_of_weights(spark):
    def builder(weights, device):
        return lambda b: [[([1.0, 2.0, 3.0, 4.0], 0, f"{weights}@{device}", 0.9, None)]] * len(b)

    models = models_of({"court": None, "detector": "d.pt", "ball": None}, dict.fromkeys(KINDS, builder), "cpu")
    assert [m.column for m in models] == ["players"]
    got = game.completed(with_models(spark.range(3).withColumnRenamed("id", "frame_index"), models, 2)).collect()
    assert all(r.players[0].name == "d.pt@cpu" and r.balls is None and r.keypoints is None and r.error is None for r in got)
    with pytest.raises(KeyError):
        models_of({"sound": "x"}, {})


def test_several_models_in_one_pass(spark):
    def build(k):
        def made():
            def model(b):
                if (b["x"] == k).any():
                    raise RuntimeError(f"no {k}")
                return [int(v) * k for v in b["x"]]

            return model

        return made

    got = {r.x: r for r in with_models(spark.range(6).select(F.col("id").alias("x"), F.lit(b"p").alias("payload")).coalesce(1), [Model("a", "long", build(2)), Model("b", "long", build(3))], 4, ("payload",)).collect()}
    assert [(got[x].a, got[x].b) for x in range(6)] == [(0, 0), (2, 3), (None, 6), (6, None), (8, 12), (10, 15)] and (got[2].error, got[3].error) == ("RuntimeError: no 2", "RuntimeError: no 3")
    assert "payload" not in got[0].asDict()


def test_inspect(spark):
    frames = clip(spark, n=5).withColumn("keypoints", F.when(F.col("frame_index") >= 3, F.col("keypoints")))
    assert game.inspect_first(frames).first().frame_index == 3 and game.inspect_first(frames.where("frame_index < 3")).count() == 0


# --- whole batches


def planted(n, seed=0):
    rng = np.random.default_rng(seed)
    feet = court.template("nba_94x50")
    plane = np.array([(feet[i][1], feet[i][0]) for i in court.IDS])
    src, seen = np.zeros((n, 22, 2)), rng.random((n, 22)) > 0.3
    for k in range(n):
        h = np.array([[6 + rng.random() * 12, rng.random(), 100 * rng.random()], [rng.random(), 6 + rng.random() * 6, 80 * rng.random()], [0, 0.0008 * rng.random(), 1]])
        q = np.c_[plane, np.ones(22)] @ h.T
        src[k] = q[:, :2] / q[:, 2:] + rng.normal(0, 0.3, (22, 2))
    seen[0] = False
    seen[1, 3:] = False
    seen[2] = False
    seen[2, :4] = True
    src[3, np.flatnonzero(seen[3])[0]] = np.nan
    src[4, np.flatnonzero(~seen[4])[0]] = np.nan  # an unseen point may be anything
    for k in range(5, n, 10):  # outliers
        src[k, np.flatnonzero(seen[k])[:2]] += 400
    src[6] = 7.0  # all points one
    return src, plane, seen


def plain_normaliser(p: np.ndarray) -> np.ndarray:
    centre = p.mean(0)
    spread = np.sqrt(((p - centre) ** 2).sum(1)).mean()
    s = np.sqrt(2) / spread if spread > 0 else 1.0
    return np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])


def plain_apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return q[:, :2] / q[:, 2:]


def plain_fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Least-squares homography with its last element 1; null for degenerate points."""
    ts, td = plain_normaliser(src), plain_normaliser(dst)
    s, d = plain_apply(ts, src), plain_apply(td, dst)
    zero, one = np.zeros(len(s)), np.ones(len(s))
    rows = np.concatenate([
        np.stack([-s[:, 0], -s[:, 1], -one, zero, zero, zero, d[:, 0] * s[:, 0], d[:, 0] * s[:, 1], d[:, 0]], 1),
        np.stack([zero, zero, zero, -s[:, 0], -s[:, 1], -one, d[:, 1] * s[:, 0], d[:, 1] * s[:, 1], d[:, 1]], 1),
    ])
    _, sizes, vt = np.linalg.svd(rows, full_matrices=len(rows) < 9)  # four points: the ninth vector is beyond the rows' rank
    if len(sizes) < 8 or sizes[7] < 1e-9 * sizes[0]:
        return None
    h = np.linalg.inv(td) @ vt[-1].reshape(3, 3) @ ts
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def plain_solve(src, dst, threshold=5.0):
    """One frame, one sample after the other, all of them."""
    n = len(src)
    if n < 4 or not np.isfinite(src).all():
        return None
    whole = plain_fit(src, dst)
    if whole is not None and (((plain_apply(whole, src) - dst) ** 2).sum(1) <= threshold**2).all():
        return whole
    best, key = None, (3, 0)
    for at in list(combinations(range(n), 4)) if n <= 9 else np.argsort(np.random.default_rng(0).random((400, n)), 1)[:60, :4]:
        h = plain_fit(src[list(at)], dst[list(at)])
        if h is not None:
            err = np.nan_to_num(np.sqrt(((plain_apply(h, src) - dst) ** 2).sum(1)), nan=np.inf)
            here = (int((err <= threshold).sum()), -float(err[err <= threshold].sum()))
            if here > key:
                best, key = err <= threshold, here
    return None if best is None else plain_fit(src[best], dst[best])


def test_homographies_by_batch_are_those_of_single_frames():
    src, plane, seen = planted(200)
    got = solve_all(src, plane, seen)
    for k in range(len(src)):
        want = plain_solve(src[k][seen[k]], plane[seen[k]])
        assert (want is None) == (got[k] is None), k
        if want is not None:
            assert np.allclose(got[k], want, rtol=1e-6, atol=1e-7), k
            one = solve(src[k][seen[k]], plane[seen[k]])
            assert np.allclose(one, got[k], rtol=1e-9, atol=1e-11)
    assert got[0] is None and got[1] is None and got[3] is None and got[4] is not None and got[6] is None


def test_clean_frames_cost_little():
    src, plane, seen = planted(3000, 1)
    clean = np.array([k for k in range(len(src)) if k > 6 and k % 10 != 5])
    begun = time.perf_counter()
    solve_all(src[clean], plane, seen[clean])
    assert (time.perf_counter() - begun) / len(clean) < 2e-4  # 0.03 ms on a quiet machine


def test_points_of_another_number_have_no_homography(spark):
    rows = [(0, [(1.0, 2.0, 2)] * 5), (1, None), (2, [])]
    got = with_homography(spark.createDataFrame(rows, "id int, keypoints array<struct<x:double,y:double,v:int>>"), "nba_94x50").collect()
    assert all(r.solved.homography is None and r.solved.used_keypoint_ids == [] for r in got)


def test_rounding_is_pythons():
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 200_000), rng.uniform(-2000, 2000, 300_000), 10.0 ** rng.uniform(-12, 18, 200_000) * rng.choice([-1, 1], 200_000), rng.integers(-10**7, 10**7, 300_000) / 8])
    ties = np.concatenate([(np.arange(-5000, 5000) + 0.5) / 10**d for d in range(7)] + [np.array([0.0, -0.0, 2.675, 1.005, 0.125, -0.35, 5e-324, 1e308, -1e308, np.inf, -np.inf])])
    near = np.concatenate([np.nextafter(ties, np.inf), np.nextafter(ties, -np.inf)])
    values = np.concatenate([values, ties, near])
    for digits in (0, 1, 2, 3, 4, 6):
        got = S.rounded(values, digits).tolist()
        want = [round(v, digits) if math.isfinite(v) else v for v in values.tolist()]
        assert got == want and [math.copysign(1, x) for x in got] == [math.copysign(1, x) for x in want]


def test_rounding_of_arrays(spark):
    rows = [(0, [1.25, None, float("nan"), -0.04]), (1, None), (2, []), (3, [2.675, 1e300])]
    df = spark.createDataFrame(rows, "id int, a array<double>").coalesce(1)
    got = {r.id: r.b for r in df.select("id", S.round_all_like_python(F.col("a"), 1).alias("b")).collect()}
    assert got[0][:2] == [1.2, None] and math.isnan(got[0][2]) and math.copysign(1, got[0][3]) == -1 and got[1] is None and got[2] == [] and got[3] == [2.7, 1e300]


def test_colour_histograms(spark):
    rng = np.random.default_rng(6)
    frames = [rng.integers(0, 256, 3 * n, np.uint8).tobytes() for n in (1, 50, 777)] + [b"", b"\x01\x02", None, bytes([255, 255, 255, 0, 0, 0, 9])]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(frames)], "id int, payload binary").coalesce(1)
    got = {r.id: (r.h, r.g) for r in rows.select("id", O.colour_histogram(F.col("payload")).alias("h"), O.grey_histogram(F.col("payload"), 16).alias("g")).collect()}
    for i, f in enumerate(frames):
        if f is None:
            assert got[i] == (None, None)
            continue
        grey = [(3735 * f[j] + 19235 * f[j + 1] + 9798 * f[j + 2] + 16384) >> 15 for j in range(0, len(f) // 3 * 3, 3)]
        assert got[i][0] == ([sum(g // 4 == b for g in grey) / len(grey) for b in range(64)] if grey else [None] * 64)
        assert got[i][1] == ([sum(x // 16 == b for x in f) / len(f) for b in range(16)] if f else [None] * 16)


def test_histograms_of_number_arrays(spark):
    rows = spark.createDataFrame([(0, [0.0, 3.9, 4.0, 255.0, 300.0, -1.0]), (1, None), (2, []), (3, [8.0])], "id int, a array<double>").coalesce(1)
    got = {r.id: r.h for r in rows.select("id", O.grey_histogram(F.col("a")).alias("h")).collect()}
    assert got[0] == [2 / 6, 1 / 6] + [0.0] * 61 + [1 / 6] and got[1] is None and got[2] == [None] * 64 and got[3][2] == 1.0


def test_unplaced_points(spark):
    pts = spark.createDataFrame([([(0.0, 0.0, 0), (0.0, 0.0, 1), (1.0, 0.0, 0)],)], "p array<struct<x:double,y:double,v:int>>")
    assert pts.select(F.transform("p", K.unplaced).alias("u")).first().u == [True, False, False]


def test_sampled_frames_are_those_of_the_same_draws(spark):
    clips = spark.createDataFrame([("a", 30.0, 2.0, 125), ("clip b", 0.0, 1.0, 61), ("c", 25.0, 0.01, 3), ("d", 30.0, 2.0, None)], "clip_id string, fps double, interval_s double, frame_count long")
    got = sample_frames(clips).collect()
    # What CPython's random.Random(clip_id) draws in each window, written out.
    rng_a, rng_b = random.Random("a"), random.Random("clip b")
    want = {("a", x) for w in range(0, 125, 60) if (x := w + rng_a.randrange(60)) < 125} | {("clip b", x) for w in range(0, 61, 30) if (x := w + rng_b.randrange(30)) < 61} | {("c", i) for i in range(3)}
    assert {(r.clip_id, r.frame_index) for r in got} == want and all(r.frame_id == f"{r.clip_id}_f{r.frame_index:06d}" for r in got)
