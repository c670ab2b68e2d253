"""Work that must not grow with the number of parts, copies of names, or rows of one key."""

import re
from random import Random

import numpy as np
from pyspark.sql import functions as F

from reelgrid.operators import frames as R
from reelgrid.operators import shots as O
from reelgrid.plans import game
from reelgrid.queries import QUERIES
from reelgrid.sources.files import delete_tree
from reelgrid.sources.named_files import read_files, spread, write_files
from reelgrid.sources.readers import read_export_lines, read_labels
from tests.test_runs import NBA, clip, lines


def test_long_runs_have_few_parts(spark, tmp_path, monkeypatch):
    """Sixteen segments in five parts (sixteen before), by blocks too; the same records."""
    parts, going_on = [], O.going_on
    monkeypatch.setattr(O, "going_on", lambda *a: parts.append(a[5]) or going_on(*a))
    monkeypatch.setattr(game, "BLOCK_FRAMES", 3)
    monkeypatch.setattr(game, "PART_SECONDS", 1e9)
    frames, config = clip(spark, n=48, cuts=(7, 13, 14), failing=(3, 11, 12, 13)), game.Config(target_fps=30.0, segment_frames=3)
    m = game.run_game(frames, str(tmp_path), NBA, config, key="k", stop_at_gap=True)
    assert len(parts) == 5 and parts[:2] == [None, None] and parts[-1] == 3
    want = {r.frame_index: r for r in game.records(frames, NBA, config, 30.0).collect()}
    got = lines(tmp_path)
    assert [r["frame_index"] for r in got] == list(range(48)) and [s["n_records"] for s in m["segments"]] == [3] * 16
    for r in got:
        w = want[r["frame_index"]]
        assert (r["shot_id"], r["scene_cut"], r["error"], [p["track_id"] for p in r["players"]]) == (w.shot_id, w.scene_cut, w.error, [p.track_id for p in w.players])


def test_blocks_go_on_from_a_carry(spark):
    frames = clip(spark, n=40, cuts=(7, 23, 24), failing=(0, 1, 11, 12, 13))
    for carry in (O.Carry(), O.Carry(shot=4, segment=2, filled=3, error_run=2, opened=True, hist=[1.0] + [0.0] * 63, frame=-1)):
        shown = lambda f: sorted(f.select("frame_index", "shot_id", "scene_cut", "error_run", "segment_index", "aborted").collect())
        for limit in (100, 4, 3):
            assert shown(O.going_on(frames, carry, 0.5, 8, limit)) == shown(O.going_on(frames, carry, 0.5, 8, limit, 9))


def test_draws_are_pythons_and_clips_of_one_name_stay_apart(spark):
    for step in (1, 2, 60, 64, 1 << 33):
        rng, drawn = Random("a"), next(R._draws("a", step))
        assert [rng.randrange(step) for _ in range(len(drawn))] == drawn.tolist()
    clips = spark.createDataFrame([("a", 30.0, 2.0, 1_000_001), ("b", 30.0, 2.0, 59), ("b", 30.0, 2.0, 130), ("c", 30.0, 2.0, 0)], "clip_id string, fps double, interval_s double, frame_count long")
    got = R.sample_frames(clips)
    assert got.where("clip_id = 'b'").count() in (3, 4)  # a join by name made four times as many
    at = np.array([r[0] for r in got.where("clip_id = 'a'").orderBy("frame_index").select("frame_index").collect()])
    rng = Random("a")
    assert at.tolist() == [x for w in range(0, 1_000_001, 60) if (x := w + rng.randrange(60)) < 1_000_001]
    assert got.where(F.col("timestamp_s") != F.bround(F.col("frame_index") / 30, 3)).count() == 0


def test_shots_together_are_those_one_by_one():
    """The same numbers and states, where boxes cross, vanish and come back, from trackers that have begun; short shots cost little."""
    from reelgrid.operators.tracking import Tracker, advance

    rng = np.random.default_rng(3)
    frames = rng.integers(1, 40, 30)
    n = rng.integers(0, 6, frames.sum())
    starts = np.concatenate([[0], np.cumsum(n)])
    xy = rng.uniform(0, 60, (starts[-1], 2))
    boxes, conf = np.concatenate([xy, xy + rng.uniform(20, 60, xy.shape)], 1), rng.uniform(0, 1, starts[-1])
    a, b = ([Tracker(5.0) for _ in frames] for _ in range(2))
    for t in (a[4], b[4]):
        t.update(boxes[:9], conf[:9])
    want, f = np.zeros(len(boxes), np.int64), 0
    for t, many in zip(a, frames, strict=True):
        for f in range(f, f + many):
            want[starts[f] : starts[f + 1]] = t.update(boxes[starts[f] : starts[f + 1]], conf[starts[f] : starts[f + 1]])
        f += 1
    assert advance(b, frames, starts, boxes, conf).tolist() == want.tolist() and want.max() > 5
    assert [t.dump() for t in a] == [t.dump() for t in b]


def test_histograms_together_are_those_one_by_one():
    from reelgrid.streaming.records import _alike, _alike_in_order

    rng = np.random.default_rng(5)
    hists = [None, *rng.uniform(0, 1, (20, 64)).tolist(), [0.25] * 64, *rng.uniform(0, 1, (3, 64)).tolist()]
    assert _alike_in_order(hists) == [_alike(a, b) for a, b in zip(hists, hists[1:])]
    assert _alike_in_order([None, None, hists[1]]) == [None, None]


def test_submissions_are_not_sorted_by_frame(spark, sf):
    """A fifth of them name one unknown frame: no task may hold these wide rows for a sort."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["validation_status"](spark, sf)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "LeftOuter" in plan and not re.search(r"SortMergeJoin.*LeftOuter", plan)
        assert found.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def jobs_of(spark, name, work):
    """What `work` returns, and the numbers of tasks of the stages it ran."""
    spark.sparkContext.setJobGroup(name, "")
    try:
        out = work()
    finally:
        spark.sparkContext.setJobGroup("", "")
    t = spark.sparkContext.statusTracker()
    return out, [t.getStageInfo(s).numTasks for j in t.getJobIdsForGroup(name) for s in t.getJobInfo(j).stageIds if t.getStageInfo(s)]


def test_label_files_are_listed_by_clip_and_written_by_all_tasks(spark, tmp_path):
    names = spark.range(80).coalesce(1).select(F.concat(F.lit("c/"), F.col("id").cast("string"), F.lit(".json")).alias("name"), F.lit('{"frame_id": "f"}').alias("content"))
    n, tasks = jobs_of(spark, "write", lambda: write_files(spread(names), f"{tmp_path}/labels"))
    assert n == 80 and max(tasks) == 2 * spark.sparkContext.defaultParallelism
    (tmp_path / "labels/stray.json").write_text("{}")
    labels, tasks = jobs_of(spark, "list", lambda: read_labels(spark, str(tmp_path)))
    assert not tasks and labels.where("frame_id = 'f'").count() == labels.count() == 80
    assert read_labels(spark, f"{tmp_path}/none").count() == 0


def test_export_lines_of_whole_files(spark, tmp_path):
    for name, text in {"train/a": "0 1\n", "train/b": "", "val/c": "1 é\r\n2\n", "val/d": "3"}.items():
        (tmp_path / "labels" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"labels/{name}.txt").write_bytes(text.encode())
    got = sorted(map(tuple, read_export_lines(spark, str(tmp_path)).collect()))
    assert got == [("a", "train", "0 1"), ("c", "val", "1 é"), ("c", "val", "2"), ("d", "val", "3")]


def test_the_driver_knows_no_label_file(spark, tmp_path):
    """Tasks list and read the files, whatever they hold; Spark's readers kept each one's path and status in the driver."""
    texts = {"a b/1.json": '{"frame_id": "1"}', "a b/2.json": '\ufeff {"frame_id": "2"}', "c%20/3.json": ' [{"frame_id": "3"}, {"frame_id": "4"}]\n', "c%20/empty.json": "", "c%20/blank.json": " \n", "c%20/torn.json": '{"frame_id": ', "c%20/.x.json": "{}", "c%20/y.txt": "{}", ".z/5.json": "{}"}
    for name, text in texts.items():
        (tmp_path / "labels" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "labels" / name).write_bytes(text.encode())
    for folder in (str(tmp_path), f"file://{tmp_path}".replace(" ", "%20")):
        labels = read_labels(spark, folder)
        assert not labels.inputFiles()
        assert sorted(r.frame_id or "" for r in labels.collect()) == ["", "1", "2", "3", "4"]


def test_the_driver_knows_no_export_file(spark, tmp_path):
    for name in ("train/a.txt", "val/b.txt", "val/deep/c.txt", "d.txt", "train/.hidden.txt"):
        (tmp_path / "labels" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "labels" / name).write_text(f"{name}\n")
    found = read_export_lines(spark, str(tmp_path))
    assert not found.inputFiles()
    assert sorted(map(tuple, found.collect())) == [("a", "train", "train/a.txt"), ("b", "val", "val/b.txt"), ("c", "deep", "val/deep/c.txt"), ("d", "labels", "d.txt")]
    assert read_files(spark, f"{tmp_path}/none").count() == 0


def test_trees_are_deleted_without_links_targets(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "kept").mkdir()
    for name in ("a/1", "a/b/2", "kept/3"):
        (tmp_path / name).write_text("")
    (tmp_path / "a/link").symlink_to(tmp_path / "kept")
    delete_tree(f"file://{tmp_path}/a")
    delete_tree(f"{tmp_path}/a")
    assert not (tmp_path / "a").exists() and (tmp_path / "kept/3").exists()


def test_a_frame_of_a_run_costs_no_work_twice(spark):
    """Sums over a histogram's bins are made once, and of a part's shots only the open one's tracker is written down."""
    from reelgrid.operators.tracking import track
    from reelgrid.run_queries import KINDS, _hist

    pairs = [([0.1, 0.2, 0.7], [0.3, 0.3, 0.4]), ([0.5, 0.5, 0.5], [0.1, 0.2, 0.3]), (None, [1.0, 0.0, 0.0]), ([0.0, 1.0, 0.0], [0.0, 1.0, 0.0])]
    found = spark.createDataFrame(pairs, "a array<double>, b array<double>").select(O.correlation(F.col("a"), F.col("b")).alias("r"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 5
    got = [r.r for r in found.collect()]
    assert np.allclose([got[0], got[1], got[3]], [np.corrcoef(*pairs[0])[0, 1], 1.0, 1.0]) and got[2] is None

    boxes = [("r", shot, 10 * shot + k, 0, 10.0, 10.0, 40.0, 80.0, 0.9) for shot in range(4) for k in range(3)]
    rows = spark.createDataFrame(boxes, "run_id string, shot_id int, frame_index long, det_no int, x1 double, y1 double, x2 double, y2 double, conf double")
    every, last = (track(rows, 5.0, states=True, **of).orderBy("frame_index", "state") for of in ({}, {"state_of": 3}))
    assert [r.shot_id for r in last.where("state is not null").collect()] == [3]
    assert last.collect() == every.where("state is null or shot_id = 3").collect()

    kinds = spark.createDataFrame([(k,) for k in (*KINDS, "other", None)], "k string").select(_hist(F.col("k")).alias("h"))
    assert [np.flatnonzero(r.h).tolist() for r in kinds.collect()] == [[1], [2], [3], [4], [5], [0], []]


def test_windows_are_counted_before_they_leave_the_worker(spark):
    """The same counts as over the drawn frames, and no function of arrays is left to run on each window."""
    clips = spark.createDataFrame([("a", 30.0, 2.0, 1_000_001), ("b", 30.0, 2.0, 59), ("b", 30.0, 2.0, 130), ("c", 30.0, 2.0, 0), ("d", 10.0, 0.1, 9), ("e", 7.0, 1.0, None)], "clip_id string, fps double, interval_s double, frame_count long")
    found = R.window_counts(clips)
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    sizes = {"a": (60, 1_000_001), "b": (60, 130), "d": (1, 9)}
    want = sorted((c, w, 1) for c, (step, n) in sizes.items() for w in range(n // step))
    assert sorted(map(tuple, found.collect())) == want
    assert QUERIES["window_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("lambda") == 0
