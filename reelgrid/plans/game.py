"""A game's frames to per-frame records: shots, homography, tracks, projection, segments.

Input rows: run_id, frame_index, timestamp_s, hist array<double>, keypoints
array<struct<x,y,v>>, players and balls arrays of detections, error (of the models; null:
none). Two shuffles: by run for what depends on order, by shot for tracking. `records` does
whole runs at once; `run_game` does one run part by part, with what the next part needs (last
histogram, shot, error run, records in the segment, the open shot's tracks) handed on, so
that each frame goes through the models once and a part's work does not grow with the run.
"""

from __future__ import annotations

import contextlib
import posixpath
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import detections as D
from reelgrid.functions import keypoints as K
from reelgrid.functions import scalars as S
from reelgrid.operators import shots as O
from reelgrid.operators.blocks import BLOCK, blocked, in_block, with_prior
from reelgrid.operators.homography import with_homography
from reelgrid.operators.tracking import track
from reelgrid.plans.inference import Model, with_models
from reelgrid.sources import sinks
from reelgrid.sources.files import remove
from reelgrid.sources.named_files import write_files


#: A part that takes longer than so many seconds is not followed by a larger one; frames of a block, by which larger parts are spread over tasks.
PART_SECONDS, BLOCK_FRAMES = 60.0, 8192


@dataclass(frozen=True)
class Profile:
    name: str
    template: str
    player_classes: tuple[str, ...] | None = None
    ball_classes: tuple[str, ...] | None = None
    point_order: tuple[str, ...] | None = None
    weights: dict[str, str | None] = field(default_factory=dict)


def profiles() -> dict[str, Profile]:
    from reelgrid import court

    # Names, templates and kept classes of the two profiles.
    nba = Profile("nba", "nba_94x50", ("Player",), ("Ball",), tuple(court.EIGHTEEN_POINT_ORDER))
    return {"hs": Profile("hs", "nfhs_84x50"), "nba": nba}


def profile(name: str, **overrides) -> Profile:
    """A profile by name; overrides that are not None replace its fields. Unknown names raise KeyError."""
    return Profile(**(asdict(profiles()[name]) | {k: v for k, v in overrides.items() if v is not None}))


@dataclass(frozen=True)
class Config:
    target_fps: float = 5.0
    segment_frames: int = O.SEGMENT_FRAMES
    batch: int = 8
    device: str | None = None
    ball_conf: float = D.BALL_CONFIDENCE
    scene_threshold: float = O.SCENE_THRESHOLD
    keep_keypoints: bool = False
    format: str = "jsonl"
    max_frames: int | None = None
    max_consecutive_errors: int = O.MAX_CONSECUTIVE_ERRORS
    checkpoint_frames: int | None = None  # processed frames in a part of run_game; none: a segment's at first, see there

    def keyed(self, stride: int, source_fps: float, who: Profile | None = None) -> dict:
        """What a stored run must have been made with to be continued; the limits and the checkpoints are not part of it."""
        out = {k: v for k, v in asdict(self).items() if k not in ("max_frames", "max_consecutive_errors", "checkpoint_frames")} | {"stride": stride, "source_fps": source_fps}
        return out | ({"court_template": who.template} | {f"{k}_weights": v for k, v in who.weights.items()} if who else {})


def _round(x: Column, digits: int) -> Column:
    return S.round_all_like_python(x, digits)


def records(frames: DataFrame, who: Profile, config: Config | None = None, frame_rate: float = 5.0, start_shot: int = 0, start_segment: int = 0, block: int | None = None) -> DataFrame:
    """run_id, segment_index and the record columns, for every frame up to an abort. block: see `ordered`."""
    config = config or Config()
    return finished(ordered(frames, config, start_shot, start_segment, block), who, config, frame_rate)


def ordered(frames: DataFrame, config: Config, start_shot: int = 0, start_segment: int = 0, block: int | None = None) -> DataFrame:
    """What depends on the order of a run's frames: shot_id, scene_cut, segment_index; frames after an abort go.

    With `block` (units of frame_index) a run is spread over tasks, see operators/blocks.py;
    without, it is one task's.
    """
    f = frames if "error" in frames.columns else frames.withColumn("error", F.lit(None).cast("string"))
    f = O.shots(O.scene_cuts(f, config.scene_threshold, block=block), start_shot, block=block)
    f = O.until_abort(f.withColumn("failed", F.col("error").isNotNull()), config.max_consecutive_errors, block=block)
    return O.segments(f, config.segment_frames, start_segment, block=block)


def chosen_detections(f: DataFrame, who: Profile) -> DataFrame:
    """Detections of the profile's classes; frames with an error have neither points nor detections."""
    ok = F.col("error").isNull()
    return f.withColumns({
        "keypoints": F.when(ok, F.col("keypoints")), "players": F.when(ok, D.of_classes(F.col("players"), who.player_classes)).otherwise(F.array().cast(f"array<{schemas.DETECTION}>")),
        "balls": F.when(ok, D.of_classes(F.col("balls"), who.ball_classes)),
    })


def player_boxes(f: DataFrame) -> DataFrame:
    """Rows for operators.tracking of chosen_detections; frames with an error are none, others without players one empty row."""
    rows = f.select("run_id", "shot_id", "frame_index", "error", F.posexplode_outer("players").alias("det_no", "d")).where("error is null")
    return rows.select("run_id", "shot_id", "frame_index", "det_no", *[F.get("d.xyxy", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], "d.conf")


def with_ids(f: DataFrame, tracked: DataFrame) -> DataFrame:
    """Adds ids, the track of each tracked detection by its place."""
    ids = tracked.groupBy("run_id", "frame_index").agg(F.map_from_entries(F.collect_list(F.struct("det_no", "track_id"))).alias("ids"))
    return f.join(ids, ["run_id", "frame_index"], "left")


def finished(f: DataFrame, who: Profile, config: Config, frame_rate: float) -> DataFrame:
    """Records of whole shots."""
    f = chosen_detections(f, who)
    return record_columns(with_ids(f, track(player_boxes(f), frame_rate)), who, config)


def record_columns(f: DataFrame, who: Profile, config: Config, extra: Sequence[str] = ()) -> DataFrame:
    """Records of frames that are chosen, ordered and tracked (ids), and the columns `extra`; each by itself, without a shuffle."""
    ok = F.col("error").isNull()
    f = with_homography(f, who.template)
    h = F.col("solved.homography")
    kept = F.filter(F.transform("players", lambda d, i: d.withField("track_id", F.try_element_at("ids", i))), lambda d: d["track_id"].isNotNull())
    ball = D.best(D.at_least(F.coalesce("balls", F.array().cast(f"array<{schemas.DETECTION}>")), config.ball_conf), schemas.DETECTION)
    f = f.withColumns({"kept": F.coalesce(kept, F.array().cast(f"array<{schemas.DETECTION}>")), "b": ball, "h": h})
    foot = lambda p: D.foot_point(p["xyxy"])
    numbers = {
        "p_conf": (F.transform("kept", lambda p: p["conf"]), 4), "p_box": (F.flatten(F.transform("kept", lambda p: F.slice(p["xyxy"], 1, 4))), 1), "p_foot": (F.flatten(F.transform("kept", foot)), 1),
        "p_court": (F.flatten(F.transform("kept", lambda p: D.projected(F.col("h"), F.get(foot(p), 0), F.get(foot(p), 1)))), 2),
        "b_conf": (F.array("b.conf"), 4), "b_box": (F.col("b.xyxy"), 1), "b_centre": (D.centre(F.col("b.xyxy")), 1),
        "b_court": (D.projected(F.col("h"), F.get(D.centre(F.col("b.xyxy")), 0), F.get(D.centre(F.col("b.xyxy")), 1)), 2),
        "h_flat": (F.flatten("h"), 6), "k_flat": (F.flatten(F.transform("keypoints", lambda p: F.array(p["x"], p["y"], p["v"].cast("double")))) if config.keep_keypoints else F.lit(None).cast("array<double>"), 2),
    }
    f = f.withColumns({k: _round(v, digits) for k, (v, digits) in numbers.items()})
    part = lambda c, i, n: F.slice(F.col(c), i * n + 1, n)
    players = F.transform("kept", lambda p, i: F.struct(
        p["track_id"].alias("track_id"), p["cls"].alias("cls"), p["name"].alias("name"), F.get("p_conf", i).alias("conf"), part("p_box", i, 4).alias("bbox"),
        part("p_foot", i, 2).alias("foot_px"), F.when(F.col("h").isNotNull(), part("p_court", i, 2)).alias("court_ft"),
    ))
    rows_of = lambda c, n, width: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: part(c, i, width))
    court_struct = F.struct(
        F.coalesce(F.when(ok, K.visible_count(F.col("keypoints"))), F.lit(0)).alias("visible_keypoints"), F.when(F.col("h").isNotNull(), rows_of("h_flat", 3, 3)).alias("homography"),
        F.coalesce("solved.used_keypoint_ids", F.array().cast("array<string>")).alias("used_keypoint_ids"), F.when(F.col("k_flat").isNotNull(), rows_of("k_flat", 22, 3)).alias("keypoints"),
    )
    ball_struct = F.when(F.col("b").isNotNull(), F.struct(F.get("b_conf", 0).alias("conf"), F.col("b_box").alias("bbox"), F.col("b_centre").alias("center_px"), F.when(F.col("h").isNotNull(), F.col("b_court")).alias("court_ft")))
    return f.select(
        "run_id", "segment_index", "frame_index", "timestamp_s", "shot_id", "scene_cut", court_struct.cast(schemas.COURT).alias("court"),
        players.cast(f"array<{schemas.PLAYER}>").alias("players"), ball_struct.cast(schemas.BALL).alias("ball"), "error", *extra,
    )


def unbroken(frames: DataFrame, first: int, step: int, block: int | None = None) -> DataFrame:
    """One run's frames from `first` on, every step-th, up to the first that is missing. block: see `ordered`."""
    if block is not None:
        f = with_prior(blocked(frames, "frame_index", block), "run_id", {"_n": F.count(F.lit(1))}, {"_before": lambda b: F.coalesce(F.sum("_n").over(b), F.lit(0))})
        no = F.col("_before") + F.row_number().over(in_block("run_id", "frame_index"))
        return f.withColumn("_no", no).where(F.col("frame_index") == first + (F.col("_no") - 1) * step).drop("_no", "_before", BLOCK)
    no = F.row_number().over(Window.partitionBy("run_id").orderBy("frame_index"))
    return frames.withColumn("_no", no).where(F.col("frame_index") == first + (F.col("_no") - 1) * step).drop("_no")


def completed(frames: DataFrame) -> DataFrame:
    """Columns that no model gave are null."""
    types = {"hist": "array<double>", "keypoints": "array<struct<x:double,y:double,v:int>>", "players": f"array<{schemas.DETECTION}>", "balls": f"array<{schemas.DETECTION}>", "error": "string"}
    return frames.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in frames.columns})


def run_game(
    frames: DataFrame, run_dir: str, who: Profile, config: Config | None = None, *, models: Sequence[Model] = (), source_fps: float = 30.0, video_info: dict | None = None, key: str = "", resume: bool = True,
    video: str = "", stop_at_gap: bool = False, continue_shot: bool = False,
) -> dict:
    """Frames of one run (native indices) into records/seg_NNNNN.jsonl and run.json; returns the manifest.

    The run goes on in parts of checkpoint_frames processed frames. Without that a part has a
    segment's frames at first, later as many as all before it, as long as a part by the pace of
    the last one takes PART_SECONDS at most: so few parts make a long run, and a crash costs a
    segment or about a minute. A part of many frames is spread over tasks by blocks. A part's frames are chosen by
    index (a filter that the frame source takes), then go through the models (payload is dropped
    behind them; without a hist column it is made from the payload) and are written, once. What
    was open before the part goes on in it, the tracks too, and each segment is published, with
    the manifest and state.json, as soon as it is full, in the midst of a shot as well. When a
    part fails, the records there are make a last, partial segment, and the error is raised.

    A stored run of the same key goes on after its last segment, with a shot of its own; with
    continue_shot in the shot and with the tracks of state.json, so that its records are those
    of a run that was never stopped (where that segment was full). One of another key starts
    afresh. The summary covers all segments of the run. video_info (fps, width, height,
    frame_count) goes into the manifest; with frame_count the source is not asked for its
    bounds. stop_at_gap ends the run at the first sampled frame that is missing, as a decoder does.
    """
    config = config or Config()
    spark: SparkSession = frames.sparkSession
    if config.format != "jsonl":
        raise NotImplementedError(f"format {config.format}")
    info = {"fps": source_fps, "width": None, "height": None, "frame_count": None} | (video_info or {})
    step = max(1, round(info["fps"] / config.target_fps)) if config.target_fps > 0 else 1
    manifest_path, state_path, staged = (posixpath.join(run_dir, n) for n in ("run.json", "state.json", ".staged"))
    manifest = sinks.load_json(spark, manifest_path) if resume else None
    if manifest is not None and manifest.get("resume_key") != key:
        manifest = None
    if manifest is None:
        sinks.clear_run(spark, run_dir)
        remove(spark, state_path)
        manifest = {
            "schema_version": schemas.MANIFEST_VERSION, "record_schema_version": schemas.RECORD_VERSION, "video": video, "resume_key": key, "profile": who.name,
            "video_info": info, "config": config.keyed(step, info["fps"], who), "last_shot_id": -1, "segments": [], "summary": {}, "status": "running",
        }
    remove(spark, staged)
    manifest["segments"] = [s for s in manifest["segments"] if s["status"] == "done"]
    last = max(manifest["segments"], key=lambda s: s["index"], default=None)
    carry = O.Carry(shot=manifest["last_shot_id"] + 1, segment=last["index"] + 1, frame=last["end_frame"]) if last else O.Carry()
    if last and continue_shot:
        state = O.Carry(**(sinks.load_json(spark, state_path) or {}))
        carry = state if state.frame == carry.frame and state.segment == carry.segment else carry
    pending: list[str] = []
    shown = carry.segment

    def publish(before: int) -> None:
        """Segments below `before` of the records not yet published."""
        nonlocal pending, shown
        rows = spark.read.parquet(*pending).where((F.col("segment_index") >= shown) & (F.col("segment_index") < before)) if pending else None
        if rows is None or before <= shown:
            return
        new = O.segment_rollup(rows).orderBy("segment_index").collect()
        if not new:
            return
        sinks.write_shards(rows, run_dir)
        manifest["segments"] = [s for s in manifest["segments"] if s["index"] < shown] + [{"index": r["segment_index"], **{k: r[k] for k in ("start_frame", "end_frame", "n_records", "errors", "path", "status")}} for r in new]
        manifest["last_shot_id"] = rows.agg(F.max("shot_id")).first()[0]
        if carry.filled == 0:
            sinks.save_json(spark, state_path, asdict(carry))
        sinks.save_json(spark, manifest_path, manifest)
        pending, shown = pending[-1:], before  # only the last part can hold records of the segment that is open

    lo = -(-(carry.frame + 1) // step) * step
    if info["frame_count"] is not None:
        hi = info["frame_count"] - 1
    else:
        bounds = frames.where((F.col("frame_index") >= lo) & (F.col("frame_index") % step == 0)).agg(F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi")).first()
        hi = -1 if bounds["hi"] is None else bounds["hi"]
        lo = lo if stop_at_gap or bounds["lo"] is None else bounds["lo"]
    size, left, status, k = (config.checkpoint_frames or config.segment_frames) * step, config.max_frames, "done", 0
    first, count = lo, size
    try:
        while lo <= hi and (left is None or left > 0):
            begun, size = time.monotonic(), count
            block = BLOCK_FRAMES * step if size > 2 * BLOCK_FRAMES * step else None
            upto = min(lo + size, hi + 1, hi + 1 if left is None else lo + left * step)
            part = frames.where((F.col("frame_index") >= lo) & (F.col("frame_index") < upto) & (F.col("frame_index") % step == 0))
            if "hist" not in part.columns and "payload" in part.columns:
                part = part.withColumn("hist", O.colour_histogram(F.col("payload")))
            part = completed(with_models(part, models, config.batch, drop=("payload",)) if models else part.drop("payload"))
            at = lambda name: posixpath.join(staged, name)
            if block is not None:  # by blocks the frames are read more than once
                part.write.mode("overwrite").parquet(at("modelled"))
                part = spark.read.schema(part.schema).parquet(at("modelled"))
            if stop_at_gap:
                part = unbroken(part, lo, step, block)
            part = chosen_detections(O.going_on(part, carry, config.scene_threshold, config.segment_frames, config.max_consecutive_errors, block), who)
            part.write.mode("overwrite").parquet(at("part"))  # the models have run here or before, once
            done = spark.read.schema(part.schema).parquet(at("part"))
            after, aborted = O.carried(done, carry, config.segment_frames)
            seen = (after.segment - carry.segment) * config.segment_frames + after.filled - carry.filled
            if seen:
                tracked = track(player_boxes(done), config.target_fps, (carry.shot, carry.tracker) if carry.tracker else None, states=True, state_of=after.shot)
                tracked.write.mode("overwrite").parquet(at("tracked"))
                tracked = spark.read.schema(tracked.schema).parquet(at("tracked"))
                state = tracked.where(F.col("state").isNotNull() & (F.col("shot_id") == after.shot)).select("state").first()
                after.tracker = state["state"] if state else carry.tracker if after.shot == carry.shot else None
                ids = tracked.where("state is null").drop("state")
                record_columns(with_ids(done, ids), who, config).write.mode("overwrite").parquet(at(f"records-{k}"))
                pending.append(at(f"records-{k}"))
                carry, k = after, k + 1
                publish(carry.segment)
            if left is not None:
                left -= seen
            if aborted or (stop_at_gap and seen < len(range(lo, upto, step))):
                status = "aborted" if aborted else "done"
                break
            lo = -(-upto // step) * step
            if config.checkpoint_frames is None:
                pace = (time.monotonic() - begun) / size
                count = max(config.segment_frames, min((lo - first) // step, int(PART_SECONDS / pace / step)) // config.segment_frames * config.segment_frames) * step
    except BaseException:
        with contextlib.suppress(Exception):
            publish(carry.segment + 1)
        raise
    publish(carry.segment + 1)
    manifest["status"] = status
    if manifest["segments"]:
        from reelgrid.sources.readers import read_records

        stored, _ = read_records(spark, run_dir)
        summary = O.run_summary(stored.withColumn("run_id", F.lit(who.name))).drop("run_id").first()
        manifest["summary"] = summary.asDict() if summary else {}
    sinks.save_json(spark, manifest_path, manifest)
    remove(spark, staged)
    return manifest


def report(frames: DataFrame, who: Profile) -> DataFrame:
    """One row a frame without tracking, class filter or ball: frame_index, timestamp_s, visible_keypoints, homography (whether solved), players."""
    solved = with_homography(frames, who.template)
    h = F.col("solved.homography")
    feet = lambda d: D.foot_point(d["xyxy"])
    players = F.transform(F.coalesce("players", F.array().cast(f"array<{schemas.DETECTION}>")), lambda d: F.struct(
        d["cls"].alias("cls"), d["name"].alias("name"), d["conf"].alias("conf"), feet(d).alias("foot_px"), D.projected(h, F.get(feet(d), 0), F.get(feet(d), 1)).alias("court_ft"),
    ))
    return solved.select("run_id", "frame_index", "timestamp_s", K.visible_count(F.col("keypoints")).alias("visible_keypoints"), h.isNotNull().alias("homography"), players.alias("players"))


def report_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("frames_processed"), F.count_if("homography").alias("with_homography"))


def inspect_first(frames: DataFrame) -> DataFrame:
    """The first frame that has keypoints."""
    return frames.where(F.size("keypoints") > 0).orderBy("frame_index").limit(1)


def write_overlays(frames: DataFrame, folder: str, render: Callable[[bytes, list, list], bytes]) -> int:
    """overlay/<run_id>_f<frame_index>.jpg of each row with a payload, as render(payload, keypoints, players) draws it (points and detections as dictionaries); tasks write them. Returns their number."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            listed = lambda x: [] if x is None else [p if isinstance(p, dict) else p.asDict(True) for p in x]
            yield pd.DataFrame({"name": b["name"], "content": [render(bytes(p), listed(k), listed(d)) for p, k, d in zip(b["payload"], b["keypoints"], b["players"], strict=True)]})

    name = F.concat(F.lit("overlay/"), S.frame_id(F.col("run_id"), F.col("frame_index")), F.lit(".jpg")).alias("name")
    rows = completed(frames).where("payload is not null").select(name, "payload", "keypoints", "players")
    return write_files(rows.mapInPandas(draw, "name string, content binary"), folder)


def write_report(rows: DataFrame, folder: str, header: dict) -> dict:
    """frames as JSON lines beside report.json, which holds the header and the summary of one run."""
    rows.write.mode("overwrite").json(posixpath.join(folder, "frames"))
    counted = report_summary(rows).drop("run_id").first()
    data = header | (counted.asDict() if counted else {"frames_processed": 0, "with_homography": 0})
    sinks.save_json(rows.sparkSession, posixpath.join(folder, "report.json"), data)
    return data
