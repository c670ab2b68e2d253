"""Whole records from a stream of frames: shots, tracks and segments go on from micro-batch to micro-batch.

State is a row a run (last histogram, shot, error run, place in the segment, the open shot's
tracks), kept by the state store and restored from the checkpoint. What does not depend on
order (homographies, projection, rounding) is the same columns as in a batch. Frames of a run
come in order; those at or before the last one that was taken are left out, so a source that
repeats itself does no harm. Nothing follows a run's abort.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from dataclasses import asdict
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from reelgrid import schemas
from reelgrid.operators.shots import Carry
from reelgrid.operators.tracking import Tracker, advance
from reelgrid.plans.game import Config, Profile, chosen_detections, completed, record_columns

ORDERED = (
    "run_id string, frame_index long, timestamp_s double, shot_id int, scene_cut boolean, segment_index int, error string, error_run long, aborted boolean, "
    "det_no array<int>, track_id array<long>, packed string"
)
PACKED = f"keypoints array<struct<x:double,y:double,v:int>>, players array<{schemas.DETECTION}>, balls array<{schemas.DETECTION}>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _alike(a: list[float] | None, b: list[float] | None) -> float | None:
    """operators.shots.correlation of two histograms, in its order of sums."""
    if a is None or b is None:
        return None
    n, cross, ta, tb, sa, sb = len(a), 0.0, 0.0, 0.0, 0.0, 0.0
    for x, y in zip(a, b, strict=True):
        cross, ta, tb, sa, sb = cross + x * y, ta + x, tb + y, sa + x * x, sb + y * y
    low = (sa - ta * ta / n) * (sb - tb * tb / n)
    return (cross - ta * tb / n) / np.sqrt(low) if abs(low) > np.finfo(float).eps else 1.0


def _alike_in_order(hists: list) -> list[float | None]:
    """_alike of each histogram after the first and the one before it; together where all are as long, each sum in the same order."""
    if len(hists) > 1 and hists[0] is None:
        return [None, *_alike_in_order(hists[1:])]
    if len({None if h is None else len(h) for h in hists}) > 1 or hists[0] is None or not len(hists[0]):
        return [_alike(a, b) for a, b in pairwise(hists)]
    h = np.array(hists, float)
    a, b, n = h[:-1], h[1:], h.shape[1]
    total = lambda x: np.cumsum(x, 1)[:, -1]
    s, squares = total(h), total(h * h)
    low = (squares[:-1] - s[:-1] * s[:-1] / n) * (squares[1:] - s[1:] * s[1:] / n)
    top = total(a * b) - s[:-1] * s[1:] / n
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.abs(low) > np.finfo(float).eps, top / np.sqrt(low), 1.0).tolist()


class RunProcessor(StatefulProcessor):
    """One run's frames in order. After idle_s seconds without frames (none: never) its tracks are closed, and the next frame opens a shot of its own."""

    def __init__(self, threshold: float, segment_frames: int, limit: int, frame_rate: float, idle_s: float | None = None):
        self.threshold, self.segment_frames, self.limit, self.rate, self.idle_s = threshold, segment_frames, limit, float(max(1, round(frame_rate))), idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "carry string, aborted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else ("{}", False)
        carry, aborted = Carry(**json.loads(stored[0])), bool(stored[1])
        tracker = Tracker.load(carry.tracker) if carry.tracker else Tracker(self.rate)
        b = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        b = b[(b["frame_index"] > carry.frame) & ~b["frame_index"].duplicated()] if not aborted else b[:0]
        hists, failed = b["hist"].tolist(), [isinstance(e, str) for e in b["error"]]
        cuts = [x is not None and bool(x < self.threshold) for x in _alike_in_order([carry.hist, *hists])]
        runs, opens, shots, segments = [], [], [], []
        for cut, bad in zip(cuts, failed, strict=True):
            opens.append(cut or not carry.opened)
            carry.shot, carry.opened, carry.error_run = carry.shot + cut, True, carry.error_run + 1 if bad else 0
            shots.append(carry.shot)
            segments.append(carry.segment)
            runs.append(carry.error_run)
            carry.segment, carry.filled = (carry.segment + 1, 0) if carry.filled + 1 == self.segment_frames else (carry.segment, carry.filled + 1)
            if carry.error_run >= self.limit:
                aborted = True
                break
        n = len(runs)
        b = b[:n]
        found = [np.zeros((0, 5)) if bad else np.asarray(x, float).reshape(-1, 5) for bad, x in zip(failed[:n], b["boxes"], strict=True)]
        shown = ~np.array(failed[:n], bool)  # a frame that failed is none for the tracker
        place = np.cumsum(opens) if n else np.zeros(0, np.int64)  # 0: the shot that was open
        trackers = [tracker, *(Tracker(self.rate) for _ in range(sum(opens)))]
        boxes, starts = np.concatenate([np.zeros((0, 5)), *found]), np.concatenate([[0], np.cumsum([len(x) for x, on in zip(found, shown, strict=True) if on])]).astype(np.int64)
        tracks = advance(trackers, np.bincount(place[shown], minlength=len(trackers)), starts, boxes[:, :4], boxes[:, 4])
        tracker, out, lo = trackers[-1], [], 0
        for k, (frame, at, error, packed) in enumerate(zip(b["frame_index"].tolist(), b["timestamp_s"].tolist(), b["error"].tolist(), b["packed"].tolist(), strict=True)):
            here = tracks[lo : lo + len(found[k])]
            lo += len(found[k])
            det = np.flatnonzero(here)
            out.append((key[0], frame, at, shots[k], opens[k], segments[k], error if failed[k] else None, runs[k], runs[k] >= self.limit, det.tolist(), here[det].tolist(), packed))
            carry.frame = frame
        if n:
            carry.hist = None if hists[n - 1] is None else [float(x) for x in hists[n - 1]]
        carry.tracker = tracker.dump()
        self.state.update((json.dumps(asdict(carry)), aborted))
        if self.idle_s is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle_s * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ORDERED.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        carry, aborted = self.state.get()
        carry = Carry(**json.loads(carry))
        if carry.opened:
            carry.shot, carry.opened, carry.hist, carry.tracker = carry.shot + 1, False, None, None
            self.state.update((json.dumps(asdict(carry)), aborted))
        yield pd.DataFrame([], columns=[c.split()[0] for c in ORDERED.split(", ")])

    def close(self) -> None:
        pass


def record_stream(frames: DataFrame, who: Profile, config: Config | None = None, idle_s: float | None = None) -> DataFrame:
    """Frames as for plans.game.records, as a stream -> its records, with aborted (true on the frame that ends its run).

    Needs the RocksDB state store, which this sets in the session.
    """
    config = config or Config()
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    f = chosen_detections(completed(frames), who)
    nothing = F.lit(float("nan"))
    numbers = lambda d: F.array(*[F.coalesce(F.get(d["xyxy"], i), nothing) for i in range(4)], F.coalesce(d["conf"], nothing))
    boxes = F.flatten(F.transform(F.coalesce("players", F.array().cast(f"array<{schemas.DETECTION}>")), numbers))
    packed = F.to_json(F.struct("keypoints", "players", "balls"), {"ignoreNullFields": "false"})
    rows = f.select("run_id", "frame_index", "timestamp_s", "hist", "error", boxes.alias("boxes"), packed.alias("packed"))
    processor = RunProcessor(config.scene_threshold, config.segment_frames, config.max_consecutive_errors, config.target_fps, idle_s)
    ordered = rows.groupBy("run_id").transformWithStateInPandas(processor, ORDERED, "append", "ProcessingTime" if idle_s is not None else "None")
    back = ordered.withColumn("_p", F.from_json("packed", PACKED, {"allowNonNumericNumbers": "true"})).select("*", "_p.keypoints", "_p.players", "_p.balls")
    back = back.withColumn("ids", F.map_from_arrays("det_no", "track_id")).withColumn("_aborted", F.col("aborted"))
    made = record_columns(back, who, config, extra=("_aborted",))
    return made.withColumnRenamed("_aborted", "aborted")


def stop_at_abort(spark: SparkSession, query: StreamingQuery, metric: str = "run") -> StreamingQueryListener:
    """Ends the query behind the micro-batch in which a frame aborted its run, as observed by write_record_stream."""

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            row = event.progress.observedMetrics.get(metric)
            if str(event.progress.id) == str(query.id) and row is not None and row["aborted"]:
                threading.Thread(target=query.stop, daemon=True).start()  # a listener must not wait for its query

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            if str(event.id) == str(query.id):
                spark.streams.removeListener(self)

    watch = Watch()
    spark.streams.addListener(watch)
    return watch


def write_record_stream(records: DataFrame, folder: str, checkpoint: str, available_now: bool = True, until_abort: bool = False) -> StreamingQuery:
    """Each micro-batch lands in its own partition of folder (batch_id), which a rerun replaces; with until_abort the query ends by itself once a run was aborted."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    seen = records.observe("run", F.coalesce(F.bool_or("aborted"), F.lit(False)).alias("aborted"), F.count(F.lit(1)).alias("records"))
    writer = seen.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    if until_abort:
        stop_at_abort(records.sparkSession, query)
    return query
