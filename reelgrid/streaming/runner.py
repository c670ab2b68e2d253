"""Structured Streaming over frames in order: shots, error runs and segments carry over micro-batches.

State per run is one row (last histogram, shot, error run, record count), kept by the state
store and restored from the checkpoint; a batch that is done again replaces the segments it
wrote, so a restart leaves no copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelgrid.operators.shots import MAX_CONSECUTIVE_ERRORS, SCENE_THRESHOLD, SEGMENT_FRAMES
from reelgrid.sources.sinks import write_records

OUT = "run_id string, frame_index long, timestamp_s double, shot_id int, scene_cut boolean, segment_index int, error string, error_run long, aborted boolean"
STATE = "hist array<double>, shot int, error_run long, n long, aborted boolean"


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a - a.mean(), b - b.mean()
    low = (x @ x) * (y @ y)
    return float(x @ y / np.sqrt(low)) if abs(low) > np.finfo(float).eps else 1.0


def segment_stream(frames: DataFrame, threshold: float = SCENE_THRESHOLD, segment_frames: int = SEGMENT_FRAMES, limit: int = MAX_CONSECUTIVE_ERRORS) -> DataFrame:
    """frames (run_id, frame_index, timestamp_s, hist, error), in order within a run across batches -> OUT; nothing after an abort."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hist, shot, run, n, aborted = state.get if state.exists else (None, 0, 0, 0, False)
        hist = None if hist is None else np.asarray(hist, float)
        rows = pd.concat(list(batches)).sort_values("frame_index")
        out = []
        for r in rows.itertuples(index=False):
            if aborted:
                break
            now = None if r.hist is None else np.asarray(r.hist, float)
            cut = hist is not None and now is not None and _correlation(hist, now) < threshold
            shot, opens = (shot + 1, True) if cut and n else (shot, n == 0)
            failed = isinstance(r.error, str)
            run = run + 1 if failed else 0
            aborted = run >= limit
            out.append((key[0], r.frame_index, r.timestamp_s, shot, opens, n // segment_frames, r.error if failed else None, run, aborted))
            hist, n = now, n + 1
        state.update((None if hist is None else hist.tolist(), shot, run, n, aborted))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return frames.groupBy("run_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def frame_files(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """Frames that arrive as JSON files, a bounded number of files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def write_segments(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch lands in its own partition of folder (batch_id), which a rerun replaces."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("batch_id", F.lit(batch_id))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact(folder: str, target: str, spark) -> None:
    """The batches' rows as one partition per run and segment."""
    write_records(spark.read.parquet(folder).drop("batch_id"), target, "parquet")
