"""From found videos to catalog rows: which clips are sampled anew, what stays, and the counts of it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.operators.catalog import merge_clips, merge_frames, stale_clips
from reelgrid.operators.frames import sample_frames


@dataclass(frozen=True)
class Request:
    """reset drops all derived data and stands alone; force samples unchanged clips too; clip keeps to one."""

    interval_s: float = 2.0
    clip: str | None = None
    force: bool = False
    reset: bool = False

    def __post_init__(self) -> None:
        if self.reset and (self.force or self.clip is not None):
            raise ValueError("reset goes with neither force nor clip")
        if not self.interval_s > 0:
            raise ValueError("interval_s must be positive")


def plan(found: DataFrame, clips: DataFrame, frames: DataFrame, request: Request) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """found (the clips' columns as listed and probed, no orientation or done) against the catalog.

    -> clips and frames after the extraction, the sampled frames (for the picture sink), and one
    row of counts: processed and skipped clips, new_frames. Unknown `clip`: nothing is processed.
    """
    listed = found.withColumn("interval_s", F.lit(float(request.interval_s)))
    if request.clip is not None:
        listed = listed.where(F.col("clip_id") == request.clip)
    chosen = listed if request.force else stale_clips(listed, clips)
    sampled = sample_frames(chosen)
    fresh = sampled.join(frames.select("frame_id"), "frame_id", "left_anti")
    tally = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("listed", listed), ("processed", chosen), ("new_frames", fresh))])
    n = lambda name: F.sum(F.when(F.col("what") == name, F.col("n")).otherwise(0))
    counts = tally.agg(n("processed").alias("processed"), (n("listed") - n("processed")).alias("skipped"), n("new_frames").alias("new_frames"))
    return merge_clips(clips, chosen.select([c for c in clips.columns if c in chosen.columns])), merge_frames(frames, sampled.select(frames.columns)), sampled, counts
