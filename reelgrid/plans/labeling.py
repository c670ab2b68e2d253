"""The labeling requests as functions over tables; a server would call these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions import keypoints as K
from reelgrid.operators import catalog
from reelgrid.operators.validation import validate_submissions


def clips_page(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """GET clips."""
    return catalog.clip_listing(clips, frames)


def frames_page(frames: DataFrame, clips: DataFrame, clip: str | None = None, triage: str | None = None, trained: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """GET frames: the rows, and counts that heed the clip but not the triage filter."""
    total = F.col("clip_id") == clip if clip else F.col("clip_id").isNull()
    return catalog.frames_of(frames, clip, triage, trained), catalog.progress_counts(frames, clips).where(total)


def orientation_of(clips: DataFrame, clip: str) -> DataFrame:
    """GET orientation: no row for an unknown clip."""
    return clips.where(F.col("clip_id") == clip).select("clip_id", catalog.shown_orientation(catalog.valid_orientation(F.col("orientation"))).alias("orientation"))


def submit_labels(submissions: DataFrame, frames: DataFrame, clips: DataFrame, labels: DataFrame, saved_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """POST labels (frame_id, visible_ends, keypoints, seq): verdicts, labels and frames after them."""
    judged = validate_submissions(submissions, frames, clips)
    size = frames.select("frame_id", "clip_id").join(clips.select("clip_id", "width", "height", "orientation"), "clip_id")
    good = judged.where("code = 200").join(size, "frame_id")
    new = good.select(
        "frame_id", F.col("width").alias("image_w"), F.col("height").alias("image_h"), F.size("cleaned").alias("num_keypoints"), K.schema_ref().alias("schema"),
        F.col("orientation").withField("locked_at", F.lit(None).cast("string")).alias("orientation"), "visible_ends", F.col("cleaned").alias("keypoints"), F.lit(saved_at).alias("saved_at"), "seq",
    )
    after, marked = catalog.save_labels(labels, frames, new.select(*labels.columns, "seq"))
    return judged, after, marked
