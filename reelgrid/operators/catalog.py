"""The catalog of clips and frames: progress, listings, upserts, locks, prefill and migration.

All joins are on keys that are unique on one side. Small sides are left to Spark's own
size check; nothing is forced to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid import court
from reelgrid.functions import keypoints as K
from reelgrid.operators.blocks import BLOCK, blocked, in_block, with_prior
from reelgrid.schemas import NORTH_CONVENTION, ORIENTATION, ORIENTATION_MODES, POINTS, TRIAGE


def triage_of(column: str = "triage") -> Column:
    return F.coalesce(F.col(column), F.lit("pending"))


def progress_counts(frames: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """Per clip, and overall under a null clip_id: clips, candidates, pending, keep, skip, labeled.

    A null triage is pending, an unknown one counts only as a candidate. With `clips` those
    without frames appear too, and frames of unknown clips count 0 clips.
    """
    tally = [F.count_if(triage_of() == t).alias(t) for t in TRIAGE]
    out = frames.groupingSets([[F.col("clip_id")], []], F.col("clip_id")).agg(
        F.count(F.lit(1)).alias("candidates"), *tally, F.count_if(F.col("label_status") == "labeled").alias("labeled"), F.grouping("clip_id").alias("is_total"),
    )
    if clips is None:
        clip_count = frames.agg(F.count_distinct("clip_id").alias("n"))
        return out.crossJoin(clip_count).select("clip_id", F.when(F.col("is_total") == 1, F.col("n")).otherwise(F.lit(1)).cast("long").alias("clips"), "candidates", *TRIAGE, "labeled")
    known = clips.groupBy().agg(F.count(F.lit(1)).alias("clips")).select(F.lit(None).cast("string").alias("k"), "clips", F.lit(1).alias("t"))
    known = known.unionByName(clips.select(F.col("clip_id").alias("k"), F.lit(1).cast("long").alias("clips"), F.lit(0).alias("t")))
    both = out.join(known, F.col("clip_id").eqNullSafe(F.col("k")) & (F.col("is_total") == F.col("t")), "full")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("clips", "candidates", *TRIAGE, "labeled")]
    return both.select(F.coalesce("clip_id", "k").alias("clip_id"), *zero)


def clip_listing(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """Every clip with its counts, clips without frames with zeros, in order of clip_id."""
    tally = frames.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("candidates"), *[F.count_if(triage_of() == t).alias(t) for t in TRIAGE], F.count_if(F.col("label_status") == "labeled").alias("labeled"),
    )
    names = ("candidates", *TRIAGE, "labeled")
    return clips.join(tally, "clip_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in names}).orderBy("clip_id")


def frames_of(frames: DataFrame, clip: str | None = None, triage: str | None = None, trained: DataFrame | None = None) -> DataFrame:
    """Frames in order of id; empty or missing filters keep all. trained: (frame_id, trained_split)."""
    out = frames
    if clip:
        out = out.where(F.col("clip_id") == clip)
    if triage:
        out = out.where(triage_of() == triage)
    out = out.join(trained, "frame_id", "left") if trained is not None else out.withColumn("trained_split", F.lit(None).cast("string"))
    return out.orderBy("frame_id")


def stale_clips(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found files (clip_id, file_size, file_mtime, interval_s) that are new or differ from what is known of them."""
    k = known.select(F.col("clip_id").alias("k"), *[F.col(c).alias(f"k_{c}") for c in ("file_size", "file_mtime", "interval_s")])
    same = F.lit(True)
    for c in ("file_size", "file_mtime", "interval_s"):
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return found.join(k, found.clip_id == k.k, "left").where(F.col("k").isNull() | ~same).select(found.columns)


def merge_frames(known: DataFrame, sampled: DataFrame) -> DataFrame:
    """Sampled frames replace known ones but keep their triage and label_status; known ones not sampled stay."""
    state = ("triage", "label_status")
    k = known.select("frame_id", *[F.col(c).alias(f"k_{c}") for c in known.columns if c != "frame_id"], F.lit(True).alias("_known"))
    s = sampled.withColumn("_new", F.lit(True))
    both = k.join(s, "frame_id", "full")
    default = {"triage": "pending", "label_status": "unlabeled"}

    def pick(c: str) -> Column:
        if c in state:
            kept = F.coalesce(F.col(f"k_{c}"), F.when(F.col("_known").isNull(), F.col(c)), F.when(F.col("_new"), F.lit(default[c])))
            return F.when(F.col("_new").isNull(), F.col(f"k_{c}")).otherwise(kept).alias(c)
        return F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"k_{c}")).alias(c)

    return both.select("frame_id", *[pick(c) for c in known.columns if c != "frame_id"])


def merge_clips(known: DataFrame, extracted: DataFrame) -> DataFrame:
    """An extracted clip replaces the known one whole: orientation and done are lost with it."""
    blank = [F.lit(None).cast(t).alias(c) for c, t in known.dtypes if c not in extracted.columns]
    return known.join(extracted.select("clip_id"), "clip_id", "left_anti").unionByName(extracted.select("*", *blank))


def latest(updates: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last update of each key."""
    others = [c for c in updates.columns if c not in (key, order)]
    return updates.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("u")).select(key, "u.*")


def apply_triage(frames: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """updates (frame_id, status, seq) -> frames after them, and the refused updates with code and reason."""
    known = updates.join(frames.select("frame_id", F.lit(True).alias("_there")), "frame_id", "left")
    code = F.when(~F.col("status").isin(*TRIAGE) | F.col("status").isNull(), 400).when(F.col("_there").isNull(), 404)
    judged = known.withColumn("code", code)
    refused = judged.where("code is not null").select("frame_id", "status", "seq", "code")
    last = latest(judged.where("code is null").select("frame_id", F.col("status").alias("_status"), "seq"), "frame_id")
    after = frames.join(last, "frame_id", "left").withColumn("triage", F.coalesce("_status", "triage")).drop("_status")
    return after.select(frames.columns), refused


def apply_done(clips: DataFrame, updates: DataFrame) -> DataFrame:
    """updates (clip_id, done, seq); a missing value is false, unknown clips are left out."""
    last = latest(updates.select("clip_id", F.coalesce(F.col("done"), F.lit(False)).alias("_done"), "seq"), "clip_id")
    return clips.join(last, "clip_id", "left").withColumn("done", F.coalesce("_done", "done")).select(clips.columns)


def valid_orientation(o: Column) -> Column:
    """The orientation if it was recorded under the current convention and a 3.x schema, else null."""
    good = (o["north_convention"] == NORTH_CONVENTION) & F.startswith(F.coalesce(o["schema_version"], F.lit("")), F.lit("3."))
    return F.when(good, o)


def shown_orientation(o: Column) -> Column:
    """Without locked_at; an empty declared end is null."""
    return F.when(o.isNotNull(), F.struct(
        o["anchor_frame_id"].alias("anchor_frame_id"), o["north_convention"].alias("north_convention"), o["method"].alias("method"),
        o["schema_version"].alias("schema_version"), F.nullif(o["declared_end"], F.lit("")).alias("declared_end"),
    ))


def lock_orientations(clips: DataFrame, frames: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (clip_id, frame_id, mode, declared_end, locked_at, seq): the first good one of a clip locks it.

    -> clips after them, and every request with its code (200, 400, 404) and already_locked.
    """
    owner = frames.select(F.col("frame_id").alias("_f"), F.col("clip_id").alias("_owner"))
    there = clips.select(F.col("clip_id").alias("_c"), valid_orientation(F.col("orientation")).isNotNull().alias("_locked"))
    r = requests.join(there, requests.clip_id == F.col("_c"), "left").join(owner, requests.frame_id == F.col("_f"), "left")
    bad_end = (F.col("mode") == "declared") & ~F.coalesce(F.col("declared_end").isin("north", "south"), F.lit(False))
    code = (
        F.when(~F.coalesce(F.col("mode").isin(*ORIENTATION_MODES), F.lit(False)), 400).when(bad_end, 400).when(F.col("_c").isNull(), 404)
        .when(~F.coalesce(F.col("_owner") == F.col("clip_id"), F.lit(False)), 400).otherwise(200)
    )
    r = r.withColumn("code", code)
    first = F.min(F.when(F.col("code") == 200, F.col("seq"))).over(Window.partitionBy("clip_id"))
    r = r.withColumn("already_locked", (F.col("code") == 200) & (F.col("_locked") | (F.col("seq") > first)))
    winner = r.where((F.col("code") == 200) & ~F.col("already_locked"))
    method = F.when(F.col("mode") == "both_ends_visible", "anchor_both_ends_image_left").otherwise("operator_declared_single_end")
    new = winner.select("clip_id", F.struct(
        F.lit(court.SCHEMA_VERSION).alias("schema_version"), F.lit(NORTH_CONVENTION).alias("north_convention"), F.col("frame_id").alias("anchor_frame_id"),
        method.alias("method"), F.col("locked_at"), F.when(F.col("mode") == "declared", F.col("declared_end")).alias("declared_end"),
    ).cast(ORIENTATION).alias("_o"))
    after = clips.join(new, "clip_id", "left").withColumn("orientation", F.coalesce("_o", "orientation")).select(clips.columns)
    return after, r.select(*requests.columns, "code", "already_locked")


def unlock_orientations(clips: DataFrame, frames: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (clip_id, force boolean): refused with 409 where labeled frames depend on it and nothing forces it, 404 for unknown clips."""
    labeled = frames.where("label_status = 'labeled'").groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_labeled"))
    r = requests.join(clips.select("clip_id", F.lit(True).alias("_there")), "clip_id", "left").join(labeled, "clip_id", "left")
    n = F.coalesce("n_labeled", F.lit(0))
    r = r.withColumn("code", F.when(F.col("_there").isNull(), 404).when((n > 0) & ~F.coalesce("force", F.lit(False)), 409).otherwise(200)).withColumn("n_labeled", n)
    gone = r.where("code = 200").select("clip_id").distinct().withColumn("_gone", F.lit(True))
    after = clips.join(gone, "clip_id", "left").withColumn("orientation", F.when(F.col("_gone").isNull(), F.col("orientation"))).select(clips.columns)
    return after, r.select("clip_id", "force", "code", "n_labeled")


def previous_labeled(frames: DataFrame, block: int | None = None) -> DataFrame:
    """frames with prev_frame_id: the labeled frame of the same clip with the largest smaller frame_index, then the largest id.

    With `block` (units of frame_index) a clip is spread over tasks, see operators/blocks.py.
    """
    if block is not None:
        labeled = F.when(F.col("label_status") == "labeled", F.struct("frame_index", "frame_id"))
        f = with_prior(blocked(frames, "frame_index", block), "clip_id", {"_last": F.max(labeled)}, {"_before": lambda b: F.max("_last").over(b)})
        here = F.max(labeled).over(in_block("clip_id", "frame_index").rangeBetween(Window.unboundedPreceding, -1))
        return f.withColumn("prev_frame_id", F.coalesce(here, F.col("_before"))["frame_id"]).drop("_before", BLOCK)
    w = Window.partitionBy("clip_id").orderBy("frame_index").rangeBetween(Window.unboundedPreceding, -1)
    seen = F.max(F.when(F.col("label_status") == "labeled", F.struct("frame_index", "frame_id"))).over(w)
    return frames.withColumn("prev_frame_id", seen["frame_id"])


def prefilled(frames: DataFrame, clips: DataFrame, labels: DataFrame, predictions: DataFrame | None = None, predict: bool = False, block: int | None = None) -> DataFrame:
    """What labeling a frame begins with: frame_id, code, source, keypoints, num_keypoints, orientation.

    Saved label, else the previous labeled frame's points without confidences, else predicted
    points, else empty ones. `predict` with predictions (frame_id, keypoints) skips the first
    two. Without a locked orientation: code 409 and nothing else. A frame must have its clip.
    block: see previous_labeled.
    """
    forced = predict and predictions is not None
    c = clips.select("clip_id", valid_orientation(F.col("orientation")).alias("_o"), F.col("width").alias("image_w"), F.col("height").alias("image_h"))
    out = previous_labeled(frames, block).join(c, "clip_id")
    out = out.join(labels.select("frame_id", F.col("keypoints").alias("_saved")), "frame_id", "left")
    out = out.join(labels.select(F.col("frame_id").alias("prev_frame_id"), F.col("keypoints").alias("_prev")), "prev_frame_id", "left")
    if predictions is not None:
        out = out.join(predictions.select("frame_id", F.col("keypoints").alias("_pred")), "frame_id", "left")
    bare = F.transform("_prev", lambda p: p.withField("src_conf", F.lit(0.0)))
    model = F.coalesce(F.col("_pred"), K.empty_points()).cast(POINTS) if predictions is not None else K.empty_points().cast(POINTS)
    last = "predicted" if predictions is not None else "empty"
    source = F.lit(last) if forced else F.when(F.col("_saved").isNotNull(), "saved").when(F.col("_prev").isNotNull(), "previous_frame").otherwise(last)
    points = model if forced else F.coalesce(F.col("_saved"), bare, model)
    ready = F.col("_o").isNotNull()
    return out.select(
        "frame_id", F.when(ready, 200).otherwise(409).alias("code"), F.when(ready, source).alias("source"), "image_w", "image_h",
        F.when(ready, points).alias("keypoints"), F.when(ready, F.size(points)).alias("num_keypoints"), shown_orientation(F.col("_o")).alias("orientation"),
    )


def save_labels(labels: DataFrame, frames: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted labels (the labels' columns and seq) replace earlier ones of the same frame and mark it labeled."""
    new = latest(accepted, "frame_id")
    after = labels.join(new.select("frame_id"), "frame_id", "left_anti").unionByName(new)
    marked = frames.join(new.select("frame_id", F.lit("labeled").alias("_l")), "frame_id", "left").withColumn("label_status", F.coalesce("_l", "label_status"))
    return after, marked.select(frames.columns)


def labels_missing(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Labeled frames that have no label."""
    return frames.where("label_status = 'labeled'").join(labels, "frame_id", "left_anti")


def migrate(clips: DataFrame, frames: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Drops labels not of a 3.x schema, resets frames that lose or lack their label, and orientations of other schemas.

    -> clips, frames, labels, and one row of counts (removed, reset, unlocked, changed). Running it again changes nothing.
    """
    current = F.startswith(F.coalesce(F.col("schema.schema_version"), F.lit("")), F.lit("3."))
    kept, removed = labels.where(current), labels.where(~current)
    have = kept.select("frame_id", F.lit(True).alias("_has")).distinct()
    lost = (F.col("label_status") == "labeled") & F.col("_has").isNull()
    f = frames.join(have, "frame_id", "left").withColumn("_lost", F.coalesce(lost, F.lit(False)))
    stale = F.col("orientation").isNotNull() & valid_orientation(F.col("orientation")).isNull()
    counts = (
        removed.agg(F.count(F.lit(1)).alias("removed")).crossJoin(f.agg(F.count_if("_lost").alias("reset"))).crossJoin(clips.agg(F.count_if(stale).alias("unlocked")))
        .withColumn("changed", (F.col("removed") + F.col("reset") + F.col("unlocked")) > 0)
    )
    frames_after = f.withColumn("label_status", F.when(F.col("_lost"), "unlabeled").otherwise(F.col("label_status"))).select(frames.columns)
    return clips.withColumn("orientation", F.when(~stale, F.col("orientation"))), frames_after, kept, counts


def sticky_ends(events: DataFrame, block: int | None = None) -> DataFrame:
    """events (clip_id, seq, visible_ends): the last value confirmed in the clip up to each event. With `block` (units of seq) a clip is spread over tasks."""
    if block is not None:
        last = F.max_by("visible_ends", F.when(F.col("visible_ends").isNotNull(), F.col("seq")))
        f = with_prior(blocked(events, "seq", block), "clip_id", {"_last": last}, {"_before": lambda b: F.last("_last", ignorenulls=True).over(b)})
        here = F.last("visible_ends", ignorenulls=True).over(in_block("clip_id", "seq").rowsBetween(Window.unboundedPreceding, 0))
        return f.withColumn("sticky", F.coalesce(here, "_before")).drop("_before", BLOCK)
    w = Window.partitionBy("clip_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("sticky", F.last("visible_ends", ignorenulls=True).over(w))


def trained_splits(listing: DataFrame) -> DataFrame:
    """listing (frame_id, split): one row per frame; val wins over train."""
    return listing.groupBy("frame_id").agg(F.max_by("split", F.when(F.col("split") == "val", 1).otherwise(0)).alias("trained_split"))


def trained_progress(frames: DataFrame, trained: DataFrame) -> DataFrame:
    """Per clip: frames that are to be kept, labeled ones among them, and ones that a model was trained on."""
    t = trained.select("frame_id", F.lit(True).alias("_t"))
    return frames.join(t, "frame_id", "left").groupBy("clip_id").agg(
        F.count_if(triage_of() == "keep").alias("kept"), F.count_if(F.col("label_status") == "labeled").alias("labeled"), F.count_if(F.col("_t").isNotNull()).alias("trained"),
    )
