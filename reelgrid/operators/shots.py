"""Ordered operators over the frames of a run: scene cuts, shots, error runs, segments, summaries.

Runs are independent, and frame_index is unique in a run. Without `block` a window is over one
run in frame order, which suits runs that are videos; with it (units of the order column a
block) a run is spread over tasks, see operators/blocks.py. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.operators.blocks import BLOCK, blocked, in_block, with_prior

SCENE_THRESHOLD = 0.5
MAX_CONSECUTIVE_ERRORS = 100
SEGMENT_FRAMES = 1000
BINS = 64


def _stretches(sizes: np.ndarray, most: int = 1 << 24) -> Iterator[slice]:
    """Neighbouring rows of together at most so many numbers (or a single row)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > lo:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield slice(lo, len(sizes))


def _shares(values: np.ndarray, starts: np.ndarray, bins: int) -> np.ndarray:
    """Share of each row's values (0 to 255) in each of the bins; one count over rows and bins together. No value: not-a-number."""
    sizes, out = np.diff(starts), np.full((len(starts) - 1, bins), np.nan)
    for part in _stretches(sizes):
        n = sizes[part]
        here = values[starts[part.start] : starts[part.stop]]
        at = here // (256 // bins) if here.dtype == np.uint8 else np.floor(here / (256 // bins))
        row = np.repeat(np.arange(len(n)), n)
        inside = (at >= 0) & (at < bins)
        counts = np.bincount(row[inside] * bins + at[inside].astype(np.int64), minlength=len(n) * bins).reshape(-1, bins)
        out[part] = np.divide(counts, n[:, None], out=np.full(counts.shape, np.nan), where=n[:, None] > 0)
    return out


def _histograms(shares: np.ndarray, null: np.ndarray) -> pa.Array:
    flat = shares[~null].ravel()
    starts = np.concatenate([[0], np.cumsum(np.where(null, 0, shares.shape[1]))]).astype(np.int32)
    offsets = pa.array(starts, mask=np.append(null, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))


def _bytes(payload: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where each row begins, and which rows are null."""
    payload = payload.cast(pa.large_binary())
    _, offsets, data = payload.buffers()
    starts = np.frombuffer(offsets, np.int64)[payload.offset : payload.offset + len(payload) + 1] if len(payload) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), starts, payload.is_null().to_numpy(zero_copy_only=False)


def grey_histogram(pixels: Column, bins: int = BINS) -> Column:
    """Share of pixels (0 to 255; an array or bytes) in each of the bins. Null: null; no pixel: nulls."""

    @F.arrow_udf("array<double>")
    def count(batch: pa.Array) -> pa.Array:
        if pa.types.is_binary(batch.type) or pa.types.is_large_binary(batch.type):
            values, starts, null = _bytes(batch)
        else:
            null = batch.is_null().to_numpy(zero_copy_only=False)
            sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            values = batch.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        return _histograms(_shares(values, starts, bins), null)

    return count(pixels)


#: Weights of blue, green and red in grey (BT.601) as whole shares of 2^15.
BLUE, GREEN, RED, GREY_BITS = 3735, 19235, 9798, 15


def grey_of(bgr: np.ndarray) -> np.ndarray:
    """Grey of pixels (n, 3) of blue, green, red bytes, in whole numbers, rounded to nearest."""
    wide = bgr.astype(np.uint32)
    return ((wide[:, 0] * BLUE + wide[:, 1] * GREEN + wide[:, 2] * RED + (1 << (GREY_BITS - 1))) >> GREY_BITS).astype(np.uint8)


def colour_histogram(payload: Column, bins: int = BINS) -> Column:
    """grey_histogram of raw colour frames (bytes of blue, green, red, pixel after pixel; bytes that make no whole pixel at the end count for nothing)."""

    @F.arrow_udf("array<double>")
    def count(batch: pa.Array) -> pa.Array:
        data, starts, null = _bytes(batch)
        pixels, out = np.diff(starts) // 3, np.full((len(batch), bins), np.nan)
        for part in _stretches(pixels, 1 << 22):
            rows = [data[starts[i] : starts[i] + 3 * pixels[i]] for i in range(part.start, part.stop)]
            grey = grey_of((np.concatenate(rows) if len(rows) > 1 else rows[0]).reshape(-1, 3))
            out[part] = _shares(grey, np.concatenate([[0], np.cumsum(pixels[part])]), bins)
        return _histograms(out, null)

    return count(payload.cast("binary"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long histograms; 1 where one of them is flat."""
    n = F.size(a)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    cross = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    squares = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x * x)
    sums = F.struct(n.alias("n"), cross.alias("ab"), total(a).alias("a"), total(b).alias("b"), squares(a).alias("aa"), squares(b).alias("bb"))

    def of(t: Column) -> Column:
        low = (t["aa"] - t["a"] * t["a"] / t["n"]) * (t["bb"] - t["b"] * t["b"] / t["n"])
        return F.when(F.abs(low) > 2.220446049250313e-16, (t["ab"] - t["a"] * t["b"] / t["n"]) / F.sqrt(low)).when(low.isNotNull(), F.lit(1.0))

    # named by a lambda: Spark would go over the bins again wherever a sum is used
    return F.get(F.transform(F.array(sums), of), 0)


def scene_cuts(frames: DataFrame, threshold: float = SCENE_THRESHOLD, run: str = "run_id", order: str = "frame_index", hist: str = "hist", block: int | None = None) -> DataFrame:
    """Adds cut: correlation with the frame before is below the threshold; a run's first frame is no cut."""
    if block is not None:
        w = in_block(run, order)
        f = with_prior(blocked(frames, order, block), run, {"_end": F.max_by(F.struct(hist), order)}, {"_edge": lambda b: F.last("_end").over(b)})
        f = f.withColumn("_prev", F.when(F.row_number().over(w) == 1, F.col(f"_edge.{hist}")).otherwise(F.lag(hist).over(w)))
        return f.withColumn("cut", F.coalesce(correlation(F.col("_prev"), F.col(hist)) < threshold, F.lit(False))).drop("_prev", "_edge", BLOCK)
    w = Window.partitionBy(run).orderBy(order)
    return frames.withColumn("_prev", F.lag(hist).over(w)).withColumn("cut", F.coalesce(correlation(F.col("_prev"), F.col(hist)) < threshold, F.lit(False))).drop("_prev")


def shots(frames: DataFrame, start_shot: int = 0, run: str = "run_id", order: str = "frame_index", cut: str = "cut", block: int | None = None) -> DataFrame:
    """Adds shot_id, the cuts counted up, and scene_cut; a run's first frame opens a shot without counting."""
    if block is not None:
        w, whole = in_block(run, order), F.col(cut).cast("int")
        totals = {"_n": F.sum(whole), "_first": F.min_by(whole, order)}
        f = with_prior(blocked(frames, order, block), run, totals, {"_before": lambda b: F.sum("_n").over(b) - F.first("_first").over(b)})
        first = F.col("_before").isNull() & (F.row_number().over(w) == 1)
        f = f.withColumn("_is_first", first).withColumn("shot_id", (F.coalesce("_before", F.lit(0)) + F.sum(F.when(F.col("_is_first"), 0).otherwise(whole)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + start_shot).cast("int"))
        return f.withColumn("scene_cut", F.col("_is_first") | F.col(cut)).drop("_before", "_is_first", BLOCK)
    w = Window.partitionBy(run).orderBy(order)
    first = F.row_number().over(w) == 1
    counted = F.sum(F.when(first, 0).otherwise(F.col(cut).cast("int"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frames.withColumns({"shot_id": (counted + start_shot).cast("int"), "scene_cut": first | F.col(cut)})


def error_runs(frames: DataFrame, run: str = "run_id", order: str = "frame_index", failed: str = "failed", block: int | None = None) -> DataFrame:
    """Adds error_run: consecutive failures up to and with each frame, 0 where it did not fail."""
    if block is not None:
        # failures so far less those there were at the last frame that did not fail
        w = in_block(run, order).rowsBetween(Window.unboundedPreceding, 0)
        f = blocked(frames, order, block).withColumn("_p", F.count_if(failed).over(w))
        f = with_prior(
            f, run, {"_n": F.count_if(failed), "_q": F.max(F.when(~F.col(failed), F.col("_p")))},
            {"_before": lambda b: F.coalesce(F.sum("_n").over(b), F.lit(0))}, {"_base": lambda b: F.max(F.col("_before") + F.col("_q")).over(b)},
        )
        here = F.max(F.when(~F.col(failed), F.col("_p"))).over(w)
        since = F.coalesce(F.col("_before") + here, F.col("_base"), F.lit(0))
        return f.withColumn("error_run", F.col("_before") + F.col("_p") - since).drop("_p", "_before", "_base", BLOCK)
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    island = frames.withColumn("_ok", F.count_if(~F.col(failed)).over(w))
    inside = Window.partitionBy(run, "_ok").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("error_run", F.count_if(failed).over(inside)).drop("_ok")


def until_abort(frames: DataFrame, limit: int = MAX_CONSECUTIVE_ERRORS, run: str = "run_id", order: str = "frame_index", failed: str = "failed", block: int | None = None) -> DataFrame:
    """Frames up to and with the first whose error run reaches the limit; adds error_run and aborted (of the run)."""
    marked = error_runs(frames, run, order, failed, block)
    if block is not None:
        over = marked.where(F.col("error_run") >= limit).groupBy(F.col(run).alias("_run")).agg(F.min(order).alias("_stop"))
        out = marked.join(over, F.col(run).eqNullSafe(F.col("_run")), "left").where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
        return out.withColumn("aborted", F.col("_stop").isNotNull()).drop("_run", "_stop")
    w = Window.partitionBy(run)
    stop = F.min(F.when(F.col("error_run") >= limit, F.col(order))).over(w)
    return marked.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).withColumn("aborted", F.col("_stop").isNotNull()).drop("_stop")


def segments(frames: DataFrame, size: int = SEGMENT_FRAMES, start_segment: int = 0, run: str = "run_id", order: str = "frame_index", block: int | None = None) -> DataFrame:
    """Adds segment_index: stretches of `size` records in order."""
    if block is not None:
        f = with_prior(blocked(frames, order, block), run, {"_n": F.count(F.lit(1))}, {"_before": lambda b: F.coalesce(F.sum("_n").over(b), F.lit(0))})
        at = F.col("_before") + F.row_number().over(in_block(run, order)) - 1
        return f.withColumn("segment_index", (F.floor(at / size) + start_segment).cast("int")).drop("_before", BLOCK)
    w = Window.partitionBy(run).orderBy(order)
    return frames.withColumn("segment_index", (F.floor((F.row_number().over(w) - 1) / size) + start_segment).cast("int"))


@dataclass
class Carry:
    """Where an ordered run stands after some of its frames; `tracker` is the open shot's (see operators.tracking)."""

    shot: int = 0
    segment: int = 0  # of the next record
    filled: int = 0  # records of that segment so far
    error_run: int = 0
    opened: bool = False
    hist: list[float] | None = None
    tracker: str | None = None
    frame: int = -1


def going_on(frames: DataFrame, carry: Carry, threshold: float = SCENE_THRESHOLD, segment_frames: int = SEGMENT_FRAMES, limit: int = MAX_CONSECUTIVE_ERRORS, block: int | None = None) -> DataFrame:
    """shot_id, scene_cut, error_run, segment_index and aborted of one run's next frames (frame_index, hist, error), from where it stands.

    The same as scene_cuts, shots, until_abort and segments over the whole run; frames after an abort go.
    With `block` the frames are spread over tasks, as there.
    """
    if block is not None:
        return _going_on_by_blocks(frames, carry, threshold, segment_frames, limit, block)
    w = Window.partitionBy("run_id").orderBy("frame_index")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    no, failed = F.row_number().over(w), F.col("error").isNotNull()
    before = F.lit(carry.hist).cast("array<double>") if carry.hist is not None else F.lit(None).cast("array<double>")
    f = frames.withColumns({"_no": no, "_prev": F.when(no == 1, before).otherwise(F.lag("hist").over(w)), "_ok": F.count_if(~failed).over(so_far)})
    f = f.withColumn("_cut", F.coalesce(correlation(F.col("_prev"), F.col("hist")) < threshold, F.lit(False)))
    inside = Window.partitionBy("run_id", "_ok").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumns({
        "shot_id": (F.sum(F.col("_cut").cast("int")).over(so_far) + carry.shot).cast("int"), "scene_cut": F.col("_cut") | F.lit(not carry.opened) & (F.col("_no") == 1),
        "error_run": F.count_if(failed).over(inside) + F.when(F.col("_ok") == 0, carry.error_run).otherwise(0),
        "segment_index": (F.floor((F.col("_no") - 1 + carry.filled) / segment_frames) + carry.segment).cast("int"),
    })
    stop = F.min(F.when(F.col("error_run") >= limit, F.col("frame_index"))).over(Window.partitionBy("run_id"))
    f = f.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("frame_index") <= F.col("_stop")))
    return f.withColumn("aborted", F.col("_stop").isNotNull()).drop("_no", "_prev", "_ok", "_cut", "_stop")


def _going_on_by_blocks(frames: DataFrame, carry: Carry, threshold: float, segment_frames: int, limit: int, block: int) -> DataFrame:
    w = in_block("run_id", "frame_index")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    no, failed = F.row_number().over(w), F.col("error").isNotNull()
    f = with_prior(blocked(frames, "frame_index", block), "run_id", {"_end": F.max_by(F.struct("hist"), "frame_index")}, {"_edge": lambda b: F.last("_end").over(b)})
    before = F.when(F.col("_edge").isNull(), F.lit(carry.hist).cast("array<double>")).otherwise(F.col("_edge.hist")) if carry.hist is not None else F.col("_edge.hist")
    f = f.withColumns({"_no": no, "_prev": F.when(no == 1, before).otherwise(F.lag("hist").over(w)), "_p": F.count_if(failed).over(so_far)})
    f = f.withColumn("_cut", F.coalesce(correlation(F.col("_prev"), F.col("hist")) < threshold, F.lit(False))).drop("_prev", "_edge")
    sums = lambda c: lambda b: F.coalesce(F.sum(c).over(b), F.lit(0))
    totals = {"_rows": F.count(F.lit(1)), "_cuts": F.count_if("_cut"), "_fails": F.count_if(failed), "_q": F.max(F.when(~failed, F.col("_p")))}
    f = with_prior(f, "run_id", totals, {"_r": sums("_rows"), "_c": sums("_cuts"), "_f": sums("_fails")}, {"_base": lambda b: F.max(F.col("_f") + F.col("_q")).over(b)})
    since = F.coalesce(F.col("_f") + F.max(F.when(~failed, F.col("_p"))).over(so_far), F.col("_base"), F.lit(-carry.error_run))  # as in error_runs
    f = f.withColumns({
        "shot_id": (F.col("_c") + F.sum(F.col("_cut").cast("int")).over(so_far) + carry.shot).cast("int"), "scene_cut": F.col("_cut") | F.lit(not carry.opened) & (F.col("_r") + F.col("_no") == 1),
        "error_run": F.col("_f") + F.col("_p") - since, "segment_index": (F.floor((F.col("_r") + F.col("_no") - 1 + carry.filled) / segment_frames) + carry.segment).cast("int"),
    }).drop("_no", "_p", "_cut", "_r", "_c", "_f", "_base", BLOCK)
    over = f.where(F.col("error_run") >= limit).groupBy(F.col("run_id").alias("_run")).agg(F.min("frame_index").alias("_stop"))
    f = f.join(over, F.col("run_id").eqNullSafe(F.col("_run")), "left").where(F.col("_stop").isNull() | (F.col("frame_index") <= F.col("_stop")))
    return f.withColumn("aborted", F.col("_stop").isNotNull()).drop("_run", "_stop")


def carried(rows: DataFrame, carry: Carry, segment_frames: int) -> tuple[Carry, bool]:
    """Where the run stands after these rows of going_on (without the tracker), and whether it was aborted; the same carry if there are none."""
    last = F.max_by(F.struct("shot_id", "error_run", "hist", "frame_index"), "frame_index")
    r = rows.agg(last.alias("last"), F.count(F.lit(1)).alias("n"), F.bool_or("aborted").alias("aborted")).first()
    if not r["n"]:
        return carry, False
    end, whole = r["last"], carry.filled + r["n"]
    return Carry(end["shot_id"], carry.segment + whole // segment_frames, whole % segment_frames, end["error_run"], True, end["hist"], None, end["frame_index"]), r["aborted"]


def segment_rollup(records: DataFrame, run: str = "run_id", order: str = "frame_index") -> DataFrame:
    """Per run and segment: start_frame, end_frame, n_records, errors, path, status."""
    return records.groupBy(run, "segment_index").agg(
        F.min(order).alias("start_frame"), F.max(order).alias("end_frame"), F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    ).withColumns({"path": F.format_string("records/seg_%05d.jsonl", "segment_index"), "status": F.lit("done")})


def resume_points(segments: DataFrame, last_shots: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run of last_shots (run, last_shot_id), after its last done segment: start_index, start_segment, start_shot; zeros without one."""
    last = segments.where("status = 'done'").groupBy(run).agg(F.max_by(F.struct("end_frame", "segment_index"), "segment_index").alias("s"))
    begun = F.col("s").isNotNull()
    return last_shots.join(last, run, "left").select(
        run, F.when(begun, F.col("s.end_frame") + 1).otherwise(0).alias("start_index"), F.when(begun, F.col("s.segment_index") + 1).otherwise(0).alias("start_segment"),
        F.when(begun, F.coalesce("last_shot_id", F.lit(-1)) + 1).otherwise(0).alias("start_shot"),
    )


def run_summary(records: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: frames_processed, frames_with_homography, errors, shots, unique_tracks.

    Distinct shots count error frames too; tracks are distinct (shot, track) pairs. The
    pairs are made distinct per frame before they leave the scan."""
    tracks = F.array_distinct(F.transform(F.filter("players", lambda p: p["track_id"].isNotNull()), lambda p: p["track_id"]))
    ok = F.col("error").isNull()
    basic = records.groupBy(run).agg(
        F.count(F.lit(1)).alias("frames_processed"), F.count_if(ok & F.col("court.homography").isNotNull()).alias("frames_with_homography"),
        F.count_if(~ok).alias("errors"), F.count_distinct("shot_id").alias("shots"),
    )
    pairs = records.where(ok).select(run, "shot_id", F.explode(tracks).alias("track_id")).distinct().groupBy(run).agg(F.count(F.lit(1)).alias("unique_tracks"))
    return basic.join(pairs, run, "left").withColumn("unique_tracks", F.coalesce("unique_tracks", F.lit(0)))
