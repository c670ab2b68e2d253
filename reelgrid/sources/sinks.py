"""Idempotent sinks: writing a segment or a manifest again replaces it."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.operators.catalog import migrate
from reelgrid.sources.files import read_text, remove, shared_write, write_text_atomically
from reelgrid.sources.named_files import delete_files, spread, write_files


def write_records(records: DataFrame, folder: str, fmt: str = "json") -> None:
    """Partitions run_id, segment_index; only the segments that occur are replaced."""
    keyed = records.repartition("run_id", "segment_index").sortWithinPartitions("run_id", "segment_index", "frame_index")
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "segment_index").format(fmt).save(folder)


def write_shards(records: DataFrame, run_dir: str) -> list[str]:
    """One run's records/seg_NNNNN.jsonl, a file per segment and a line per record in frame order, nulls written out."""
    spark = records.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    temp = posixpath.join(run_dir, ".records")
    fields = [c for c in records.columns if c not in ("run_id", "segment_index")]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value")
    rows = records.repartition("segment_index").sortWithinPartitions("segment_index", "frame_index").select(line, "segment_index")
    rows.write.mode("overwrite").partitionBy("segment_index").text(temp)
    fs = jvm.org.apache.hadoop.fs.Path(temp).getFileSystem(conf)
    target = jvm.org.apache.hadoop.fs.Path(posixpath.join(run_dir, "records"))
    fs.mkdirs(target)
    names = []
    for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(temp)):
        folder = status.getPath()
        if not folder.getName().startswith("segment_index="):
            continue
        name = f"seg_{int(folder.getName().split('=')[1]):05d}.jsonl"
        part = next(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
        final = jvm.org.apache.hadoop.fs.Path(target, name)
        fs.delete(final, False)
        fs.rename(part, final)
        names.append(name)
    fs.delete(jvm.org.apache.hadoop.fs.Path(temp), True)
    return sorted(names)


def save_json(spark: SparkSession, path: str, data: dict) -> None:
    write_text_atomically(spark, path, json.dumps(data, indent=2) + "\n")


def load_json(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, path)
    return None if text is None else json.loads(text)


def clear_run(spark: SparkSession, run_dir: str) -> None:
    remove(spark, posixpath.join(run_dir, "records"))
    remove(spark, posixpath.join(run_dir, "run.json"))


def reset_project(spark: SparkSession, folder: str, export: str | None = None) -> None:
    """Derived files go; videos and schemas stay."""
    for name in ("frames", "thumbs", "labels", "manifest.json"):
        remove(spark, posixpath.join(folder, name))
    if export:
        remove(spark, export)


def save_manifest(clips: DataFrame, frames: DataFrame, folder: str) -> None:
    """manifest.json from both tables; a catalog this small is the file's own limit. Large catalogs stay tables."""
    entry = lambda df, key: {r[key]: {k: v for k, v in r.asDict(True).items() if k != key and v is not None} for r in df.orderBy(key).toLocalIterator()}
    save_json(clips.sparkSession, posixpath.join(folder, "manifest.json"), {"version": 1, "clips": entry(clips, "clip_id"), "frames": entry(frames, "frame_id")})


def write_labels(labels: DataFrame, frames: DataFrame, folder: str) -> int:
    """labels/<clip_id>/<frame_id>.json of every label whose frame is known, written again as a whole by the tasks; returns their number."""
    body = F.concat(F.to_json(F.struct(*labels.columns), {"ignoreNullFields": "false"}), F.lit("\n"))
    rows = labels.join(frames.select("frame_id", "clip_id"), "frame_id")
    return write_files(spread(rows.select(_label_name(), body.alias("content"))), posixpath.join(folder, "labels"))


def _label_name() -> Column:
    return F.concat("clip_id", F.lit("/"), "frame_id", F.lit(".json")).alias("name")


def remove_labels(gone: DataFrame, frames: DataFrame, folder: str) -> int:
    """Deletes the label files of `gone` (frame_id); returns how many there were."""
    names = gone.select("frame_id").join(frames.select("frame_id", "clip_id"), "frame_id").select(_label_name())
    return delete_files(names, posixpath.join(folder, "labels"))


def migrate_project(clips: DataFrame, frames: DataFrame, labels: DataFrame, folder: str) -> dict:
    """Migration of a project folder: outdated label files go, manifest.json is written if anything changes. A second run finds nothing to do.

    Returns removed, reset, unlocked, changed.
    """
    new_clips, new_frames, kept, counts = migrate(clips, frames, labels)
    found = counts.first().asDict()
    if found["changed"]:
        # the manifest first: where a crash comes between, the next run still finds the outdated files
        save_manifest(new_clips, new_frames, folder)
        remove_labels(labels.join(kept.select("frame_id"), "frame_id", "left_anti"), frames, folder)
    return found


def write_pictures(frames: DataFrame, folder: str, render: Callable[[bytes, int | None], bytes], thumb_width: int = 320) -> DataFrame:
    """Writes each row's payload as folder/<image> and, at thumb_width, as folder/<thumb>; returns frame_id and both sizes in bytes.

    frames: frame_id, image, thumb, payload. render(payload, width or None) -> encoded picture;
    its height follows functions.scalars.thumb_height. Tasks write under another name and then
    rename, so that a task that is run again replaces its files. The folder must be one that
    every executor reaches (pyarrow.fs). The result is lazy: nothing is written before it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def put(name: str, data: bytes) -> int:
            shared_write(posixpath.join(folder, name), data)
            return len(data)

        for b in batches:
            done = [(i, put(image, render(p, None)), put(thumb, render(p, thumb_width))) for i, image, thumb, p in zip(b["frame_id"], b["image"], b["thumb"], b["payload"], strict=True)]
            yield pd.DataFrame(done, columns=["frame_id", "image_bytes", "thumb_bytes"])

    return frames.select("frame_id", "image", "thumb", "payload").mapInPandas(run, "frame_id string, image_bytes long, thumb_bytes long")
