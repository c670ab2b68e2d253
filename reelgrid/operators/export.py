"""Training-set export: checks, deterministic split, label lines, files."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid import court
from reelgrid.functions import keypoints as K
from reelgrid.functions import scalars as S
from reelgrid.operators.catalog import labels_missing
from reelgrid.sources.named_files import spread, write_files


class ExportRefused(ValueError):
    pass


def export_lines(frames: DataFrame, labels: DataFrame, val_fraction: float = 0.1, box: str = "full") -> DataFrame:
    """frame_id, split, line, image of every labeled frame that has a label; nothing is written."""
    both = frames.where("label_status = 'labeled'").join(labels.drop("image"), "frame_id")
    w, h = F.col("image_w").cast("double"), F.col("image_h").cast("double")
    line = F.concat_ws(" ", F.lit("0"), K.box_text(F.col("keypoints"), w, h, box), K.point_text(F.col("keypoints"), w, h))
    return both.select("frame_id", "clip_id", S.split_of(F.col("frame_id"), val_fraction).alias("split"), line.alias("line"), "image")


def refused_labels(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """frame_id and number of points of labels of labeled frames that are of another schema or have another number of points."""
    both = frames.where("label_status = 'labeled'").select("frame_id").join(labels, "frame_id")
    other = ~(F.col("schema.schema_name").eqNullSafe(court.SCHEMA_NAME) & F.col("schema.schema_version").eqNullSafe(court.SCHEMA_VERSION))
    return both.where(other | (F.size("keypoints") != court.COUNT)).select("frame_id", F.size("keypoints").alias("n"))


def check_labels(frames: DataFrame, labels: DataFrame) -> None:
    """The whole export is refused if a label is of another schema or has another number of points."""
    bad = refused_labels(frames, labels).orderBy("frame_id").first()
    if bad:
        raise ExportRefused(f"{bad.frame_id}: not {court.COUNT} points of {court.SCHEMA_NAME} {court.SCHEMA_VERSION} (has {bad.n})")
    if frames.where("label_status = 'labeled'").isEmpty():
        raise ExportRefused("no labeled frames")


def split_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def data_yaml(out: str) -> str:
    head = f"# Canonical schema: {court.SCHEMA_NAME} ({court.SCHEMA_VERSION})\n"
    return f"{head}path: {out}\ntrain: images/train\nval: images/val\nkpt_shape: [{court.COUNT}, 3]\nflip_idx: {court.flip_order()}\nnames:\n  0: court\n"


def export(
    frames: DataFrame, labels: DataFrame, out: str, val_fraction: float = 0.1, box: str = "full", images: str | None = None, schema_file: str | None = None, packed: bool = False,
) -> dict[str, int]:
    """Rebuilds `out`: labels/<split>/<frame_id>.txt, images/<split>/<frame_id>.<ending> copied from the folder `images`, data.yaml and a
    copy of schema_file; returns rows per split and `missing`.

    Tasks write the lines and copy the pictures beside `out`, which is replaced in one rename
    when all are done; an export that fails leaves the former one. packed=True is for sets of
    too many files for a folder: labels/split=train|val as text rows `frame_id TAB line`,
    without pictures.
    """
    check_labels(frames, labels)
    spark = frames.sparkSession
    lines = export_lines(frames, labels, val_fraction, box)
    one = spark.range(1)
    none = F.lit(None).cast("string")
    files = one.select(F.lit("data.yaml").alias("name"), F.lit(data_yaml(out)).alias("content"), none.alias("source"))
    if schema_file is not None:
        files = files.unionByName(one.select(F.lit(posixpath.basename(schema_file)).alias("name"), none.alias("content"), F.lit(schema_file).alias("source")))
    if not packed:
        files = files.unionByName(lines.select(F.concat(F.lit("labels/"), "split", F.lit("/"), "frame_id", F.lit(".txt")).alias("name"), F.concat("line", F.lit("\n")).alias("content"), none.alias("source")))
        if images is not None:
            ending = F.regexp_extract("image", r"(\.[A-Za-z0-9]+)$", 1)
            files = files.unionByName(lines.where("image is not null").select(F.concat(F.lit("images/"), "split", F.lit("/"), "frame_id", ending).alias("name"), none.alias("content"), F.concat(F.lit(images.rstrip("/") + "/"), "image").alias("source")))
    write_files(spread(files), out, overwrite=True)
    if packed:
        lines.select(F.concat_ws("\t", "frame_id", "line").alias("value"), "split").write.mode("overwrite").partitionBy("split").text(posixpath.join(out, "labels"))
    counts = {"train": 0, "val": 0} | {r["split"]: r["n"] for r in split_counts(lines).collect()}
    return counts | {"missing": labels_missing(frames, labels).count()}


def training_manifest(lines: DataFrame, trained_at: str, data: str, model_init: str) -> DataFrame:
    """One row: trained_at, data, model_init, frames (map of frame_id to split)."""
    return lines.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("frame_id", "split")))).alias("frames")).select(
        F.lit(trained_at).alias("trained_at"), F.lit(data).alias("data"), F.lit(model_init).alias("model_init"), "frames",
    )
