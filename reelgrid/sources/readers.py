"""Tables from the files of a labeling project and of pipeline runs. All schemas are stated; a missing file is an empty table."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import schemas
from reelgrid.functions import scalars as S
from reelgrid.operators.catalog import trained_splits
from reelgrid.sources.files import exists
from reelgrid.sources.named_files import read_files

VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv")


def read_manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """clips and frames of manifest.json; both empty if there is none, missing keys count as empty."""
    path = posixpath.join(folder, "manifest.json")
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.CLIPS), spark.createDataFrame([], schemas.FRAMES)
    clip, frame = f"struct<{_colons(schemas.CLIP_FIELDS)}>", f"struct<{_colons(schemas.FRAME_FIELDS)}>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"clips map<string,{clip}>, frames map<string,{frame}>").alias("m"))
    clips = whole.select(F.explode("m.clips").alias("clip_id", "c")).select("clip_id", "c.*")
    frames = whole.select(F.explode("m.frames").alias("frame_id", "f")).select("frame_id", "f.*")
    return clips, frames.withColumns({"triage": F.coalesce("triage", F.lit("pending")), "label_status": F.coalesce("label_status", F.lit("unlabeled"))})


def _colons(ddl: str) -> str:
    return ", ".join(":".join(part.split(" ", 1)) for part in _split(ddl))


def _split(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One row per labels/<clip>/<frame>.json."""
    text = read_files(spark, posixpath.join(folder, "labels"), ".json").select(F.regexp_replace(F.col("content").cast("string"), r"^\x{FEFF}?\s+|^\x{FEFF}", "").alias("text")).where("text <> ''")
    one, many = F.from_json("text", schemas.LABELS), F.from_json("text", f"array<struct<{_colons(schemas.LABELS)}>>")
    return text.select(F.explode_outer(F.when(F.startswith("text", F.lit("[")), many).otherwise(F.array(one))).alias("l")).select("l.*")


def list_videos(spark: SparkSession, folder: str, clip: str | None = None) -> DataFrame:
    """clip_id, path, filename, file_size, file_mtime of the videos in a folder, by name; contents are not read."""
    suffixes = "|".join(VIDEO_SUFFIXES)
    files = spark.read.format("binaryFile").load(folder).drop("content").where(F.lower("path").rlike(rf"\.({suffixes})$"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = files.select(S.clip_id(name).alias("clip_id"), "path", name.alias("filename"), F.col("length").alias("file_size"), (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"))
    if clip is not None:
        out = out.where(F.col("clip_id") == clip)
        if out.isEmpty():
            raise ValueError(f"no clip {clip} in {folder}")
    return out.orderBy("filename")


def read_records(spark: SparkSession, run_dir: str) -> tuple[DataFrame, DataFrame]:
    """records (with run_id and segment_index from the path) and torn lines (value, segment_index) of records/seg_*.jsonl."""
    ddl = f"{schemas.RECORD}, _torn string"
    lines = spark.read.text(posixpath.join(run_dir, "records", "seg_*.jsonl")).select(
        "value", F.from_json("value", ddl, {"columnNameOfCorruptRecord": "_torn"}).alias("r"),
        F.regexp_extract("_metadata.file_path", r"([^/]+)/records/[^/]+$", 1).alias("run_id"), F.regexp_extract("_metadata.file_path", r"seg_(\d+)\.jsonl", 1).cast("int").alias("segment_index"),
    )
    return lines.where("r._torn is null").select("r.*", "run_id", "segment_index").drop("_torn"), lines.where("r._torn is not null").select("value", "segment_index")


def read_run_manifest(spark: SparkSession, run_dir: str) -> DataFrame | None:
    path = posixpath.join(run_dir, "run.json")
    if not exists(spark, path):
        return None
    return spark.read.schema(schemas.RUN_MANIFEST).option("multiLine", True).json(path)


class BadSchema(ValueError):
    pass


def read_keypoint_schema(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """One row per point of a keypoint schema file, with the file's header columns.

    With `count` the file must have that many points, in order of their index from 1 on; else BadSchema.
    """
    point = "struct<index:int,id:string,feature:string,end:string,side:string,court_position:string,court_xy_ft:array<double>,diagram_xy:array<double>>"
    ddl = f"schema_name string, schema_version string, visible_ends_values array<string>, reference_court struct<length:double,width:double>, keypoints array<{point}>"
    whole = spark.read.schema(ddl).option("multiLine", True).json(path)
    if count is not None:
        found = [i for r in whole.select("keypoints.index").collect() for i in r["index"] or []]  # one small file
        if found != list(range(1, count + 1)):
            raise BadSchema(f"{path}: {len(found)} keypoints where {count} of contiguous index are needed")
    return whole.select("schema_name", "schema_version", "reference_court.length", "reference_court.width", F.explode("keypoints").alias("p")).select("p.*", "schema_name", "schema_version", "length", "width")


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """template, id, along, across, length, width of a court template file."""
    whole = spark.read.schema("template_name string, length double, width double, court_xy_ft map<string,array<double>>").option("multiLine", True).json(path)
    return whole.select(F.col("template_name").alias("template"), "length", "width", F.explode("court_xy_ft").alias("id", "xy")).select(
        "template", "id", F.get("xy", 0).alias("along"), F.get("xy", 1).alias("across"), "length", "width",
    )


def read_split_listing(spark: SparkSession, export_dir: str) -> DataFrame:
    """frame_id and split of an export's label files; in both, val wins."""
    parts = [
        spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("frame_id"), F.lit(split).alias("split")).where("frame_id <> ''")
        for split in ("train", "val") if exists(spark, path := posixpath.join(export_dir, "labels", split))
    ]
    parts += [  # packed: a row `frame_id TAB line` for each frame
        spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("frame_id"), F.lit(split).alias("split"))
        for split in ("train", "val") if exists(spark, path := posixpath.join(export_dir, "labels", f"split={split}"))
    ]
    if not parts:
        return spark.createDataFrame([], "frame_id string, trained_split string")
    return trained_splits(reduce(DataFrame.unionByName, parts))


def read_export_lines(spark: SparkSession, export_dir: str) -> DataFrame:
    """frame_id, split and line of an export's label files, a row for each line. Files are taken whole: Spark's line reader sets itself up for each file anew, which is most of its time on one line."""
    files = read_files(spark, posixpath.join(export_dir, "labels"), loose=True, deep=True).withColumn("path", F.concat(F.lit("labels/"), "name"))
    lines = F.split(F.regexp_replace(F.decode("content", "UTF-8"), r"\r?\n\z", ""), r"\r?\n")
    return files.where(F.octet_length("content") > 0).select(F.regexp_extract("path", r"([^/]*)\.txt$", 1).alias("frame_id"), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("split"), F.explode(lines).alias("line"))


def read_trained_frames(spark: SparkSession, weights: str) -> DataFrame:
    """frame_id and trained_split from the dataset_manifest.json two folders above the weights; none: empty."""
    path = posixpath.join(posixpath.dirname(posixpath.dirname(weights)), "dataset_manifest.json")
    if not exists(spark, path):
        return spark.createDataFrame([], "frame_id string, trained_split string")
    return spark.read.schema("frames map<string,string>").option("multiLine", True).json(path).select(F.explode("frames").alias("frame_id", "trained_split"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """id, cx, cy, label of the marker groups of a diagram in SVG."""
    ddl = "_id string, circle struct<_cx:double,_cy:double>, text string"
    return spark.read.format("xml").option("rowTag", "g").schema(ddl).load(path).where(F.startswith("_id", F.lit("kpt-"))).select(
        F.col("_id").alias("id"), F.col("circle._cx").alias("cx"), F.col("circle._cy").alias("cy"), F.col("text").alias("label"),
    )
