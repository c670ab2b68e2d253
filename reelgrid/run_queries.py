"""Registered queries of what runs, streams and files do: each writes what it derives from the tables, reads it again, and SQL states the rows."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid import court, schemas
from reelgrid.functions import keypoints as K
from reelgrid.operators import export as X
from reelgrid.plans import extraction
from reelgrid.plans import game as G
from reelgrid.plans.inference import Model, with_models
from reelgrid.queries import HASH_SQL, query, read
from reelgrid.sources import sinks
from reelgrid.sources.files import work_folder
from reelgrid.sources.readers import read_export_lines, read_labels, read_records
from reelgrid.sources.video import video_frames
from reelgrid.streaming.records import record_stream, write_record_stream

KINDS = ("view", "click", "error", "purchase", "signup")
#: Errors in a row that end a run, and records of a segment, in these queries.
LIMIT, SEGMENT = 3, 5000


def _hist(kind: Column) -> Column:
    """A histogram of its own for each type of event, so that another type is a cut."""
    only = lambda n: F.lit([float(i == n) for i in range(64)])
    out = F.when(kind.isNull(), only(-1))
    for n, k in enumerate(KINDS, 1):
        out = out.when(kind == k, only(n))
    return out.otherwise(only(0))


def frames_of_events(spark: SparkSession, sf_dir: str, run: Column) -> DataFrame:
    """Events as frames in order of their id; one box in each, which stands still; purchases fail."""
    box = F.struct(F.array(*map(F.lit, (10.0, 10.0, 40.0, 80.0))).alias("xyxy"), F.lit(0).alias("cls"), F.lit("Player").alias("name"), F.lit(0.9).alias("conf"), F.lit(None).cast("long").alias("track_id"))
    return read(spark, sf_dir, "events").select(
        run.alias("run_id"), F.col("event_id").alias("frame_index"), (F.col("event_id") / 4).alias("timestamp_s"), _hist(F.col("event_type")).alias("hist"),
        F.array(box).cast(f"array<{schemas.DETECTION}>").alias("players"), F.when(F.col("event_type") == "purchase", "ValueError: purchase").alias("error"),
    )


ORDERED = """o AS (SELECT event_id AS frame_index, {run} AS run_id, event_type, event_type = 'purchase' AS failed, row_number() OVER w AS n, coalesce(lag(event_type) OVER w <> event_type, false) AS cut
  FROM events WINDOW w AS (PARTITION BY {run} ORDER BY event_id)),
s AS (SELECT *, sum(cut::INT) OVER w AS shot_id, n = 1 OR cut AS scene_cut, count(*) FILTER (WHERE NOT failed) OVER w AS island FROM o WINDOW w AS (PARTITION BY run_id ORDER BY frame_index)),
e AS (SELECT *, count(*) FILTER (WHERE failed) OVER (PARTITION BY run_id, island ORDER BY frame_index) AS error_run FROM s),
a AS (SELECT *, min(frame_index) FILTER (WHERE error_run >= {limit}) OVER (PARTITION BY run_id) AS stop FROM e)"""
RECORD_SQL = """shot_id::INT AS shot_id, scene_cut, ((n - 1) // {segment})::INT AS segment_index, coalesce(CASE WHEN failed THEN 'ValueError: purchase' END, '') AS error, CASE WHEN failed THEN '' ELSE '1' END AS tracks"""


@query(f"WITH {ORDERED.format(run=chr(39) + 'one' + chr(39), limit=1000)} SELECT frame_index, {RECORD_SQL.format(segment=SEGMENT)} FROM a")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one run: written part by part as segments, read again from their files."""
    folder = posixpath.join(work_folder(spark, "run"), "one.hs")
    frames = frames_of_events(spark, sf_dir, F.lit("one"))
    G.run_game(frames, folder, G.profile("hs"), G.Config(target_fps=4.0, segment_frames=SEGMENT, max_consecutive_errors=1000), source_fps=4.0, key="k", resume=False)
    records, _ = read_records(spark, folder)
    tracks = F.array_join(F.transform("players", lambda p: p["track_id"].cast("string")), ",")
    return records.select("frame_index", "shot_id", "scene_cut", "segment_index", F.coalesce("error", F.lit("")).alias("error"), tracks.alias("tracks"))


@query(f"""WITH {ORDERED.format(run='user_id::VARCHAR', limit=LIMIT)} SELECT run_id, frame_index, {RECORD_SQL.format(segment=20)}, coalesce(frame_index = stop, false) AS aborted FROM a WHERE stop IS NULL OR frame_index <= stop""")
def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: their frames come in three lots, after each of which the stream ends and is started again."""
    folder = work_folder(spark, "stream")
    frames = frames_of_events(spark, sf_dir, F.col("user_id").cast("string"))
    last = frames.agg(F.max("frame_index")).first()[0]
    config = G.Config(target_fps=4.0, segment_frames=20, max_consecutive_errors=LIMIT)
    for k in range(3):
        lot = frames.where((F.col("frame_index") * 3 >= k * (last + 1)) & (F.col("frame_index") * 3 < (k + 1) * (last + 1)))
        lot.write.mode("append").parquet(f"{folder}/in")
        stream = record_stream(spark.readStream.schema(frames.schema).parquet(f"{folder}/in"), G.profile("hs"), config)
        write_record_stream(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    tracks = F.array_join(F.transform("players", lambda p: p["track_id"].cast("string")), ",")
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select("run_id", "frame_index", "shot_id", "scene_cut", "segment_index", F.coalesce("error", F.lit("")).alias("error"), tracks.alias("tracks"), "aborted")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE event_id * 2 END AS doubled, user_id + CASE WHEN event_type = 'error' THEN 0 ELSE event_id * 2 END AS summed,
  CASE WHEN event_type = 'error' THEN 'KeyError: ''error''' ELSE '' END AS error FROM events""")
def modelled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models over batches of eight, one of which cannot do errors: a batch that fails is done again row by row, the second sees what the first made."""

    def doubling():
        def model(b):
            if "error" in b["event_type"].tolist():
                raise KeyError("error")
            return [x * 2 for x in b["event_id"].tolist()]

        return model

    def summing():
        return lambda b: [int(u) + (0 if d is None or d != d else int(d)) for u, d in zip(b["user_id"].tolist(), b["doubled"].tolist(), strict=True)]

    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    made = with_models(events, [Model("doubled", "long", doubling), Model("summed", "long", summing)], 8)
    return made.select("event_id", F.coalesce("doubled", F.lit(-1)).alias("doubled"), "summed", F.coalesce("error", F.lit("")).alias("error"))


def labels_of_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as labeled frames of clips by language, and as their labels, whose 22 points come from the id."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    point = lambda n: F.struct(((i * 7 + n * 31) % 120).cast("double").alias("x"), ((i * 3 + n * 17) % 90).cast("double").alias("y"), ((i + n) % 3).cast("int").alias("v"), F.lit(0.0).alias("src_conf"))
    points = F.transform(F.sequence(F.lit(0), F.lit(21)), point)
    frames = d.select(i.cast("string").alias("frame_id"), F.coalesce("lang", F.lit("und")).alias("clip_id"), F.lit("labeled").alias("label_status"), F.lit(None).cast("string").alias("image"))
    labels = d.select(
        i.cast("string").alias("frame_id"), F.lit(100).alias("image_w"), F.lit(80).alias("image_h"), F.lit(22).alias("num_keypoints"), K.schema_ref().alias("schema"),
        F.lit(None).cast(schemas.ORIENTATION).alias("orientation"), F.when(i % 2 == 0, "both").otherwise("north").alias("visible_ends"), points.alias("keypoints"), F.lit("2024-01-01").alias("saved_at"),
    )
    return frames, labels


@query(f"""SELECT doc_id::VARCHAR AS frame_id, CASE WHEN doc_id % 2 = 0 THEN 'both' ELSE 'north' END AS visible_ends, '{court.SCHEMA_VERSION}' AS schema_version,
  list_aggregate(list_transform(range(22), lambda n: concat_ws(',', (doc_id * 7 + n * 31) % 120, (doc_id * 3 + n * 17) % 90, (doc_id + n) % 3)), 'string_agg', ';') AS points FROM documents WHERE doc_id % 5 <> 0""")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each label, written by tasks and read again; every fifth, of frames that lost theirs, has been deleted."""
    folder = work_folder(spark, "labels")
    frames, labels = labels_of_documents(spark, sf_dir)
    sinks.write_labels(labels, frames, folder)
    sinks.remove_labels(labels.where("frame_id % 5 = 0"), frames, folder)
    points = F.array_join(F.transform("keypoints", lambda p: F.concat_ws(",", p["x"].cast("long").cast("string"), p["y"].cast("long").cast("string"), p["v"].cast("string"))), ";")
    return read_labels(spark, folder).select("frame_id", "visible_ends", "schema.schema_version", points.alias("points"))


@query(f"""SELECT doc_id::VARCHAR AS frame_id, CASE WHEN {HASH_SQL} < 10 THEN 'val' ELSE 'train' END AS split, '0 0.500000 0.500000 1.000000 1.000000 ' ||
  list_aggregate(list_transform(range(22), lambda n: CASE WHEN (doc_id + n) % 3 = 0 THEN '0.000000 0.000000 0' ELSE printf('%.6f %.6f %d', least(1.0, ((doc_id * 7 + n * 31) % 120) / 100), least(1.0, ((doc_id * 3 + n * 17) % 90) / 80), (doc_id + n) % 3) END), 'string_agg', ' ') AS line FROM documents""")
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set on disk: a file of one line for each labeled frame, in its split's folder."""
    out = work_folder(spark, "export")
    frames, labels = labels_of_documents(spark, sf_dir)
    X.export(frames, labels, out, 0.1)
    return read_export_lines(spark, out)


@query("""WITH f AS (SELECT c_custkey, c_custkey % 4 + 1 AS windows, c_custkey % 3 AS was FROM customer)
SELECT count(*) FILTER (WHERE was <> 0) AS processed, count(*) FILTER (WHERE was = 0) AS skipped, coalesce(sum(windows) FILTER (WHERE was <> 0), 0)::BIGINT AS new_frames FROM f""")
def extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as found videos: a third is in the catalog as it is, a third with another size, a third not at all; each window of 60 frames gives one."""
    c = read(spark, sf_dir, "customer")
    found = c.select(
        F.col("c_name").alias("clip_id"), F.concat("c_name", F.lit(".mp4")).alias("filename"), F.concat(F.lit("/v/"), "c_name").alias("path"), F.lit(30.0).alias("fps"), F.lit(640).alias("width"), F.lit(360).alias("height"),
        ((F.col("c_custkey") % 4 + 1) * 60).alias("frame_count"), F.col("c_custkey").alias("file_size"), F.lit(1.0).alias("file_mtime"), (F.col("c_custkey") % 3).alias("was"),
    )
    known = found.where("was < 2").withColumn("file_size", F.col("file_size") + F.col("was")).withColumn("interval_s", F.lit(2.0))
    empty = spark.createDataFrame([], schemas.CLIPS)
    clips = known.select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])
    return extraction.plan(found.drop("was"), clips, spark.createDataFrame([], schemas.FRAMES), extraction.Request())[3]


@query("""WITH n AS (SELECT max(event_id) + 1 AS n FROM events) SELECT event_id, value, round_even(event_id / 29.97 * 1000, 0)::BIGINT AS ms FROM events, n WHERE event_id % 3 = 0 AND event_id * 4 >= n AND event_id * 2 < n""")
def video_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many native frames as there are events, of which a filter lets the second quarter be read, joined to the events."""
    events = read(spark, sf_dir, "events")
    n = events.agg(F.max("event_id")).first()[0] + 1
    frames = video_frames(spark, path="v", frame_count=n, fps=29.97, stride=3, frames_per_task=max(1000, n // 64)).where((F.col("frame_index") >= -(-n // 4)) & (F.col("frame_index") < -(-n // 2)))
    return frames.join(events, F.col("frame_index") == F.col("event_id")).select("event_id", "value", F.bround(F.col("timestamp_s") * 1000).cast("long").alias("ms"))
