"""Registered queries: every operator over the driver's tables, which stand in for frames, clips and labels, and SQL for the same rows.

Stand-ins: an event is a frame (user = run or clip, time = order), a document is a frame
with labels beside it, an embedding is a histogram of 64 bins or 32 points, a line item is
a detection of its order's frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelgrid import court, schemas
from reelgrid.functions import detections as D
from reelgrid.functions import keypoints as K
from reelgrid.functions import scalars as S
from reelgrid.operators import catalog as C
from reelgrid.operators import export as X
from reelgrid.operators import frames as R
from reelgrid.operators import shots as O
from reelgrid.operators import validation as V
from reelgrid.operators.homography import with_homography
from reelgrid.operators.tracking import track
from reelgrid.plans import game as G
from reelgrid.sources.video import until_decode_failure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Microseconds since 1970 of a time without zone, whatever the session's zone.
MICROS = ("cast(cast(cast(ts - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18, 6)) * 1000000 as bigint)")


#: Blocks of the ordered operators, as one user or label may have a great part of all rows: a week of microseconds, so many vectors.
WEEK, VECTORS = 7 * 86_400_000_000, 65_536


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: triage by type, purchases are labeled."""
    kind = F.col("event_type")
    triage = F.when(kind == "view", F.lit(None)).when(kind == "click", "keep").when(kind == "error", "skip").when(kind == "signup", "other").otherwise("pending")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("clip_id"), F.col("event_id").cast("string").alias("frame_id"), F.expr(MICROS).alias("frame_index"),
        triage.cast("string").alias("triage"), F.when(kind == "purchase", "labeled").otherwise("unlabeled").alias("label_status"), "event_id", "user_id", "event_type", "value",
    )


EVENT_FRAMES = """f AS (SELECT CAST(user_id AS VARCHAR) AS clip_id, CAST(event_id AS VARCHAR) AS frame_id, epoch_us(ts) AS frame_index, event_id, user_id, event_type, value,
  CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'keep' WHEN 'error' THEN 'skip' WHEN 'signup' THEN 'other' ELSE 'pending' END AS triage,
  CASE WHEN event_type = 'purchase' THEN 'labeled' ELSE 'unlabeled' END AS label_status FROM events)"""

TALLY = """count(*) AS candidates, count(*) FILTER (coalesce(triage, 'pending') = 'pending') AS pending, count(*) FILTER (triage = 'keep') AS keep,
  count(*) FILTER (triage = 'skip') AS skip, count(*) FILTER (label_status = 'labeled') AS labeled""".replace("FILTER (", "FILTER (WHERE ")


@query(f"""WITH {EVENT_FRAMES} SELECT clip_id, CASE WHEN grouping(clip_id) = 1 THEN count(DISTINCT clip_id) ELSE 1 END::BIGINT AS clips, {TALLY}
FROM f GROUP BY GROUPING SETS ((clip_id), ())""")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.progress_counts(event_frames(spark, sf_dir))


@query(f"""WITH {EVENT_FRAMES}, c AS (SELECT CAST(c_custkey AS VARCHAR) AS clip_id, c_name FROM customer)
SELECT c.clip_id, c_name, count(frame_id) AS candidates, count(frame_id) FILTER (WHERE coalesce(triage, 'pending') = 'pending') AS pending,
  count(*) FILTER (WHERE triage = 'keep') AS keep, count(*) FILTER (WHERE triage = 'skip') AS skip, count(*) FILTER (WHERE label_status = 'labeled') AS labeled
FROM c LEFT JOIN f USING (clip_id) GROUP BY ALL""")
def clip_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("clip_id"), "c_name")
    return C.clip_listing(clips, event_frames(spark, sf_dir))


@query(f"""WITH {EVENT_FRAMES}, t AS (SELECT {TALLY}, count(DISTINCT clip_id) AS clips FROM f)
SELECT printf('clips: %d | candidates: %d | pending: %d | keep: %d | skip: %d | labeled: %d', clips, candidates, pending, keep, skip, labeled) AS line FROM t""")
def counts_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = C.progress_counts(event_frames(spark, sf_dir)).where("clip_id is null")
    return total.select(S.counts_line(*[F.col(c) for c in ("clips", "candidates", "pending", "keep", "skip", "labeled")]).alias("line"))


@query(f"""WITH {EVENT_FRAMES} SELECT f.frame_id, p.frame_id AS prev_frame_id FROM f
ASOF LEFT JOIN (SELECT * FROM f WHERE label_status = 'labeled') p ON f.clip_id = p.clip_id AND f.frame_index > p.frame_index""")
def prev_labeled_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.previous_labeled(event_frames(spark, sf_dir), WEEK).select("frame_id", "prev_frame_id")


def run_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(spark, sf_dir)
    return f.select(F.col("clip_id").alias("run_id"), "frame_index", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("cut"), (F.col("event_type") == "error").alias("failed"))


RUN_FRAMES = """r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) AS frame_index, event_id, event_type, value, event_type = 'error' AS cut,
  row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events)"""
SHOTS = f"""{RUN_FRAMES}, s AS (SELECT *, sum(CASE WHEN rn > 1 AND cut THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY frame_index)::INT AS shot_id,
  rn = 1 OR cut AS scene_cut, ((rn - 1) // 10)::INT AS segment_index FROM r)"""


@query(f"WITH {SHOTS} SELECT event_id, shot_id, scene_cut FROM s")
def shot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.shots(run_frames(spark, sf_dir), block=WEEK).select("event_id", "shot_id", "scene_cut")


ERROR_RUNS = f"""{RUN_FRAMES}, e AS (SELECT *, count(*) FILTER (WHERE NOT cut) OVER (PARTITION BY run_id ORDER BY frame_index) AS island FROM r),
g AS (SELECT *, count(*) FILTER (WHERE cut) OVER (PARTITION BY run_id, island ORDER BY frame_index) AS error_run FROM e)"""


@query(f"WITH {ERROR_RUNS} SELECT event_id, error_run FROM g")
def error_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.error_runs(run_frames(spark, sf_dir), block=WEEK).select("event_id", "error_run")


@query(f"""WITH {ERROR_RUNS}, h AS (SELECT *, min(frame_index) FILTER (WHERE error_run >= 2) OVER (PARTITION BY run_id) AS stop FROM g)
SELECT event_id, error_run, stop IS NOT NULL AS aborted FROM h WHERE stop IS NULL OR frame_index <= stop""")
def abort_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.until_abort(run_frames(spark, sf_dir), 2, block=WEEK).select("event_id", "error_run", "aborted")


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.segments(run_frames(spark, sf_dir), 10, block=WEEK).withColumn("error", F.when(F.col("failed"), "failed"))


ROLLUP = f"""{SHOTS}, u AS (SELECT run_id, segment_index, min(frame_index) AS start_frame, max(frame_index) AS end_frame, count(*) AS n_records,
  count(*) FILTER (WHERE cut) AS errors, printf('records/seg_%05d.jsonl', segment_index) AS path, 'done' AS status FROM s GROUP BY run_id, segment_index)"""


@query(f"WITH {ROLLUP} SELECT * FROM u")
def segment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.segment_rollup(segmented(spark, sf_dir))


@query(f"""WITH {ROLLUP}, d AS (SELECT * FROM u WHERE n_records = 10), l AS (SELECT run_id, max(segment_index) + 5 AS last_shot_id FROM u GROUP BY run_id),
m AS (SELECT run_id, max(segment_index) AS seg, max_by(end_frame, segment_index) AS ef FROM d GROUP BY run_id)
SELECT run_id, coalesce(ef + 1, 0)::BIGINT AS start_index, coalesce(seg + 1, 0)::INT AS start_segment, CASE WHEN seg IS NULL THEN 0 ELSE last_shot_id + 1 END::INT AS start_shot FROM l LEFT JOIN m USING (run_id)""")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = O.segment_rollup(segmented(spark, sf_dir))
    done = parts.withColumn("status", F.when(F.col("n_records") == 10, "done").otherwise("running"))
    return O.resume_points(done, parts.groupBy("run_id").agg((F.max("segment_index") + 5).alias("last_shot_id")))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS run_id, count(*) AS frames_processed, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O') AS frames_with_homography,
  count(*) FILTER (WHERE l_returnflag = 'R') AS errors, count(DISTINCT l_linenumber) AS shots,
  count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN printf('%d.%d', l_linenumber, l_partkey) END) AS unique_tracks FROM lineitem GROUP BY l_suppkey""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    unit = F.array(F.array(F.lit(1.0)))
    return O.run_summary(item.select(
        F.col("l_suppkey").cast("string").alias("run_id"), F.col("l_linenumber").alias("shot_id"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"),
        F.struct(F.when(F.col("l_linestatus") == "O", unit).alias("homography")).alias("court"), F.array(F.struct(F.col("l_partkey").alias("track_id"))).alias("players"),
    ))


def boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as detections: confidence from the discount, class from the return flag."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 100
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(
            F.array(q, p, q * 2, p + q).alias("xyxy"), F.col("l_linenumber").alias("cls"), F.col("l_returnflag").alias("name"),
            (F.col("l_discount") * 10).alias("conf"), F.col("l_partkey").alias("track_id"),
        ).cast(schemas.DETECTION).alias("d"),
    )


@query("""WITH d AS (SELECT l_orderkey, l_discount * 10 AS conf, l_linenumber AS cls, l_partkey AS track_id, [l_quantity, l_extendedprice / 100, l_quantity * 2, l_extendedprice / 100 + l_quantity] AS xyxy
  FROM lineitem WHERE l_returnflag = 'R' AND l_discount * 10 >= 0.3),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, xyxy, cls, track_id) AS rn FROM d)
SELECT l_orderkey, conf, cls, track_id FROM r WHERE rn = 1""")
def class_filter_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    dets = boxed(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("d")).alias("dets"))
    best = D.best(D.at_least(D.of_classes(F.col("dets"), ("R",)), 0.3), schemas.DETECTION)
    return dets.select("l_orderkey", best.alias("b")).where("b is not null").select("l_orderkey", "b.conf", "b.cls", "b.track_id")


MATRIX = [[0.05, 0.002, -3.0], [0.001, 0.04, 5.0], [0.0, 0.0001, 1.0]]


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity + l_quantity * 2) / 2 AS x, l_extendedprice / 100 + l_quantity AS y FROM lineitem),
w AS (SELECT *, 0.0::DOUBLE * x + 0.0001::DOUBLE * y + 1.0::DOUBLE AS w FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor((0.05::DOUBLE * x + 0.002::DOUBLE * y + -3.0::DOUBLE) / w * 10000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS across4,
  floor((0.001::DOUBLE * x + 0.04::DOUBLE * y + 5.0::DOUBLE) / w * 10000.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS along4 FROM w""")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice") / 100
    h = F.array(*[F.array(*[F.lit(v) for v in row]) for row in MATRIX])
    foot = D.foot_point(F.array(q, p, q * 2, p + q))
    item = read(spark, sf_dir, "lineitem").withColumn("xy", D.projected(h, F.get(foot, 0), F.get(foot, 1)))
    fixed = lambda i: F.floor(F.get("xy", i) * 10000.0 + 0.5)
    return item.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fixed(0).alias("across4"), fixed(1).alias("along4"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("run_id"), F.col("vec_id").alias("frame_index"), F.transform("embedding", lambda x: x.cast("double")).alias("hist"))


@query("""WITH h AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
p AS (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM h),
s AS (SELECT vec_id, a, b, list_sum(a) AS sa, list_sum(b) AS sb, list_dot_product(a, a) AS aa, list_dot_product(b, b) AS bb, list_dot_product(a, b) AS ab FROM p)
SELECT vec_id AS frame_index, coalesce((ab - sa * sb / 64) / sqrt((aa - sa * sa / 64) * (bb - sb * sb / 64)) < 0.5, false) AS cut FROM s""")
def scene_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.scene_cuts(histograms(spark, sf_dir), block=VECTORS).select("frame_index", "cut")


def embedded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 points from 64 numbers; visible where the first is positive."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    point = lambda i: F.struct((F.get(e, i * 2) * 100 + 50).alias("x"), (F.get(e, i * 2 + 1) * 100 + 50).alias("y"), F.when(F.get(e, i * 2) > 0, 2).otherwise(0).alias("v"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), point).alias("pts"))


POINTS_SQL = """e AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(range(0, 32), lambda i: struct_pack(x := e[i * 2 + 1] * 100 + 50, y := e[i * 2 + 2] * 100 + 50, v := CASE WHEN e[i * 2 + 1] > 0 THEN 2 ELSE 0 END)) AS pts FROM e)"""


@query(f"WITH {POINTS_SQL} SELECT vec_id, len(list_filter(pts, lambda q: q.v > 0))::INT AS visible FROM p")
def visible_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded_points(spark, sf_dir).select("vec_id", K.visible_count(F.col("pts")).alias("visible"))


def _six(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(",", F.floor(p["x"] * 1000 + 0.5).cast("string"), F.floor(p["y"] * 1000 + 0.5).cast("string"), p["v"].cast("string"))), ";")


def _six_sql(points: str) -> str:
    return f"list_aggregate(list_transform({points}, lambda q: concat_ws(',', floor(q.x * 1000 + 0.5)::BIGINT, floor(q.y * 1000 + 0.5)::BIGINT, q.v)), 'string_agg', ';')"


_AT = {cid: i for i, cid in enumerate(court.EIGHTEEN_POINT_ORDER)}
_REMAP_SQL = "[" + ", ".join(f"pts[{_AT[c] + 1}]" if c in _AT else "{'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'v': 0}" for c in court.IDS) + "]"


@query(f"WITH {POINTS_SQL} SELECT vec_id, {_six_sql(_REMAP_SQL)} AS points FROM p")
def canonical_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = embedded_points(spark, sf_dir).withColumn("pts", F.slice("pts", 1, 18))
    return pts.select("vec_id", _six(K.canonical_from(F.col("pts"), court.EIGHTEEN_POINT_ORDER)).alias("points"))


_FLIP_SQL = "[" + ", ".join(f"pts[{i + 1}]" for i in court.flip_order()) + "]"


@query(f"WITH {POINTS_SQL} SELECT vec_id, {_six_sql(_FLIP_SQL)} AS points FROM p")
def flip_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded_points(spark, sf_dir).select("vec_id", _six(K.flipped(F.col("pts"))).alias("points"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e FROM embeddings)
SELECT vec_id, list_aggregate(list_transform(range(0, 21), lambda i: CASE WHEN e[i * 3 + 3] >= 0.25 THEN concat_ws(',', floor(e[i * 3 + 1] * 1000 + 0.5)::BIGINT, floor(e[i * 3 + 2] * 1000 + 0.5)::BIGINT, 2) ELSE '0,0,0' END), 'string_agg', ';') AS points FROM e""")
def visibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(F.get(e, i * 3).alias("x"), F.get(e, i * 3 + 1).alias("y"), F.get(e, i * 3 + 2).alias("conf")))
    return read(spark, sf_dir, "embeddings").select("vec_id", _six(K.gated(raw)).alias("points"))


@query(f"""WITH {POINTS_SQL} SELECT vec_id, list_aggregate(list_transform(pts, lambda q: CASE WHEN q.v = 0 THEN '0,0' ELSE concat_ws(',',
  floor(least(1.0, greatest(0.0, q.x / 60)) * 1000000 + 0.5)::BIGINT, floor(least(1.0, greatest(0.0, q.y / 80)) * 1000000 + 0.5)::BIGINT) END), 'string_agg', ';') AS points FROM p""")
def normalize_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    micro = lambda v, n: F.floor(K.clamped(v, F.lit(n)) * 1000000 + 0.5).cast("string")
    text = F.array_join(F.transform("pts", lambda p: F.when(p["v"] == 0, F.lit("0,0")).otherwise(F.concat_ws(",", micro(p["x"], 60.0), micro(p["y"], 80.0)))), ";")
    return embedded_points(spark, sf_dir).select("vec_id", text.alias("points"))


@query(f"""WITH {POINTS_SQL}, q AS (SELECT vec_id, list_filter(pts, lambda q: q.v > 0) AS s FROM p),
b AS (SELECT vec_id, greatest(0.0, list_min(list_transform(s, lambda q: q.x)) / 60 - 0.02) AS x0, least(1.0, list_max(list_transform(s, lambda q: q.x)) / 60 + 0.02) AS x1,
  greatest(0.0, list_min(list_transform(s, lambda q: q.y)) / 80 - 0.02) AS y0, least(1.0, list_max(list_transform(s, lambda q: q.y)) / 80 + 0.02) AS y1 FROM q)
SELECT vec_id, floor((x0 + x1) / 2 * 1000000 + 0.5)::BIGINT AS cx, floor((y0 + y1) / 2 * 1000000 + 0.5)::BIGINT AS cy, floor((x1 - x0) * 1000000 + 0.5)::BIGINT AS w, floor((y1 - y0) * 1000000 + 0.5)::BIGINT AS h FROM b""")
def hull_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = embedded_points(spark, sf_dir).withColumn("h", K.hull(F.col("pts"), F.lit(60.0), F.lit(80.0)))
    micro = lambda c: F.floor(c * 1000000 + 0.5)
    x0, x1, y0, y1 = (F.col(f"h.{c}") for c in ("x_min", "x_max", "y_min", "y_max"))
    return h.select("vec_id", micro((x0 + x1) / 2).alias("cx"), micro((y0 + y1) / 2).alias("cy"), micro(x1 - x0).alias("w"), micro(y1 - y0).alias("h"))


HASH_SQL = "list_reduce(list_transform(range(0, 40), lambda i: (instr('0123456789abcdef', substr(sha1(doc_id::VARCHAR), (i + 1)::INT, 1)) - 1)::BIGINT), lambda a, x: (a * 16 + x) % 100)"


@query(f"SELECT doc_id, CASE WHEN {HASH_SQL} < 10 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", S.split_of(F.col("doc_id").cast("string"), 0.1).alias("split"))


@query(f"SELECT CASE WHEN {HASH_SQL} < 20 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelgrid.operators.export import split_counts as count

    return count(read(spark, sf_dir, "documents").select(S.split_of(F.col("doc_id").cast("string"), 0.2).alias("split")))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def labels_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.lit("labeled").alias("label_status"))
    return C.labels_missing(frames, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("frame_id"))).select(F.col("frame_id").alias("doc_id"))


@query("""SELECT d.doc_id AS frame_id, source AS clip_id, coalesce(lang, 'pending') AS triage, CASE quality WHEN 1 THEN 'val' WHEN 0 THEN 'train' END AS trained_split
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang = 'en'""")
def labels_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("source").alias("clip_id"), F.col("lang").alias("triage"))
    trained = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("frame_id"), F.when(F.col("quality") == 1, "val").when(F.col("quality") == 0, "train").alias("trained_split"))
    return C.frames_of(frames, triage="en", trained=trained)


@query("""WITH k AS (SELECT doc_id AS frame_id, 'old' AS image, CASE toxic WHEN 1 THEN 'skip' WHEN 0 THEN 'keep' END AS triage, CASE quality WHEN 1 THEN 'labeled' WHEN 0 THEN 'unlabeled' END AS label_status FROM labels),
s AS (SELECT doc_id AS frame_id, source AS image FROM documents WHERE lang = 'en')
SELECT coalesce(k.frame_id, s.frame_id) AS frame_id, coalesce(s.image, k.image) AS image, coalesce(k.triage, 'pending') AS triage, coalesce(k.label_status, 'unlabeled') AS label_status FROM k FULL JOIN s USING (frame_id)""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("frame_id"), F.lit("old").alias("image"), F.when(F.col("toxic") == 1, "skip").when(F.col("toxic") == 0, "keep").alias("triage"),
        F.when(F.col("quality") == 1, "labeled").when(F.col("quality") == 0, "unlabeled").alias("label_status"),
    )
    sampled = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("frame_id"), F.col("source").alias("image"), F.lit("pending").alias("triage"), F.lit("unlabeled").alias("label_status"))
    return C.merge_frames(known, sampled)


@query("""WITH f AS (SELECT o_orderkey::VARCHAR AS clip_id, o_custkey AS file_size, o_totalprice AS file_mtime, 2.0::DOUBLE AS interval_s FROM orders),
k AS (SELECT o_orderkey::VARCHAR AS clip_id, o_custkey AS file_size, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS file_mtime FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT f.* FROM f LEFT JOIN k USING (clip_id) WHERE k.clip_id IS NULL OR k.file_mtime IS DISTINCT FROM f.file_mtime""")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    cols = [F.col("o_orderkey").cast("string").alias("clip_id"), F.col("o_custkey").alias("file_size"), F.col("o_totalprice").alias("file_mtime"), F.lit(2.0).alias("interval_s")]
    known = o.where("o_orderpriority <> '1-URGENT'").select(*cols, "o_orderstatus").withColumn("file_mtime", F.when(F.col("o_orderstatus") == "O", F.col("file_mtime")).otherwise(0.0))
    return C.stale_clips(o.select(*cols), known)


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE l_linestatus WHEN 'O' THEN 'north' ELSE 'south' END AS visible_ends,
  [{'id': 'a', 'end': 'north', 'v': CASE WHEN l_quantity > 20 THEN 2 ELSE 0 END}, {'id': 'b', 'end': 'south', 'v': CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END}, {'id': 'c', 'end': 'mid', 'v': 2}] AS pts FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_transform(list_filter(pts, lambda p: p.v > 0 AND p."end" <> 'mid' AND p."end" <> visible_ends), lambda p: p.id), ',') AS against FROM d""")
def end_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda c: F.struct(F.when(c, 2).otherwise(0).alias("v"))
    pts = F.array(v(F.col("l_quantity") > 20), v(F.col("l_discount") > 0.05), v(F.lit(True)))
    ids, ends = F.array(*map(F.lit, "abc")), F.array(F.lit("north"), F.lit("south"), F.lit("mid"))
    seen = F.when(F.col("l_linestatus") == "O", "north").otherwise("south")
    item = read(spark, sf_dir, "lineitem").withColumn("seen", seen)
    return item.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(K.conflicts(pts, ends, ids, F.col("seen")), ",").alias("against"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderstatus WHEN 'O' THEN 'north' WHEN 'F' THEN 'both' ELSE 'east' END AS ends, o_orderpriority AS pr FROM orders),
j AS (SELECT s.*, c_custkey, c_acctbal, c_mktsegment FROM s LEFT JOIN customer ON o_custkey = c_custkey AND pr <> '2-HIGH'),
t AS (SELECT *, CASE WHEN ends = 'east' THEN 'visible_ends' WHEN pr = '5-LOW' THEN 'number of keypoints' WHEN c_custkey IS NULL THEN 'unknown frame' WHEN c_mktsegment = 'BUILDING' THEN 'orientation'
  WHEN o_totalprice > 50000 THEN 'outside' WHEN pr = '4-NOT SPECIFIED' THEN 'not numeric' WHEN pr = '3-MEDIUM' THEN 'v' WHEN ends = 'north' AND pr = '1-URGENT' THEN 'conflict' END AS reason FROM j)
SELECT o_orderkey, CASE reason WHEN 'unknown frame' THEN 404 WHEN 'orientation' THEN 409 WHEN 'conflict' THEN 422 ELSE CASE WHEN reason IS NULL THEN 200 ELSE 400 END END AS code, reason,
  CASE reason WHEN 'not numeric' THEN 2 WHEN 'v' THEN 3 WHEN 'outside' THEN 1 ELSE 0 END AS position FROM t""")
def validation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    pr = F.col("o_orderpriority")
    p = lambda x, v, y=F.lit("1"): F.struct(x.alias("x"), y.alias("y"), v.alias("v"), F.lit("0").alias("src_conf"))
    points = [p(F.col("o_totalprice").cast("string"), F.lit("2")), p(F.when(pr == "4-NOT SPECIFIED", "abc").otherwise("5"), F.lit("1")), p(F.lit("7"), F.when(pr == "3-MEDIUM", "3").otherwise("0"))]
    points += [p(F.lit("3"), F.lit("0"))] * 10 + [p(F.lit("4"), F.when(pr == "1-URGENT", "1.9").otherwise("0"))] + [p(F.lit("3"), F.lit("0"))] * 8
    whole = F.array(*points)
    subs = o.select(
        "o_orderkey", F.when(pr == "2-HIGH", "no such frame").otherwise(F.col("o_custkey").cast("string")).alias("frame_id"), F.when(F.col("o_orderstatus") == "O", "north").when(F.col("o_orderstatus") == "F", "both").otherwise("east").alias("visible_ends"),
        F.when(pr == "5-LOW", F.slice(whole, 1, 21)).otherwise(whole).cast(V.RAW_POINTS).alias("keypoints"),
    )
    locked = F.struct(*[F.lit("3.0.0" if f == "schema_version" else schemas.NORTH_CONVENTION if f == "north_convention" else "x").alias(f) for f in ("schema_version", "north_convention", "anchor_frame_id", "method", "locked_at", "declared_end")])
    clips = c.select(F.col("c_custkey").cast("string").alias("clip_id"), F.lit(50000).alias("width"), F.lit(50).alias("height"), F.when(F.col("c_mktsegment") != "BUILDING", locked).alias("orientation"))
    frames = c.select(F.col("c_custkey").cast("string").alias("frame_id"), F.col("c_custkey").cast("string").alias("clip_id"))
    small = court.keypoint_table(spark)
    return V.validate_submissions(subs, frames, clips, small).select("o_orderkey", "code", "reason", F.coalesce("position", F.lit(0)).alias("position"))


@query(f"""WITH {EVENT_FRAMES} SELECT frame_id, last_value(CASE WHEN event_type IN ('purchase', 'click') THEN event_type END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sticky FROM f""")
def sticky_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(spark, sf_dir)
    ends = F.when(F.col("event_type").isin("purchase", "click"), F.col("event_type"))
    return C.sticky_ends(f.select("frame_id", "clip_id", F.col("frame_index").alias("seq"), ends.alias("visible_ends")), WEEK).select("frame_id", "sticky")


@query("""WITH u AS (SELECT doc_id, 'train' AS s FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'val' FROM labels WHERE toxic = 1)
SELECT doc_id AS frame_id, max(s) AS trained_split FROM u GROUP BY doc_id""")
def split_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read(spark, sf_dir, "labels")
    train = lab.where("quality = 1").select(F.col("doc_id").alias("frame_id"), F.lit("train").alias("split"))
    return C.trained_splits(train.unionByName(lab.where("toxic = 1").select(F.col("doc_id").alias("frame_id"), F.lit("val").alias("split"))))


@query("""WITH u AS (SELECT user_id::VARCHAR AS frame_id, event_id AS seq, event_type AS status FROM events WHERE event_type IN ('view', 'click', 'purchase')),
l AS (SELECT frame_id, CASE max_by(status, seq) WHEN 'view' THEN 'pending' WHEN 'click' THEN 'keep' ELSE 'skip' END AS s FROM u GROUP BY frame_id)
SELECT c_custkey::VARCHAR AS frame_id, coalesce(s, 'pending') AS triage FROM customer LEFT JOIN l ON frame_id = c_custkey::VARCHAR""")
def triage_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "pending").when(kind == "click", "keep").when(kind == "purchase", "skip").otherwise("bad")
    updates = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("frame_id"), status.alias("status"), F.col("event_id").alias("seq"))
    frames = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("frame_id"), F.lit("pending").alias("triage"))
    return C.apply_triage(frames, updates)[0]


@query("""WITH l AS (SELECT user_id::VARCHAR AS clip_id, max_by(event_type = 'purchase', event_id) AS d FROM events GROUP BY ALL)
SELECT c_custkey::VARCHAR AS clip_id, coalesce(d::VARCHAR, 'unset') AS done FROM customer LEFT JOIN l ON clip_id = c_custkey::VARCHAR""")
def done_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("clip_id"), (F.col("event_type") == "purchase").alias("done"), F.col("event_id").alias("seq"))
    after = C.apply_done(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("clip_id"), F.lit(None).cast("boolean").alias("done")), updates)
    return after.select("clip_id", F.coalesce(F.col("done").cast("string"), F.lit("unset")).alias("done"))


def _orientation_case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    clips = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("clip_id"), F.lit(None).cast(schemas.ORIENTATION).alias("orientation"))
    return clips, event_frames(spark, sf_dir).select("frame_id", "clip_id", "label_status")


LOCKS = """r AS (SELECT event_id AS seq, event_id::VARCHAR AS frame_id, user_id::VARCHAR AS clip_id, CASE WHEN event_type NOT IN ('click', 'purchase') OR event_type IS NULL THEN 400 WHEN c_custkey IS NULL THEN 404 ELSE 200 END AS code,
  event_type FROM events LEFT JOIN customer ON user_id = c_custkey), m AS (SELECT *, min(seq) FILTER (WHERE code = 200) OVER (PARTITION BY clip_id) AS first FROM r)"""


def _lock_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("clip_id"), F.col("event_id").cast("string").alias("frame_id"), F.when(kind == "click", "both_ends_visible").when(kind.isin("purchase", "error"), "declared").alias("mode"),
        F.when(kind == "purchase", "south").alias("declared_end"), F.lit("t").alias("locked_at"), F.col("event_id").alias("seq"),
    )


@query(f"""WITH {LOCKS} SELECT c_custkey::VARCHAR AS clip_id, frame_id AS anchor, CASE event_type WHEN 'click' THEN 'anchor_both_ends_image_left' WHEN 'purchase' THEN 'operator_declared_single_end' END AS method,
  CASE WHEN event_type = 'purchase' THEN 'south' END AS declared_end, CASE WHEN seq IS NOT NULL THEN '{court.SCHEMA_VERSION}' END AS schema_version, CASE WHEN seq IS NOT NULL THEN '{schemas.NORTH_CONVENTION}' END AS north_convention,
  CASE WHEN seq IS NOT NULL THEN 't' END AS locked_at FROM customer LEFT JOIN (SELECT * FROM m WHERE code = 200 AND seq = first) w ON clip_id = c_custkey::VARCHAR""")
def orientation_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, frames = _orientation_case(spark, sf_dir)
    o = "orientation."
    return C.lock_orientations(clips, frames, _lock_requests(spark, sf_dir))[0].select(
        "clip_id", F.col(o + "anchor_frame_id").alias("anchor"), o + "method", o + "declared_end", o + "schema_version", o + "north_convention", o + "locked_at",
    )


@query(f"WITH {LOCKS} SELECT seq, frame_id, clip_id, code, code = 200 AND seq > first AS already_locked FROM m")
def orientation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, frames = _orientation_case(spark, sf_dir)
    return C.lock_orientations(clips, frames, _lock_requests(spark, sf_dir))[1].select("seq", "frame_id", "clip_id", "code", "already_locked")


@query("""WITH n AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT c_custkey::VARCHAR AS clip_id, coalesce(n, 0) AS n_labeled, CASE WHEN coalesce(n, 0) > 0 AND c_custkey % 2 = 0 THEN 409 ELSE 200 END AS code FROM customer LEFT JOIN n ON k = c_custkey""")
def orientation_unlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, frames = _orientation_case(spark, sf_dir)
    requests = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("clip_id"), (F.col("c_custkey") % 2 == 1).alias("force"))
    return C.unlock_orientations(clips, frames, requests)[1].select("clip_id", "n_labeled", "code")


#: Nations as points, each paired with the next one: of both kinds of pair and of all rules some are broken.
BROKEN = """p AS (SELECT n_name AS id, n_nationkey AS k, CASE WHEN n_regionkey <= 1 THEN 'north' WHEN n_regionkey = 2 THEN 'mid' ELSE 'south' END AS e, CASE n_nationkey % 3 WHEN 0 THEN 'east' WHEN 1 THEN 'west' ELSE 'center' END AS s,
  n_regionkey * 20.0::DOUBLE AS x, CASE n_nationkey % 3 WHEN 0 THEN 50.0 WHEN 1 THEN 0.0 ELSE 25.0 END::DOUBLE AS y FROM nation),
q AS (SELECT CASE WHEN a.k % 2 = 0 THEN 'east_west' ELSE 'north_south' END AS ps, a.id AS ia, coalesce(b.id, 'nowhere') AS ib FROM p a LEFT JOIN p b ON b.k = a.k + 1)"""


def _broken_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    points = n.select(
        F.col("n_name").alias("id"), k.alias("k"), F.when(F.col("n_regionkey") <= 1, "north").when(F.col("n_regionkey") == 2, "mid").otherwise("south").alias("end"),
        F.when(k % 3 == 0, "east").when(k % 3 == 1, "west").otherwise("center").alias("side"),
        F.array((F.col("n_regionkey") * 20).cast("double"), F.when(k % 3 == 0, 50.0).when(k % 3 == 1, 0.0).otherwise(25.0)).alias("court_xy_ft"),
    )
    after = points.select(F.col("id").alias("next"), (F.col("k") - 1).alias("k"))
    pairs = points.join(after, "k", "left").select(F.when(F.col("k") % 2 == 0, "east_west").otherwise("north_south").alias("pair_set"), F.col("id").alias("id_a"), F.coalesce("next", F.lit("nowhere")).alias("id_b"))
    return points.drop("k"), pairs


@query(f"""WITH {BROKEN}, b AS (SELECT ps || '|' || ia || '|' || ib AS pair, ps = 'east_west' AS ew, a.id IS NOT NULL AND b.id IS NOT NULL AS known, a.e AS ae, b.e AS be, a.s AS sa, b.s AS sb, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS byy
  FROM q LEFT JOIN p a ON ia = a.id LEFT JOIN p b ON ib = b.id),
m AS (SELECT ps, id, count(*) AS n FROM (SELECT ps, ia AS id FROM q UNION ALL SELECT ps, ib FROM q) GROUP BY ALL), t AS (SELECT id, 'east_west' AS ps, s = 'center' AS axis FROM p UNION ALL SELECT id, 'north_south', e = 'mid' FROM p)
SELECT 'unknown id' AS rule, pair AS subject FROM b WHERE NOT known
UNION ALL SELECT 'shares', pair FROM b WHERE known AND CASE WHEN ew THEN ae <> be ELSE sa <> sb END
UNION ALL SELECT 'swaps', pair FROM b WHERE known AND NOT CASE WHEN ew THEN sa <> sb AND sa <> 'center' AND sb <> 'center' ELSE ae <> be AND ae <> 'mid' AND be <> 'mid' END
UNION ALL SELECT 'keeps coordinate', pair FROM b WHERE known AND CASE WHEN ew THEN ax <> bx ELSE ay <> byy END
UNION ALL SELECT 'mirrors', pair FROM b WHERE known AND CASE WHEN ew THEN abs(ay + byy - 50) > 1e-6 ELSE abs(ax + bx - 80) > 1e-6 END
UNION ALL SELECT 'in one pair', ps || '|' || id FROM m WHERE n > 1
UNION ALL SELECT 'paired or on the axis', ps || '|' || id FROM t LEFT JOIN m USING (ps, id) WHERE (n IS NOT NULL) = axis""")
def pair_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.pair_violations(*_broken_points(spark, sf_dir), 80.0, 50.0)


@query(f"""WITH {BROKEN}, t AS (SELECT CASE WHEN n_nationkey % 5 = 4 THEN 'x' || n_name ELSE n_name END AS id, n_regionkey * 25.0::DOUBLE AS al, n_nationkey * 2.5::DOUBLE AS ac FROM nation),
j AS (SELECT t.id AS tid, p.id AS pid, al, ac, e, s FROM t FULL JOIN p ON t.id = p.id),
m AS (SELECT ps || '|' || ia || '|' || ib AS pair, ps = 'east_west' AS ew, a.al AS aal, b.al AS bal, a.ac AS aac, b.ac AS bac FROM q JOIN t a ON ia = a.id JOIN t b ON ib = b.id)
SELECT 'missing id' AS rule, pid AS subject FROM j WHERE tid IS NULL UNION ALL SELECT 'extra id', tid FROM j WHERE pid IS NULL
UNION ALL SELECT 'inside the court', tid FROM j WHERE tid IS NOT NULL AND pid IS NOT NULL AND NOT (al BETWEEN 0 AND 84 AND ac BETWEEN 0 AND 50)
UNION ALL SELECT 'centre axis', tid FROM j WHERE tid IS NOT NULL AND s = 'center' AND abs(ac - 25) > 1e-6 UNION ALL SELECT 'mid axis', tid FROM j WHERE tid IS NOT NULL AND e = 'mid' AND abs(al - 42) > 1e-6
UNION ALL SELECT 'shares', pair FROM m WHERE CASE WHEN ew THEN abs(aal - bal) > 1e-6 ELSE abs(aac - bac) > 1e-6 END
UNION ALL SELECT 'mirrors', pair FROM m WHERE CASE WHEN ew THEN abs(aac + bac - 50) > 1e-6 ELSE abs(aal + bal - 84) > 1e-6 END""")
def template_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, pairs = _broken_points(spark, sf_dir)
    k = F.col("n_nationkey")
    template = read(spark, sf_dir, "nation").select(
        F.when(k % 5 == 4, F.concat(F.lit("x"), "n_name")).otherwise(F.col("n_name")).alias("id"), (F.col("n_regionkey") * 25.0).alias("along"), (k * 2.5).alias("across"), F.lit(84.0).alias("length"), F.lit(50.0).alias("width"),
    )
    return V.template_violations(template, points, pairs)


@query("""WITH m AS (SELECT 'kpt-' || n_nationkey AS id, n_regionkey * 1.0 AS cx, n_nationkey * 1.0 AS cy, ' ' || (n_nationkey - n_nationkey % 2) AS label FROM nation),
w AS (SELECT n_nationkey + 2 AS i, n_regionkey * 1.0 AS dx, (n_nationkey + 2) * 1.0 AS dy FROM nation), j AS (SELECT m.*, w.*, 'kpt-' || i AS wid FROM m FULL JOIN w ON id = 'kpt-' || i)
SELECT 'marker groups' AS rule, coalesce(id, wid) AS subject FROM j WHERE id IS NULL OR wid IS NULL UNION ALL SELECT 'marker place', id FROM j WHERE id IS NOT NULL AND wid IS NOT NULL AND (abs(cx - dx) > 1e-6 OR abs(cy - dy) > 1e-6)
UNION ALL SELECT 'marker label', id FROM j WHERE id IS NOT NULL AND wid IS NOT NULL AND trim(label) <> i::VARCHAR""")
def marker_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the markers of a diagram, held against points two numbers on."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    markers = n.select(F.concat(F.lit("kpt-"), k.cast("string")).alias("id"), F.col("n_regionkey").cast("double").alias("cx"), k.cast("double").alias("cy"), F.concat(F.lit(" "), (k - k % 2).cast("string")).alias("label"))
    points = n.select((k + 2).alias("index"), F.array(F.col("n_regionkey").cast("double"), (k + 2).cast("double")).alias("diagram_xy"))
    return V.marker_violations(markers, points)


@query(f"""WITH h AS (SELECT CASE WHEN n_regionkey = 0 THEN '{court.SCHEMA_NAME}' ELSE n_name END AS n, CASE WHEN n_nationkey % 2 = 0 THEN '3.1.0' ELSE '2.0.0' END AS v, n_nationkey % 3 = 0 AS vis, n_nationkey % 4 = 0 AS ends, CASE n_nationkey % 3 WHEN 0 THEN 'east_west' WHEN 1 THEN 'north_south' ELSE 'up' END AS f FROM nation)
SELECT 'schema_name' AS rule, n AS subject FROM h WHERE n <> '{court.SCHEMA_NAME}' UNION ALL SELECT 'schema_version', n FROM h WHERE v NOT LIKE '3.%' UNION ALL SELECT 'visibility_values', n FROM h WHERE NOT vis
UNION ALL SELECT 'visible_ends_values', n FROM h WHERE NOT ends UNION ALL SELECT 'flip_uses', n FROM h WHERE f = 'up'""")
def header_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    values = lambda good, *all_of: F.when(good, F.array(*map(F.lit, all_of))).otherwise(F.array(F.lit(all_of[0])))
    return V.header_violations(read(spark, sf_dir, "nation").select(
        F.when(F.col("n_regionkey") == 0, court.SCHEMA_NAME).otherwise(F.col("n_name")).alias("schema_name"), F.when(k % 2 == 0, "3.1.0").otherwise("2.0.0").alias("schema_version"),
        values(k % 3 == 0, "2", "0", "1").alias("visibility_values"), values(k % 4 == 0, *V.VISIBLE_ENDS).alias("visible_ends_values"), F.when(k % 3 == 0, "east_west").when(k % 3 == 1, "north_south").otherwise("up").alias("flip_uses"),
    ))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, floor(abs(x::DOUBLE) * 400))::INT) AS px FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(64), lambda b: (len(list_filter(px, lambda v: v // 4 = b)) * 4096 // len(px))::BIGINT), ',') AS hist FROM p""")
def grey_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.least(F.lit(255), F.floor(F.abs(x.cast("double")) * 400)).cast("int"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(O.grey_histogram(pixels), lambda h: F.floor(h * 4096).cast("string")), ",").alias("hist"))


@query("""SELECT id, CASE WHEN c IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT doc_id AS id, 1 AS d FROM documents) FULL JOIN (SELECT c_custkey AS id, 1 AS c FROM customer) USING (id) WHERE d IS NULL OR c IS NULL""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9_-]+', '_', 'g') AS clip_id,
  printf('%s_f%06d', 'clip', page_id) AS frame_id FROM pages""")
def id_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.clip_id(F.col("url")).alias("clip_id"), S.frame_id(F.lit("clip"), F.col("page_id")).alias("frame_id"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice > 1000 THEN p_retailprice / 40 ELSE 30 END AS fps, greatest(1, round_even(CASE WHEN p_retailprice > 1000 THEN p_retailprice / 40 ELSE 30 END * 2.5, 0))::BIGINT AS step,
  CASE WHEN p_size > 1 THEN greatest(1, round_even(p_retailprice / p_size, 0))::BIGINT ELSE 1 END AS stride, coalesce(CASE WHEN p_size < 10 THEN p_size END, greatest(1, round_even(p_size * 0.5, 0)))::BIGINT AS frame_limit,
  greatest(1, round_even(p_size * 320 / 640.0, 0))::INT AS thumb FROM part""")
def sampling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    fps = S.valid_fps(F.when(F.col("p_retailprice") > 1000, F.col("p_retailprice") / 40).when(F.col("p_size") > 25, F.lit(float("nan"))))
    return part.select(
        "p_partkey", fps.alias("fps"), S.sample_step(fps, F.lit(2.5)).alias("step"), S.stride(F.col("p_retailprice"), F.when(F.col("p_size") > 1, F.col("p_size")).otherwise(0)).alias("stride"),
        S.frame_limit(F.col("p_size") * 0.5, F.lit(1.0), F.when(F.col("p_size") < 10, F.col("p_size")).cast("long")).alias("frame_limit"), S.thumb_height(F.lit(640.0), F.col("p_size"), F.lit(320)).alias("thumb"),
    )


@query("SELECT event_id AS frame_index FROM events WHERE event_id >= 100 AND event_id % 7 = 0 ORDER BY 1 LIMIT 500")
def strided_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_frames(read(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index")), 7, 500, 100)


@query("""WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN '3.0.0' WHEN toxic = 1 THEN '2.1.0' END AS v FROM labels),
f AS (SELECT doc_id, l.v IS NOT NULL AND l.v LIKE '3.%' AS has FROM documents LEFT JOIN l USING (doc_id)),
c AS (SELECT count(*) FILTER (WHERE NOT coalesce(v LIKE '3.%', false)) AS removed FROM l), r AS (SELECT count(*) FILTER (WHERE NOT has) AS reset FROM f)
SELECT removed, reset, 0::BIGINT AS unlocked, removed + reset > 0 AS changed FROM c, r""")
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("quality") == 1, "3.0.0").when(F.col("toxic") == 1, "2.1.0")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("frame_id"), F.struct(version.alias("schema_version")).alias("schema"))
    frames = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.lit("labeled").alias("label_status"))
    clips = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("clip_id"), F.lit(None).cast(schemas.ORIENTATION).alias("orientation"))
    return C.migrate(clips, frames, labels)[3]


@query("""WITH t AS (SELECT l_orderkey, l_linenumber AS cls, l_returnflag AS name, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount FROM lineitem),
s AS (SELECT l_orderkey, cls, max_by(name, (l_quantity, l_extendedprice, name)) AS carried FROM t GROUP BY ALL)
SELECT l_orderkey, cls, carried, count(*) AS n FROM t JOIN s USING (l_orderkey, cls) GROUP BY ALL""")
def carried_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = read(spark, sf_dir, "lineitem")
    d = F.struct(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("cls"))
    seen = item.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(d)).alias("seen"))
    named = seen.select("l_orderkey", F.explode(D.carried_names(F.transform("seen", lambda x: x.withField("name", F.lit("?"))), F.col("seen"))).alias("t"))
    return named.groupBy("l_orderkey", F.col("t.cls").alias("cls"), F.col("t.name").alias("carried")).agg(F.count(F.lit(1)).alias("n"))


def clips_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_name").alias("clip_id"), F.lit(30.0).alias("fps"), F.lit(2.0).alias("interval_s"), (F.col("c_custkey") * 7 + 50).alias("frame_count"))


@query()
def window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_frames(clips_of_customers(spark, sf_dir))


@query("""WITH c AS (SELECT c_name AS clip_id, c_custkey * 7 + 50 AS frames FROM customer)
SELECT clip_id, unnest(range(0, frames // 60)) AS w, 1::BIGINT AS n FROM c""")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames sampled in each window that is whole: one."""
    return R.window_counts(clips_of_customers(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN event_id % 23 < 22 THEN 21 ELSE 22 END AS used, array_to_string(list_transform([1 / a, 0, -b / a, 0, 1 / a, -30 / a, 0, 0, 1], lambda x: floor(x * 1000 + 0.50037)::BIGINT), ',') AS h1000
FROM (SELECT event_id, value % 7 + 6 AS a, event_id % 50 AS b FROM events)""")
def homography_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a frame in which a camera of its own sees the NBA court; in every seventh, two points of 21 or 22 are far off and must not count."""
    feet = court.template("nba_94x50")
    a, b = F.col("value") % 7 + 6, F.col("event_id") % 50
    off = lambda n: F.when((F.col("event_id") % 7 == 3) & ((F.col("event_id") + n) % 11 == 0), 700.0).otherwise(0.0)
    points = F.array(*[K.point(a * feet[i][1] + b + off(n), a * feet[i][0] + 30 - off(n), F.when(F.col("event_id") % 23 == n, 0).otherwise(2)) for n, i in enumerate(court.IDS)])
    frames = read(spark, sf_dir, "events").select("event_id", points.alias("keypoints"))
    return with_homography(frames, "nba_94x50").select("event_id", F.size("solved.used_keypoint_ids").alias("used"), F.array_join(F.transform(F.flatten("solved.homography"), lambda x: F.floor(x * 1000 + 0.50037).cast("string")), ",").alias("h1000"))


@query(f"""WITH {SHOTS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, shot_id ORDER BY frame_index) AS n FROM s),
-- Fixed values: the track each box belongs to, by its place in a frame; the faint box has none.
b(det_no, track_id) AS (VALUES (0, 1::BIGINT), (1, 2::BIGINT), (3, 3::BIGINT))
SELECT run_id, shot_id, frame_index, det_no, track_id FROM n, b WHERE CASE det_no WHEN 1 THEN n NOT IN (4, 5, 14) WHEN 3 THEN n >= 3 ELSE true END""")
def track_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a run, errors cut shots. Two boxes cross each other, one of them with low confidence at times, the other lost at times; a third is too faint, a fourth comes later."""
    f = O.shots(run_frames(spark, sf_dir), block=WEEK)
    n = F.row_number().over(Window.partitionBy("run_id", "shot_id").orderBy("frame_index"))
    box = lambda x, y, conf: F.struct(x.alias("x"), F.lit(y).alias("y"), conf.alias("conf"))
    k = F.col("n")
    boxes = F.array(
        box(10.0 + 4 * k, 10.0, F.when(k % 4 == 3, 0.15).otherwise(0.9)), F.when(~k.isin(4, 5, 14), box(90.0 - 4 * k, 34.0, F.lit(0.8))),
        box(300.0 + 0 * k, 10.0, F.lit(0.05)), F.when(k >= 3, box(500.0 + k, 200.0, F.lit(0.6))),
    )
    rows = f.select("run_id", "shot_id", "frame_index", n.alias("n")).select("run_id", "shot_id", "frame_index", F.posexplode(boxes).alias("det_no", "b")).where("b is not null")
    x, y = F.col("b.x"), F.col("b.y")
    return track(rows.select("run_id", "shot_id", "frame_index", "det_no", x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 50).alias("y2"), "b.conf"), 5.0)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(sqrt(l_extendedprice) * 10, 0)::BIGINT AS box10, round_even(sqrt(l_extendedprice) * 100, 0)::BIGINT AS feet100,
  round_even(l_discount / 7 * 10000, 0)::BIGINT AS conf10000, round_even(l_partkey / 29.97 * 1000, 0)::BIGINT AS ms FROM lineitem""")
def record_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits of the record's numbers: boxes 1, feet 2, confidences 4, seconds 3. None of these numbers lies half-way, which SQL cannot tell exactly; tests have such ones."""
    item, p = read(spark, sf_dir, "lineitem"), F.sqrt("l_extendedprice")
    whole = lambda x, k: F.bround(x * k).cast("long")
    r = item.withColumns({"box": S.round_all_like_python(F.array(p), 1), "feet": S.round_all_like_python(F.array(p), 2), "conf": S.round_like_python(F.col("l_discount") / 7, 4), "s": S.timestamp_s(F.col("l_partkey"), F.lit(29.97))})
    return r.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", whole(F.get("box", 0), 10).alias("box10"), whole(F.get("feet", 0), 100).alias("feet100"), whole(F.col("conf"), 10000).alias("conf10000"), whole(F.col("s"), 1000).alias("ms"),
    )


CLEAN_SQL = "list_transform(pts, lambda q: {'x': CASE WHEN q.v = 0 THEN 0.0 ELSE q.x END, 'y': CASE WHEN q.v = 0 THEN 0.0 ELSE q.y END, 'v': q.v})"


@query(f"WITH {POINTS_SQL} SELECT vec_id, {_six_sql(CLEAN_SQL)} AS points FROM p")
def cleaned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = embedded_points(spark, sf_dir).withColumn("pts", F.transform("pts", lambda p: p.withField("src_conf", F.lit(0.5))))
    return pts.select("vec_id", _six(K.cleaned(F.col("pts"))).alias("points"))


_IDS_SQL = "[" + ", ".join(f"'{i}'" for i in court.IDS) + "]"


@query(f"""WITH {POINTS_SQL}, z AS (SELECT vec_id, list_zip({_IDS_SQL}, pts[1:least(32, vec_id % 40)], true) AS z FROM p)
SELECT vec_id, coalesce(list_aggregate(list_transform(z, lambda t: t[1] || ' ' || t[2].v::VARCHAR), 'string_agg', ','), '') AS named FROM z""")
def point_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions beside points by position: frames have 0 to 32 points, the schema 22."""
    z = K.defined(F.array(*map(F.lit, court.IDS)), F.slice("pts", 1, (F.col("vec_id") % 40).cast("int")))
    return embedded_points(spark, sf_dir).select("vec_id", F.array_join(F.transform(z, lambda t: F.concat_ws(" ", t["id"], t["p"]["v"].cast("string"))), ",").alias("named"))


@query("""WITH r AS (SELECT l_orderkey, l_discount, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_extendedprice, l_quantity) AS rn FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT * FROM r WHERE rn = 1)
SELECT DISTINCT o.l_orderkey, CASE WHEN b.l_quantity >= 25 THEN b.l_extendedprice ELSE 0 END AS x, CASE WHEN b.l_quantity >= 25 THEN 2 ELSE 0 END AS v, CASE WHEN b.l_orderkey IS NULL THEN 22 ELSE 1 END AS n
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN b USING (l_orderkey)""")
def instance_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as instances of one point each; quantity is the point's confidence in hundredths, discount the instance's."""
    point = F.struct(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_quantity") / 100).alias("conf"))
    one = F.struct(F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("e"), F.col("l_quantity").alias("q"), F.struct(F.col("l_discount").alias("conf"), F.array(point).alias("points")).alias("i"))
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "R", one))).alias("s"))
    picked = sets.select("l_orderkey", K.of_best_instance(F.transform("s", lambda s: s["i"])).alias("p"))
    return picked.select("l_orderkey", F.get("p", 0)["x"].alias("x"), F.get("p", 0)["v"].alias("v"), F.size("p").alias("n"))


@query(f"""WITH {POINTS_SQL}, d AS (SELECT vec_id, list_filter(range(0, 32), lambda i: (pts[i + 1].x - 50) * (pts[i + 1].x - 50) + (pts[i + 1].y - 50) * (pts[i + 1].y - 50) <= 144) AS near, pts FROM p)
SELECT vec_id, near[-1]::INT AS hit, CASE pts[1].v WHEN 2 THEN 1 ELSE 2 END AS other, least(20, greatest(0.05, pow(1.15, vec_id % 50 - 25)))::FLOAT AS zoom, floor(((pts[1].x * 2 + 7) - 7) / 2 * 1000 + 0.5)::BIGINT AS there_and_back FROM d""")
def point_editing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.get("pts", 0)["x"]
    return embedded_points(spark, sf_dir).select(
        "vec_id", K.topmost_within(F.col("pts"), F.lit(50.0), F.lit(50.0)).alias("hit"), K.toggled(F.get("pts", 0)["v"]).alias("other"), K.zoomed(F.lit(1.0), F.col("vec_id") % 50 - 25).cast("float").alias("zoom"),
        F.floor(K.to_image(K.to_screen(x, F.lit(7.0), F.lit(2.0)), F.lit(7.0), F.lit(2.0)) * 1000 + 0.5).alias("there_and_back"),
    )


@query(f"""WITH {EVENT_FRAMES} SELECT frame_id, CASE coalesce(triage, 'pending') WHEN 'pending' THEN 'keep' WHEN 'keep' THEN 'skip' WHEN 'skip' THEN 'pending' END AS next,
  printf('%s.nba', clip_id) AS run_dir, printf('seg_%05d.jsonl', event_id) AS shard FROM f""")
def names_and_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_frames(spark, sf_dir).select(
        "frame_id", K.next_triage(F.col("triage")).alias("next"), S.run_dir(F.col("clip_id"), F.lit("nba")).alias("run_dir"), S.shard_name(F.col("event_id")).alias("shard"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN 'Player' WHEN 2 THEN 'Ball' ELSE l_linenumber::VARCHAR END AS name FROM lineitem""")
def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(F.lit(1), F.lit("Player"), F.lit(2), F.lit("Ball"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", D.named(F.col("l_linenumber"), names).alias("name"))


def _mixed_orientation(k: Column) -> Column:
    """By number: none, of an old schema, of another convention, two good ones."""
    return F.when(k % 5 != 0, F.struct(
        F.when(k % 5 == 1, "2.1.0").otherwise("3.0.0").alias("schema_version"), F.when(k % 5 == 2, "other").otherwise(schemas.NORTH_CONVENTION).alias("north_convention"), F.concat(F.lit("f"), k.cast("string")).alias("anchor_frame_id"),
        F.lit("m").alias("method"), F.lit("t").alias("locked_at"), F.when(k % 5 == 3, "").otherwise("south").alias("declared_end"),
    ).cast(schemas.ORIENTATION))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 >= 3 THEN 'f' || c_custkey END AS anchor, CASE WHEN c_custkey % 5 = 4 THEN 'south' END AS declared_end, c_custkey % 5 >= 3 AS shown FROM customer")
def orientation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    o = C.shown_orientation(C.valid_orientation(_mixed_orientation(k)))
    return read(spark, sf_dir, "customer").select(k, o["anchor_frame_id"].alias("anchor"), o["declared_end"].alias("declared_end"), o.isNotNull().alias("shown"))


def _saved_labels(f: DataFrame) -> DataFrame:
    """Purchases and every seventh event have a label of two points, of which some are of another schema or one point short of 22."""
    e = F.col("event_id")
    one = lambda v: F.struct(v.cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2).alias("v"), F.lit(0.5).alias("src_conf"))
    points = F.concat(F.array(one(e)), F.array_repeat(one(F.lit(1.0)), F.when(e % 11 == 0, 20).otherwise(21))).cast(schemas.POINTS)
    ref = F.struct(F.lit(court.SCHEMA_NAME).alias("schema_name"), F.when(e % 13 == 0, "2.1.0").otherwise(court.SCHEMA_VERSION).alias("schema_version"))
    return f.where((F.col("event_type") == "purchase") | (e % 7 == 0)).select("frame_id", points.alias("keypoints"), ref.alias("schema"))


@query(f"""WITH {EVENT_FRAMES}, l AS (SELECT frame_id, frame_index, clip_id, event_id, event_type = 'purchase' AS labeled FROM f WHERE event_type = 'purchase' OR event_id % 7 = 0),
j AS (SELECT f.*, c_custkey, s.frame_id IS NOT NULL AS saved, p.event_id AS prev FROM f JOIN customer ON c_custkey = user_id LEFT JOIN l s ON s.frame_id = f.frame_id
  ASOF LEFT JOIN (SELECT * FROM l WHERE labeled) p ON f.clip_id = p.clip_id AND f.frame_index > p.frame_index)
SELECT frame_id, CASE WHEN ok THEN 200 ELSE 409 END AS code, CASE WHEN ok THEN CASE WHEN saved THEN 'saved' WHEN prev IS NOT NULL THEN 'previous_frame' ELSE 'empty' END END AS source, CASE WHEN ok THEN c_custkey ELSE 0 END::INT AS image_w,
  CASE WHEN ok THEN CASE WHEN saved THEN event_id WHEN prev IS NOT NULL THEN prev ELSE 0 END END::DOUBLE AS x, CASE WHEN ok THEN CASE WHEN saved THEN 0.5 ELSE 0 END END::DOUBLE AS src_conf,
  CASE WHEN ok THEN CASE WHEN coalesce(CASE WHEN saved THEN event_id END, prev, 1) % 11 = 0 THEN 21 ELSE 22 END ELSE 0 END AS n FROM (SELECT *, c_custkey % 5 >= 3 AS ok FROM j)""")
def prefill_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's labeling begins with; frames of unknown clips have none."""
    f, k = event_frames(spark, sf_dir), F.col("c_custkey")
    clips = read(spark, sf_dir, "customer").select(k.cast("string").alias("clip_id"), k.cast("int").alias("width"), k.cast("int").alias("height"), _mixed_orientation(k).alias("orientation"))
    out = C.prefilled(f.select("frame_id", "clip_id", "frame_index", "label_status"), clips, _saved_labels(f), block=WEEK)
    ready = F.col("code") == 200
    return out.select("frame_id", "code", "source", F.when(ready, F.col("image_w")).otherwise(0).alias("image_w"), F.get("keypoints", 0)["x"].alias("x"), F.get("keypoints", 0)["src_conf"].alias("src_conf"), F.coalesce("num_keypoints", F.lit(0)).alias("n"))


@query("""SELECT event_id::VARCHAR AS frame_id, CASE WHEN event_id % 11 = 0 THEN 21 ELSE 22 END AS n FROM events WHERE event_type = 'purchase' AND (event_id % 11 = 0 OR event_id % 13 = 0)""")
def refused_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = event_frames(spark, sf_dir)
    return X.refused_labels(f, _saved_labels(f))


@query(f"""WITH {EVENT_FRAMES} SELECT clip_id, count(*) FILTER (WHERE triage = 'keep') AS kept, count(*) FILTER (WHERE label_status = 'labeled') AS labeled, count(*) FILTER (WHERE doc_id IS NOT NULL) AS trained
FROM f LEFT JOIN labels ON doc_id = event_id GROUP BY clip_id""")
def trained_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trained_progress(event_frames(spark, sf_dir), read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("frame_id")))


@query("SELECT o_custkey AS run_id, count(*) AS frames_processed, count(*) FILTER (WHERE o_orderstatus = 'O') AS with_homography FROM orders GROUP BY o_custkey")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.report_summary(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (F.col("o_orderstatus") == "O").alias("homography")))


#: Events as frames of videos of 4000 frames; the bad ones cannot be decoded.
CLIPPED = "v AS (SELECT (event_id // 4000)::VARCHAR AS path, event_id % 4000 AS frame_index, value > 320 AS bad FROM events)"


@query(f"WITH {CLIPPED}, s AS (SELECT path, min(frame_index) FILTER (WHERE bad) AS stop FROM v GROUP BY path) SELECT path, frame_index FROM v JOIN s USING (path) WHERE stop IS NULL OR frame_index < stop")
def decode_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as tasks of 500 native frames decode them, each up to its own first failure; what lies behind a video's first failure goes."""
    e = read(spark, sf_dir, "events")
    f = e.select(F.floor(F.col("event_id") / 4000).cast("string").alias("path"), (F.col("event_id") % 4000).alias("frame_index"), (F.col("value") > 320).alias("bad"))
    task = F.floor(F.col("frame_index") / 500)
    fails = f.where("bad").groupBy(F.col("path").alias("_path"), task.alias("_task")).agg(F.min("frame_index").alias("_fails"))
    decoded = f.join(fails, (F.col("path") == F.col("_path")) & (task == F.col("_task")), "left").where(F.col("_fails").isNull() | (F.col("frame_index") < F.col("_fails")))
    return until_decode_failure(decoded.select("path", "frame_index"), frames_per_task=500)


@query("""WITH b AS (SELECT page_id, hex(encode(url)) AS x, octet_length(encode(url)) // 3 AS n FROM pages),
g AS (SELECT page_id, n, list_transform(range(n), lambda i: (3735 * ('0x' || substr(x, (6 * i + 1)::INT, 2))::BIGINT + 19235 * ('0x' || substr(x, (6 * i + 3)::INT, 2))::BIGINT + 9798 * ('0x' || substr(x, (6 * i + 5)::INT, 2))::BIGINT + 16384) // 32768) AS grey FROM b)
SELECT page_id, array_to_string(list_transform(range(64), lambda k: (len(list_filter(grey, lambda v: v // 4 = k)) * 4096 // n)::BIGINT), ',') AS hist FROM g""")
def colour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of urls as pixels of blue, green and red."""
    shares = O.colour_histogram(F.encode("url", "utf-8"))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(shares, lambda h: F.floor(h * 4096).cast("string")), ",").alias("hist"))


@query(f"""WITH f AS (SELECT doc_id::VARCHAR AS frame_id, CASE WHEN {HASH_SQL} < 10 THEN 'val' ELSE 'train' END AS split FROM documents)
SELECT '2024-01-01' AS trained_at, 'set/data.yaml' AS data, 'pose.pt' AS model_init, count(*) AS n, md5(string_agg(frame_id || ':' || split, ',' ORDER BY frame_id)) AS frames FROM f""")
def training_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as exported frames; the map of frames to splits is digested."""
    lines = hash_split(spark, sf_dir).select(F.col("doc_id").cast("string").alias("frame_id"), "split")
    made = X.training_manifest(lines, "2024-01-01", "set/data.yaml", "pose.pt")
    entries = F.array_join(F.transform(F.map_entries("frames"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return made.select("trained_at", "data", "model_init", F.size("frames").cast("long").alias("n"), F.md5(entries.cast("binary")).alias("frames"))


@query(f"""SELECT p_partkey, ([{", ".join(f"'{i}'" for i in court.IDS)}])[p_partkey % 25 + 1] AS id, CASE WHEN p_partkey % 25 < 22 THEN p_partkey % 25 ELSE -1 END::INT AS index, '{court.SCHEMA_NAME}' AS schema_name, '{court.SCHEMA_VERSION}' AS schema_version,
  {court.DIAGRAM_ORIGIN[0]} + {court.DIAGRAM_SCALE} * (p_size * 1.0::DOUBLE) AS diagram_x, {court.DIAGRAM_ORIGIN[1]} + {court.DIAGRAM_SCALE} * (p_retailprice / 20) AS diagram_y FROM part""")
def keypoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of indices and back (three of 25 are beyond), the schema they are of, places in feet on the diagram."""
    cid = K.id_of((F.col("p_partkey") % 25).cast("int"))
    at = K.diagram_xy(F.col("p_retailprice") / 20, F.col("p_size").cast("double"))
    part = read(spark, sf_dir, "part").select("p_partkey", cid.alias("id"), K.schema_ref().alias("schema"), at.alias("at"))
    return part.select("p_partkey", "id", F.coalesce(K.index_of(F.col("id")), F.lit(-1)).alias("index"), "schema.schema_name", "schema.schema_version", F.get("at", 0).alias("diagram_x"), F.get("at", 1).alias("diagram_y"))


@query(f"WITH {POINTS_SQL} SELECT vec_id, len(list_filter({CLEAN_SQL}, lambda q: q.x = 0 AND q.y = 0 AND q.v = 0))::INT AS unplaced FROM p")
def unplaced_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = embedded_points(spark, sf_dir).withColumn("pts", F.transform("pts", lambda p: p.withField("src_conf", F.lit(0.5))))
    return pts.select("vec_id", F.size(F.filter(K.cleaned(F.col("pts")), K.unplaced)).alias("unplaced"))


@query("SELECT event_id AS frame_index, (event_id % 5)::INT AS points FROM events WHERE event_id % 5 > 0 AND event_type = 'purchase' ORDER BY event_id LIMIT 1")
def inspect_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame with native keypoints: purchases have up to four."""
    points = F.when(F.col("event_type") == "purchase", F.array_repeat(F.lit(1.0), (F.col("event_id") % 5).cast("int")))
    found = G.inspect_first(read(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index"), points.alias("keypoints")))
    return found.select("frame_index", F.size("keypoints").alias("points"))


@query(f"""WITH p AS (SELECT n_nationkey % 24 + 1 AS i, CASE WHEN n_nationkey % 8 = 0 THEN 'north_' || lower(n_name) WHEN n_nationkey % 8 = 1 THEN lower(n_name) || '_east' ELSE 'south_x_west' END AS id, n_nationkey AS k,
  CASE n_regionkey WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'mid' WHEN 3 THEN 'top' ELSE 'south' END AS e, CASE n_nationkey % 4 WHEN 0 THEN 'center' WHEN 1 THEN 'east' WHEN 2 THEN 'west' ELSE 'left' END AS s,
  CASE WHEN n_nationkey % 6 = 0 THEN '  ' ELSE n_name END AS f, n_nationkey * 4.2::DOUBLE AS al, n_nationkey * 2.5::DOUBLE AS ac FROM nation),
d AS (SELECT *, {court.DIAGRAM_ORIGIN[0]} + {court.DIAGRAM_SCALE} * ac + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS dx, {court.DIAGRAM_ORIGIN[1]} + {court.DIAGRAM_SCALE} * al AS dy FROM p)
SELECT 'contiguous index' AS rule, 'index' AS subject FROM d HAVING min(i) <> 1 OR max(i) <> count(*) OR count(DISTINCT i) <> count(*)
UNION ALL SELECT 'unique id', id FROM d GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'end', id FROM d WHERE e NOT IN ('north', 'south', 'mid') UNION ALL SELECT 'side', id FROM d WHERE s NOT IN ('east', 'west', 'center')
UNION ALL SELECT 'feature', id FROM d WHERE trim(f) = '' UNION ALL SELECT 'id starts with end', id FROM d WHERE e IN ('north', 'south') AND NOT starts_with(id, e || '_')
UNION ALL SELECT 'id ends with side', id FROM d WHERE s IN ('east', 'west') AND NOT ends_with(id, '_' || s) UNION ALL SELECT 'inside the court', id FROM d WHERE NOT (al BETWEEN 0 AND 84 AND ac BETWEEN 0 AND 50)
UNION ALL SELECT 'centre axis', id FROM d WHERE s = 'center' AND ac <> 25 UNION ALL SELECT 'mid axis', id FROM d WHERE e = 'mid' AND al <> 42 UNION ALL SELECT 'diagram', id FROM d WHERE k % 7 = 0
UNION ALL SELECT 'view box', id FROM d WHERE NOT (dx BETWEEN {court.VIEW_BOX[0]} AND {court.VIEW_BOX[2]} AND dy BETWEEN {court.VIEW_BOX[1]} AND {court.VIEW_BOX[3]})""")
def keypoint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the rows of a keypoint schema, of which each rule is broken by some."""
    n, k, r = read(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_regionkey")
    along, across = k * F.lit(4.2), k * F.lit(2.5)
    at = K.diagram_xy(along, across)
    points = n.select(
        (k % 24 + 1).alias("index"), F.when(k % 8 == 0, F.concat(F.lit("north_"), F.lower("n_name"))).when(k % 8 == 1, F.concat(F.lower("n_name"), F.lit("_east"))).otherwise("south_x_west").alias("id"),
        F.get(F.array(*map(F.lit, ("north", "south", "mid", "top", "south"))), r).alias("end"), F.get(F.array(*map(F.lit, ("center", "east", "west", "left"))), k % 4).alias("side"),
        F.when(k % 6 == 0, "  ").otherwise(F.col("n_name")).alias("feature"), F.array(along, across).alias("court_xy_ft"),
        F.array(F.get(at, 0) + F.when(k % 7 == 0, 1.0).otherwise(0.0), F.get(at, 1)).alias("diagram_xy"),
    )
    return V.keypoint_violations(points, 84.0, 50.0)
