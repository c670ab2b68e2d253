"""A Spark data source of videos' frames; decoding is behind `decoder`, a `module:function` of the reader's own environment.

decoder(path, start, stop, stride) yields (native_index, payload bytes) in order and ends at
the first frame it cannot read. Without one, only indices and times come out. `fps` and
`frame_count` are options, or come from `probe`, a `module:function` of the driver's
environment: probe(path) -> mapping with fps, frame_count, width, height. Options of both
forms: stride (1), start_index (0).

Batch: path, max_frames, frames_per_task (1000; native frames that one task decodes). Filters
on frame_index bound what is decoded where the session pushes filters into Python sources
(`pushdown` true; `video_frames` sees to both).

Stream: path or paths (a JSON list) or lister (`module:function` of the driver's environment
-> list of paths, asked at every trigger, so that videos may come), frames_per_batch (1000;
native frames of a path that a micro-batch takes at most), progress (a folder that driver and
executors share). An offset is the next native index of each path. A path's frames in a
batch are one task's, in order; at its first failed frame the path ends, for good: the task
leaves a mark in the progress folder before it is over, and no later batch goes on with it.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
from collections.abc import Callable, Iterable, Iterator
from importlib import import_module

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from reelgrid.functions import scalars as S
from reelgrid.sources.files import shared_read, shared_write

SCHEMA = "path string, frame_index bigint, timestamp_s double, payload binary"


def _hook(name: str) -> Callable:
    module, function = name.split(":")
    return getattr(import_module(module), function)


class FrameRange(InputPartition):
    def __init__(self, path: str, fps: float, start: int, stop: int):
        self.path, self.fps, self.start, self.stop = path, fps, start, stop


class _Options:
    """What both forms share."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.stride, self.first = int(options.get("stride", 1)), int(options.get("start_index", 0))
        if self.stride < 1 or self.first < 0:
            raise ValueError("stride must be at least 1 and start_index not negative")
        self.decoder = options.get("decoder")

    def known(self, path: str) -> tuple[float, int]:
        """fps and frame_count of a path."""
        known = _hook(self.options["probe"])(path) if "probe" in self.options else {}
        fps = float(self.options.get("fps", known.get("fps") or "nan"))
        count = int(self.options["frame_count"] if "frame_count" in self.options else known["frame_count"])
        return (fps if fps > 0 else 30.0), count  # false for not-a-number too

    def frames(self, r: FrameRange) -> Iterator[tuple[int, bytes | None]]:
        begin = -(-r.start // self.stride) * self.stride
        if self.decoder is None:
            return ((i, None) for i in range(begin, r.stop, self.stride))
        return iter(_hook(self.decoder)(r.path, begin, r.stop, self.stride))


class FrameReader(_Options, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.path = options.get("path", "")
        self.fps, self.stop = self.known(self.path)
        if "max_frames" in options:
            first = -(-self.first // self.stride) * self.stride
            self.stop = min(self.stop, first + int(options["max_frames"]) * self.stride)
        self.step = int(options.get("frames_per_task", 1000))

    def bound(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on frame_index are taken over; the rest is given back."""
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_index",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.stop = min(self.stop, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, EqualTo):
                self.first, self.stop = max(self.first, f.value), min(self.stop, f.value + 1)
            else:
                yield f

    def partitions(self) -> list[FrameRange]:
        return [FrameRange(self.path, self.fps, lo, min(lo + self.step, self.stop)) for lo in range(self.first, self.stop, self.step)]

    def read(self, partition: FrameRange | None) -> Iterator[tuple]:
        if partition is None:  # how Spark reads where there are no partitions
            return
        for i, payload in self.frames(partition):
            yield partition.path, i, round(i / partition.fps, 3), payload


class PushedFrameReader(FrameReader):
    """For sessions in which Spark pushes filters into Python sources; it refuses a source that takes them in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return self.bound(filters)


class FrameStream(_Options, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.step = max(1, int(options.get("frames_per_batch", 1000)))
        self.progress = options["progress"]
        stored = shared_read(posixpath.join(self.progress, "planned.json"))
        self.at: dict[str, int] = json.loads(stored) if stored else {}
        self.sizes: dict[str, tuple[float, int]] = {}

    def paths(self) -> list[str]:
        if "lister" in self.options:
            return list(_hook(self.options["lister"])())
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def size(self, path: str) -> tuple[float, int]:
        if path not in self.sizes:
            self.sizes[path] = self.known(path)
        return self.sizes[path]

    def mark(self, path: str) -> str:
        return posixpath.join(self.progress, f"ended-{hashlib.sha1(path.encode()).hexdigest()}")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Behind the last planned batch, each path that has not ended goes on by a batch's frames at most."""
        out = dict(self.at)
        for path in self.paths():
            here = out.get(path, self.first)
            if here < self.size(path)[1] and shared_read(self.mark(path)) is None:
                here = min(here + self.step, self.size(path)[1])
            out[path] = here
        return out

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        """One range a path. What is planned is stored, so that a restarted stream knows where it is; Spark itself does a planned batch again that was not finished."""
        self.at = {p: max(n, self.at.get(p, 0)) for p, n in end.items()}
        shared_write(posixpath.join(self.progress, "planned.json"), json.dumps(self.at).encode())
        return [FrameRange(p, self.size(p)[0], start.get(p, self.first), n) for p, n in end.items() if n > start.get(p, self.first)]

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        expected = -(-partition.start // self.stride) * self.stride
        for i, payload in self.frames(partition):
            if i != expected:
                break
            yield partition.path, i, round(i / partition.fps, 3), payload
            expected += self.stride
        if expected < partition.stop:
            shared_write(self.mark(partition.path), str(expected).encode())

    def commit(self, end: dict) -> None:
        pass


class VideoFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return (PushedFrameReader if self.options.get("pushdown") == "true" else FrameReader)(self.options)

    def streamReader(self, schema: StructType) -> FrameStream:
        return FrameStream(self.options)


def video_frames(spark: SparkSession, stream: bool = False, **options) -> DataFrame:
    """Frames by the options above; filters on frame_index reach the decoder."""
    spark.dataSource.register(VideoFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.readStream if stream else spark.read
    return reader.format("video_frames").option("pushdown", "true").options(**{k: json.dumps(v) if isinstance(v, list) else str(v) for k, v in options.items()}).load()


def probed(videos: DataFrame, probe: Callable[[str], dict]) -> DataFrame:
    """videos (path, ...) with fps (30 where it is missing, not positive or not a number), width, height, frame_count as probe(path) says.

    A file that cannot be probed has nulls and its reason in probe_error. Files are probed in parallel, a row each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    info, error = probe(path), None
                except Exception as e:
                    info, error = {}, f"{type(e).__name__}: {e}"
                rows.append((info.get("fps"), info.get("width"), info.get("height"), info.get("frame_count"), error))
            found = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield b.assign(**{c: pd.Series(v, index=b.index, dtype=object) for c, v in zip(("fps", "width", "height", "frame_count", "probe_error"), found, strict=True)})

    fields = ", ".join(f"`{c}` {t}" for c, t in videos.dtypes)
    out = videos.mapInPandas(run, f"{fields}, fps double, width int, height int, frame_count long, probe_error string")
    return out.withColumn("fps", F.when(F.col("probe_error").isNull(), S.valid_fps(F.col("fps"))))


def until_decode_failure(frames: DataFrame, stride: int = 1, start_index: int = 0, frames_per_task: int = 1000) -> DataFrame:
    """Frames of each path before the first one that is missing, as a reader of the whole file would have stopped there.

    A task's range already ends at its first failure; this drops the ranges after it. Only
    one row a range is put in order, not the frames.
    """
    ranged = F.floor(F.col("frame_index") / frames_per_task)
    ranges = frames.groupBy("path", ranged.alias("_range")).agg(F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("path").orderBy("_range")
    first = -(-start_index // stride) * stride
    before = F.coalesce(F.lag("hi").over(order), F.lit(first - stride))
    gap = F.when(F.col("lo") != before + stride, before).when((F.col("hi") - F.col("lo")) / stride + 1 != F.col("n"), F.col("lo") + (F.col("n") - 1) * stride)
    stop = ranges.withColumn("gap", gap).groupBy("path").agg(F.min("gap").alias("_stop"))
    return frames.join(stop, "path").where(F.col("_stop").isNull() | (F.col("frame_index") <= F.col("_stop"))).select(frames.columns)
