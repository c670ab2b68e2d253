"""Tables written into the folder that the whole cluster shares, to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a folder of our own, in local mode alone: on a cluster the executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("reelgrid.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="reelgrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("reelgrid.scratch.dir", root)
    return root.rstrip("/")


class Scratch:
    """Written tables of one operator call. `drop` and `only` free those that no later plan reads; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: set[str] = set()
        atexit.register(self._end)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.tables.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
            self.tables.discard(name)

    def only(self, *names: str) -> None:
        self.drop(*(self.tables - set(names)))

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self._delete(self.root)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands at most so many rows at once to Python workers: for rows that hold whole texts or sets."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of the largest table that is broadcast where tables grow with the input. By Spark's own estimate: hashed rows take more (8.9 MB were seen, and 33.7 MB under a limit of 10 MB), and the driver holds those of a plan's joins at once.
BROADCAST_BYTES = 1 << 20


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextlib.contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What is run inside broadcasts tables of BROADCAST_BYTES at most, so that the driver's memory does not grow with the input."""
    key, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    sizes = {key: spark.conf.get(key), adaptive: spark.conf.get(adaptive, None)}  # the second counts where it is set
    before = {k: v for k, v in sizes.items() if v and _bytes(v) > BROADCAST_BYTES}
    for k in before:
        spark.conf.set(k, str(BROADCAST_BYTES))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Rows of one block; no block spans two partitions.
BLOCK_BITS = 16


def numbered(df: DataFrame, part: str = "_part", row: str = "_row") -> DataFrame:
    """Adds a block number, which grows with the partition and within it, and the row within the block.

    Write the result before use: a rerun under another partitioning numbers differently."""
    uid = F.monotonically_increasing_id()
    return df.withColumns({part: F.shiftright(uid, BLOCK_BITS), row: uid.bitwiseAND((1 << BLOCK_BITS) - 1)})
