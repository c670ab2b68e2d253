"""Whole files through Spark's own file system layer, so that any store works."""

from __future__ import annotations

import atexit
import contextlib
import os
import posixpath
import tempfile
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders in a folder, whatever their number of files; of a missing one none."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of one small file; null if it is missing."""
    if not exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_text_atomically(spark: SparkSession, path: str, text: str) -> None:
    """Under another name first, then renamed: a reader sees the old or the new file."""
    fs, p = _fs(spark, path)
    folder, name = posixpath.split(path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(folder, f".{name}-{uuid.uuid4().hex}"))
    fs.mkdirs(p.getParent())
    try:
        stream = fs.create(temp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(temp, p):  # some stores refuse to replace
            fs.delete(p, False)
            if not fs.rename(temp, p):
                raise OSError(f"cannot write {path}")
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)


def shared_store(path: str):
    """File system and path for tasks, which have no Spark session: any that pyarrow knows by its URI, else the local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shared_read(path: str) -> bytes | None:
    """Content of one small file, in a task or a source; null if it is missing."""
    store, at = shared_store(path)
    try:
        with store.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def shared_write(path: str, data: bytes) -> None:
    """Under another name first, then renamed."""
    store, at = shared_store(path)
    folder = posixpath.dirname(at)
    temp = posixpath.join(folder, f".{uuid.uuid4().hex}")
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(temp) as out:
        out.write(data)
    store.move(temp, at)


def delete_tree(path: str) -> None:
    """Deletes a folder, if there is one. On the local file system its entries come as a stream: a list of millions of files would not fit the driver."""
    from pyarrow import fs

    store, at = shared_store(path)
    if not isinstance(store, fs.LocalFileSystem):
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(at)
        return
    with contextlib.suppress(FileNotFoundError), os.scandir(at) as entries:
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                delete_tree(e.path)
            else:
                os.unlink(e.path)
    with contextlib.suppress(FileNotFoundError):
        os.rmdir(at)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads again: in spark.checkpoint.dir, which driver and executors share; in local mode alone also where that is unset. It goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}"
    path = f"{root.rstrip('/')}/reelgrid-{name}-{uuid.uuid4().hex}"

    def end() -> None:
        with contextlib.suppress(Exception):
            delete_tree(path)
        with contextlib.suppress(Exception):  # a store that pyarrow does not know; the session may have ended before
            remove(spark, path)

    atexit.register(end)
    return path
