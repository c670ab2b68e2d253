"""A file for each row, written by Spark's tasks: labels, training lines, pictures.

Rows are name (the path inside the folder), content (bytes) and source (a file to copy where
content is null). Each file is written under another name and then renamed, so no reader sees a
part of one, and a task that is run again replaces what it wrote.

mode overwrite: tasks fill a folder beside the target, which takes the target's place in one
rename once all are done; if the job fails, that folder goes and the target stays as it was.
mode append: a task renames its files into the target once it has written all of them; one that
fails leaves none there, and what it had written goes when the job ends. The driver touches
folders only, never single files.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from reelgrid.sources.files import delete_tree, folders, shared_store

COLUMNS = ("name", "content", "source")
#: Tasks that write files, for each core.
WRITERS_PER_CORE = 2
#: Files, and bytes of their content, that a reading task hands on at once, about.
FILES_AT_ONCE, CONTENT_AT_ONCE = 1000, 4 << 20


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        mark = uuid.uuid4().hex
        self.stage = f"{self.folder}.staged-{mark}" if overwrite else f"{self.folder}/.staged-{mark}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, stage = shared_store(self.stage)
        _, folder = shared_store(self.folder)
        mine = posixpath.join(stage, f".task-{uuid.uuid4().hex}")
        target = stage if self.overwrite else folder
        store.create_dir(mine, recursive=True)
        known, written = set(), []

        def place(temp: str, name: str) -> None:
            path = posixpath.join(target, name)
            parent = posixpath.dirname(path)
            if parent not in known:
                store.create_dir(parent, recursive=True)
                known.add(parent)
            store.move(temp, path)

        try:
            for k, row in enumerate(iterator):
                temp = posixpath.join(mine, str(k))
                if row["content"] is not None:
                    with store.open_output_stream(temp) as out:
                        out.write(bytes(row["content"]))
                else:
                    other, source = shared_store(row["source"])
                    with other.open_input_stream(source) as data, store.open_output_stream(temp) as out:
                        while block := data.read(1 << 22):
                            out.write(block)
                if self.overwrite:
                    place(temp, row["name"])
                else:
                    written.append((temp, row["name"]))
            for temp, name in written:
                place(temp, name)
        finally:
            store.delete_dir(mine)
        return Written(k + 1 if "k" in locals() else 0)

    def _drop(self, path: str) -> None:
        delete_tree(path)

    def commit(self, messages: list[Written | None]) -> None:
        if not self.overwrite:
            return self._drop(self.stage)
        store, stage = shared_store(self.stage)
        store.create_dir(stage, recursive=True)  # no row, no task: an empty folder
        self._drop(self.folder)
        _, folder = shared_store(self.folder)
        store.move(stage, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(self.stage)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if tuple(schema.names) != COLUMNS:
            raise ValueError(f"columns must be {COLUMNS}")
        return FileWriter(self.options["path"], overwrite)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores: they are short and each costs a file, so a large input file must not be one task."""
    return rows.repartition(WRITERS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism)


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> int:
    """rows (name, and content or source) as files of the folder; returns their number."""
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    counted = Observation()
    has = rows.columns
    out = rows.select(*[F.col(c).cast("binary" if c == "content" else "string").alias(c) if c in has else F.lit(None).cast("binary" if c == "content" else "string").alias(c) for c in COLUMNS])
    out.observe(counted, F.count(F.lit(1)).alias("n")).write.format("named_files").mode("overwrite" if overwrite else "append").option("path", folder).save()
    return counted.get["n"]


def delete_files(names: DataFrame, folder: str) -> int:
    """Deletes folder/<name> of every row (name), in tasks; returns how many there were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = shared_store(folder)
        for b in batches:
            found = 0
            for name in b["name"]:
                try:
                    store.delete_file(posixpath.join(root, name))
                    found += 1
                except FileNotFoundError:
                    pass
            yield pd.DataFrame({"n": [found]})

    return names.select("name").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _listed(root: str, folder: str, deep: bool) -> Iterator[str]:
    """Names below root of a folder's files, and with `deep` those of its folders; hidden ones are left out, as Spark does. Local ones come as a stream, other stores list a folder at a time."""
    from pyarrow import fs

    store, at = shared_store(root)
    todo = [folder]
    while todo:
        here = todo.pop()
        path = posixpath.join(at, here) if here else at
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(path) as found:
                entries = ((e.name, e.is_dir()) for e in found)
                for name, inner in entries:
                    if not name.startswith((".", "_")):
                        if not inner:
                            yield posixpath.join(here, name)
                        elif deep:
                            todo.append(posixpath.join(here, name))
        else:
            for e in store.get_file_info(fs.FileSelector(path)):
                if not e.base_name.startswith((".", "_")):
                    if e.type != fs.FileType.Directory:
                        yield posixpath.join(here, e.base_name)
                    elif deep:
                        todo.append(posixpath.join(here, e.base_name))


def read_files(spark: SparkSession, root: str, ending: str = "", loose: bool = False, deep: bool = False) -> DataFrame:
    """name (the path below root) and content of the files, of that ending, in the folders of root; loose: and those beside them; deep: and in their folders.

    Tasks list the folders, one a folder, and names are dealt to all cores to be read. The
    driver knows the folders only: Spark's own readers hold every file's path and status there.
    """
    roots = [(posixpath.basename(f.rstrip("/")), deep) for f in folders(spark, root)]
    roots = [(f, d) for f, d in roots if not f.startswith((".", "_"))] + ([("", False)] if loose else [])
    if not roots:
        return spark.createDataFrame([], "name string, content binary")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder, deep in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held = []
                for name in _listed(root, folder, deep):
                    if name.endswith(ending):
                        held.append(name)
                    if len(held) == FILES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["name"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["name"])

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = shared_store(root)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["name", "content"])
        for b in batches:
            rows, size = [], 0
            for name in b.column(0).to_pylist():
                with store.open_input_stream(posixpath.join(at, name)) as f:
                    rows.append((name, f.read()))
                size += len(rows[-1][1])
                if len(rows) >= FILES_AT_ONCE or size >= CONTENT_AT_ONCE:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    found = spark.createDataFrame(roots, "folder string, deep boolean").mapInArrow(names, "name string")
    return spread(found).mapInArrow(contents, "name string, content binary")
