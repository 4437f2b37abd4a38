"""A data source that writes exactly one named file for each key, in two phases, under a guard for what exists.

Tasks write whole files into a staging folder and list them there; the driver checks the guard for all of them and then
moves each to its name. A task that is killed, or a job that fails, leaves nothing but the staging folder, which is
deleted; a file is there as a whole or not at all. A file's content may come in many rows, which are streamed to it in
order, so it is never held as a whole. What the driver gets from a task is the name of its list.

``exists`` says what happens to names that are taken: ``fail`` refuses the whole write, ``replace`` replaces those
files, ``skip`` leaves them. Files of other names stay in any case. Paths are whatever Arrow's file systems open.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "name string, part long, content binary"
#: Files that a commit looks up in one call, and threads that move them: a file system answers one by one slowly.
CHUNK, THREADS = 1024, 16


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed its files."""

    listing: str | None


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. Hadoop also writes file:/ with one slash."""
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _safe(name: str | None) -> str:
    """A name that stays inside the folder."""
    clean = posixpath.normpath(name or "")
    if not name or clean.startswith(("/", "..")) or clean == ".":
        raise ValueError(f"not a name inside the folder: {name!r}")
    return clean


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, exists: str):
        if exists not in ("fail", "replace", "skip"):
            raise ValueError(f"exists must be fail, replace or skip, not {exists!r}")
        self.path, self.exists = path.rstrip("/"), exists
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"

    def _fs(self, path: str) -> tuple[arrow_fs.FileSystem, str]:
        return open_fs(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, staging = self._fs(self.staging)
        _, folder = self._fs(self.path)
        task = TaskContext.get().taskAttemptId()
        listed, now, out = [], None, None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    if name != now or out is None:
                        if out is not None:
                            out.close()
                        now, clean = name, _safe(name)
                        if self.exists == "fail" and fs.get_file_info(f"{folder}/{clean}").type != arrow_fs.FileType.NotFound:
                            raise FileExistsError(f"{self.path}/{clean}")
                        if not listed:
                            fs.create_dir(staging, recursive=True)
                        listed.append((f"{staging}/{task}-{len(listed)}", clean))
                        out = fs.open_output_stream(listed[-1][0])
                    if content.is_valid:
                        out.write(content.as_buffer())
        finally:
            if out is not None:
                out.close()
        if not listed:
            return Written(None)
        listing = f"{staging}/{task}.list"
        with fs.open_output_stream(listing) as f:
            for pair in listed:
                f.write((json.dumps(pair) + "\n").encode())
        return Written(listing)

    def _pairs(self, fs: arrow_fs.FileSystem, messages: list) -> Iterator[tuple[str, str]]:
        for m in messages:
            if m is not None and m.listing:
                with fs.open_input_stream(m.listing) as f:
                    for line in f.read().decode().splitlines():
                        yield tuple(json.loads(line))

    def commit(self, messages: list) -> None:
        fs, folder = self._fs(self.path)
        there = lambda names: {n for n, i in zip(names, fs.get_file_info([f"{folder}/{n}" for n in names]), strict=True) if i.type != arrow_fs.FileType.NotFound}
        made: set[str] = set()
        try:
            if self.exists == "fail":
                for pairs in batched(self._pairs(fs, messages), CHUNK, strict=False):
                    for name in sorted(there([name for _, name in pairs])):
                        raise FileExistsError(f"{self.path}/{name}")
            with ThreadPoolExecutor(THREADS) as threads:
                for pairs in batched(self._pairs(fs, messages), CHUNK, strict=False):
                    # Of two files of one name the last stays, or the first where names that are taken are left.
                    moves = {name: at for at, name in (reversed(pairs) if self.exists == "skip" else pairs)}
                    for name in there(list(moves)) if self.exists == "skip" else ():
                        del moves[name]
                    for parent in {posixpath.dirname(f"{folder}/{name}") for name in moves} - made:
                        fs.create_dir(parent, recursive=True)
                        made.add(parent)
                    list(threads.map(lambda name, moves=moves: fs.move(moves[name], f"{folder}/{name}"), moves))
        finally:
            self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        fs, staging = self._fs(self.staging)
        if fs.get_file_info(staging).type != arrow_fs.FileType.NotFound:
            fs.delete_dir(staging)


class NamedFiles(DataSource):
    """``named_files``: rows (name, part, content), those of a name in one task and in order of part."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], self.options.get("exists", "replace" if overwrite else "fail"))


def write_files(rows: DataFrame, path: str, name: str = "name", content: str = "document", part: str | None = None, exists: str = "fail") -> None:
    """A file in ``path`` for each name: its contents (text or bytes; null is empty) in the order of ``part``."""
    rows.sparkSession.dataSource.register(NamedFiles)
    made = rows.select(F.col(name).cast("string").alias("name"), (F.col(part).cast("long") if part else F.lit(0).cast("long")).alias("part"), F.col(content).cast("binary").alias("content"))
    made.repartition("name").sortWithinPartitions("name", "part").write.format("named_files").option("path", path).option("exists", exists).mode("append").save()
