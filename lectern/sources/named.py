"""Whole files by name: a data source that writes each row to the file it names and reads files back.

``df.write.format("named_files").save(folder)`` takes rows of ``name`` and ``content`` (text or binary). A task writes its files
below a folder of its own, and a list of them; only when all tasks are done does the commit put them where they belong, so a
task that failed, or ran twice, leaves nothing. The driver gets the place of each task's list and reads one at a time. Reading
gives ``path``, ``name`` and ``content``, many small files to a partition; the driver lists them, local ones as a stream, and keeps
a few packed bytes for each. Files go through the file system that the path names, which all executors must reach.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass
from fnmatch import translate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "named_files"
#: Bytes and files that a partition reads, and bytes and files that it hands on at a time.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 1 << 12
_BATCH_BYTES, _BATCH_FILES = 1 << 20, 1 << 8
#: Start of the folder that a write's files wait in, its list of names, and threads that move files, so many at a time.
_PENDING, _LIST, _MOVERS, _MOVED = "_pending-", "names", 16, 1 << 8


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _checked(name: str | None) -> str:
    """The name, if it stays below the folder."""
    if not name or name.startswith(("/", _PENDING)) or "\0" in name or any(part in ("", ".", "..") for part in name.split("/")):
        raise ValueError(f"no file can be named {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """The folder that a task's files wait in; its list has the name of each, by number."""

    folder: str


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.path)
        waiting, names = f"{root}/{_PENDING}{self.job}/{uuid.uuid4().hex}", set()
        store.create_dir(waiting, recursive=True)
        with store.open_output_stream(f"{waiting}/{_LIST}") as listed:
            for batch in batches:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                    k = len(names)
                    if _checked(name) in names:
                        raise ValueError(f"two rows are named {name!r}")
                    names.add(name)
                    with store.open_output_stream(f"{waiting}/{k}") as out:
                        out.write(content.as_buffer() or b"")
                    listed.write(json.dumps(name).encode() + b"\n")
        return Written(waiting)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.path)
        with ThreadPoolExecutor(_MOVERS) as movers:
            for message in filter(None, messages):
                with store.open_input_stream(f"{message.folder}/{_LIST}") as listed:
                    names = [json.loads(line) for line in listed.read().splitlines()]
                for folder in sorted({name.rpartition("/")[0] for name in names} - {""}):
                    store.create_dir(f"{root}/{folder}", recursive=True)

                def move(first: int) -> None:
                    for k in range(first, min(first + _MOVED, len(names))):
                        store.move(f"{message.folder}/{k}", f"{root}/{names[k]}")

                for _ in movers.map(move, range(0, len(names), _MOVED)):
                    pass
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*_opened(self.path))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        place = f"{root}/{_PENDING}{self.job}"
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)


@dataclass
class Files(InputPartition):
    """Names of files below a folder, packed: the driver holds all partitions."""

    folder: str
    packed: bytes

    @classmethod
    def of(cls, folder: str, names: list[str]) -> Files:
        return cls(folder, zlib.compress(json.dumps(sorted(names)).encode()))

    @property
    def paths(self) -> list[str]:
        return [f"{self.folder}/{name}" for name in json.loads(zlib.decompress(self.packed))]


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, bool, Callable[[], int]]]:
    """(name, is a folder, is a file, its bytes when called for) of what is in a folder; a local one is not held as a whole."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) if os.path.lexists(folder) else nullcontext(()) as found:
            for e in found:
                yield e.name, e.is_dir(), e.is_file(), lambda e=e: e.stat().st_size
    else:
        for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            yield f.base_name, f.type == fs.FileType.Directory, f.type == fs.FileType.File, lambda f=f: f.size or 0


def _listed(store: fs.FileSystem, root: str, pattern: str) -> Iterator[tuple[str, int]]:
    """(name below the root, bytes) of the files whose own name fits, a folder at a time; files of writes that did not end are left out."""
    fits, pending, waiting = re.compile(translate(pattern)).match, re.compile(_PENDING + "[0-9a-f]{32}").fullmatch, [""]
    while waiting:
        folder = waiting.pop()
        for name, is_folder, is_file, size in _entries(store, f"{root}/{folder}".rstrip("/")):
            if is_folder and not pending(name):
                waiting.append(f"{folder}{name}/")
            elif is_file and fits(name):
                yield f"{folder}{name}", size()


class NamedReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, binary: bool):
        self.path, self.pattern, self.binary = path, pattern, binary

    def partitions(self) -> list[Files]:
        store, root = _opened(self.path)
        root = root.rstrip("/")
        out, names, size = [], [], 0
        for name, n in _listed(store, root, self.pattern):
            if names and (size + n > PARTITION_BYTES or len(names) == PARTITION_FILES):
                out.append(Files.of(root, names))
                names, size = [], 0
            names.append(name)
            size += n
        return [*out, Files.of(root, names)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        paths, contents, size = [], [], 0
        for path in partition.paths:
            with store.open_input_stream(path) as data:
                contents.append(data.read())
            paths.append(path)
            size += len(contents[-1])
            if size > _BATCH_BYTES or len(paths) == _BATCH_FILES:
                yield self._batch(partition.folder, paths, contents)
                paths, contents, size = [], [], 0
        if paths:
            yield self._batch(partition.folder, paths, contents)

    def _batch(self, root: str, paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        kind = pa.binary() if self.binary else pa.string()
        names = [path.removeprefix(root).lstrip("/") for path in paths]
        return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(names), pa.array(contents, pa.binary()).cast(kind)], names=["path", "name", "content"])


class NamedFiles(DataSource):
    """Options: ``path``; for reading ``pattern`` of file names and ``binary`` (else contents are text in UTF-8)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _binary(self) -> bool:
        return self.options.get("binary", "false").lower() == "true"

    def schema(self) -> str:
        return f"path string, name string, content {'binary' if self._binary() else 'string'}"

    def reader(self, schema) -> NamedReader:
        return NamedReader(self.options["path"], self.options.get("pattern", "*"), self._binary())

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], overwrite)


def write_named(files: DataFrame, path: str) -> None:
    """Write ``files(name, content)``, each row as the file of its name below a folder. Names must differ and stay below it; a
    null content is an empty file. Files of those names are replaced, others stay."""
    files.sparkSession.dataSource.register(NamedFiles)
    # rows of one name meet in one task, which tells
    files.select("name", "content").repartition("name").write.format(FORMAT).mode("append").save(path)


def read_named(spark: SparkSession, path: str, pattern: str = "*", binary: bool = False) -> DataFrame:
    """(path, name, content) of the files below a folder whose own name fits the pattern; ``name`` is the path within it."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format(FORMAT).option("pattern", pattern).option("binary", str(binary).lower()).load(path)


def subtitle_name(stem: Column, lang: Column, suffix: str = ".srt") -> Column:
    """``stem[_lang].suffix``; no language, no mark."""
    return F.concat(F.concat_ws("_", stem, lang), F.lit(suffix))
