"""A Python data source that parses many small delimited files, each of them once.

``spark.read.format("delimited_files")`` lists the files, packs them into partitions by size and gives
for each file one record of the dataset, one a column, one a row, or one of its error, all of one
parse. Files are opened with pyarrow, so any store that it knows will do.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES = 32 << 20
#: A small file costs this much besides its bytes.
OPEN_BYTES = 1 << 20


class Found(NamedTuple):
    path: str
    size: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it; ``file:/x`` and plain paths are local."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def can_open(paths: list[str]) -> bool:
    """Whether pyarrow knows the stores of all ``paths``."""
    try:
        for p in paths:
            _opened(p)
    except (ValueError, OSError, ImportError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def listed(path: str) -> list[Found]:
    """The files of a path, which is a file, a folder, or a pattern for the names in a folder; hidden ones are left out."""
    store, inner = _opened(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    pattern = inner if any(c in inner for c in "*?[") else None
    info = store.get_file_info(inner) if pattern is None else None
    if info is not None and info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"PATH_NOT_FOUND: {path} does not exist")
    if info is not None and info.type == fs.FileType.File:
        return [Found(scheme + info.path, info.size)]
    folder = inner.rstrip("/") if pattern is None else inner.rsplit("/", 1)[0]
    names = store.get_file_info(fs.FileSelector(folder))
    files = [f for f in names if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return [Found(scheme + f.path, f.size) for f in files if pattern is None or fnmatch.fnmatch(f.path, pattern)]


def packed(files: list[Found], most: int = PARTITION_BYTES) -> list[list[str]]:
    """Files in bins of about ``most`` bytes, the largest first; a larger file has a bin of its own."""
    bins: list[list[str]] = []
    room = 0
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        cost = f.size + OPEN_BYTES
        if not bins or cost > room:
            bins.append([])
            room = most
        bins[-1].append(f.path)
        room -= cost
    return bins


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Files]:
        most = int(self.options.get("partitionbytes", PARTITION_BYTES))
        found = dict.fromkeys(f for p in json.loads(self.options["paths"]) for f in listed(p))
        return [Files(b) for b in packed(list(found), most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from . import delimited

        labels = self.options.get("haslabels", "false") == "true"
        for path in partition.paths:
            store, inner = _opened(path)
            with store.open_input_stream(inner, compression=None) as f:
                content = f.read()
            yield from delimited.file_records(path, content, self.options.get("sep"), labels, self.options.get("encoding"))


class DelimitedFiles(DataSource):
    """Options: paths (a JSON list), sep, encoding, hasLabels, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "delimited_files"

    def schema(self) -> str:
        from . import delimited

        return delimited.PARSED

    def reader(self, schema) -> FilesReader:
        return FilesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DelimitedFiles)
