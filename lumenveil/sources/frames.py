"""Folders of numbered frames as a Spark source and sink.

``spark.read.format("frames").load(folder)`` gives (frame_idx, path, width, height,
pixels) of files ``<name>_<number>.ppm``; pixels are BGR bytes. A folder is listed
once, partitions are ranges of frame numbers, and the options ``first`` and ``last``
(see :func:`between`) leave files outside unopened. Filters are not pushed down by
themselves: Spark 4.1 keeps what one query has pushed into a Python source for the
next query of the same DataFrame, which would lose rows. Folders are reached through
Arrow's file systems, so an URI of any of them will do.

Defined cases: numbers are compared as numbers, whatever their zeros; other files are
passed over; an empty folder gives no rows; a file that is no binary PPM of 8 bits is
an error that names it. A frame that is written again replaces its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "frame_idx bigint, path string, width int, height int, pixels binary"
#: Files of one partition.
FILES = 256
_NAME = re.compile(r"_([0-9]+)\.ppm$")
_HEADER = re.compile(rb"P6\s+(?:#[^\n]*\n\s*)*([0-9]+)\s+([0-9]+)\s+255\s", re.S)


@dataclass
class Range(InputPartition):
    """Files of neighbouring numbers."""

    files: list[tuple[int, str]]


@dataclass
class Written(WriterCommitMessage):
    frames: int


def decoded(content: bytes, path: str) -> tuple[int, int, bytes]:
    """(width, height, BGR bytes) of a binary PPM file."""
    head = _HEADER.match(content)
    if head is None:
        raise ValueError(f"{path} is no binary PPM file of 8 bits")
    width, height = int(head[1]), int(head[2])
    rgb = np.frombuffer(content, np.uint8, width * height * 3, head.end()).reshape(height, width, 3)
    return width, height, rgb[:, :, ::-1].tobytes()


def encoded(width: int, height: int, pixels: bytes) -> bytes:
    """The binary PPM file of BGR bytes."""
    bgr = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
    return b"P6\n%d %d\n255\n" % (width, height) + bgr[:, :, ::-1].tobytes()


def numbered(folder: str, first: int | None = None, last: int | None = None) -> list[tuple[int, str]]:
    """(number, path) of a folder's frames from first to last, in order."""
    files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = [(int(m[1]), f.path) for f in files.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and (m := _NAME.search(f.base_name))]
    return sorted((n, p) for n, p in found if (first is None or n >= first) and (last is None or n <= last))


class _Reader(DataSourceReader):
    def __init__(self, folder: str, first: int | None, last: int | None, files: int) -> None:
        self.folder, self.first, self.last, self.files = folder, first, last, files

    def partitions(self) -> list[Range]:
        found = numbered(self.folder, self.first, self.last)
        return [Range(found[k : k + self.files]) for k in range(0, len(found), self.files)] or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        for number, path in partition.files:
            with files.open_input_stream(path) as file:
                width, height, pixels = decoded(file.read(), path)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([pixels], pa.binary())], names=["frame_idx", "path", "width", "height", "pixels"])


class _Writer(DataSourceWriter):
    """A file is written under another name first, so that a lost task leaves no half frame."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, rows: Iterator) -> Written:
        import uuid

        files, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        files.create_dir(path, recursive=True)
        n = 0
        for n, row in enumerate(rows, 1):
            target = f"{path}/frame_{row.frame_idx:05d}.ppm"
            partial = f"{path}/.{uuid.uuid4().hex}"
            with files.open_output_stream(partial) as file:
                file.write(encoded(row.width, row.height, bytes(row.pixels)))
            files.move(partial, target)
        return Written(n)


class Frames(DataSource):
    """The source and sink; see the module."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        bound = lambda key: int(self.options[key]) if key in self.options else None
        return _Reader(self.options["path"], bound("first"), bound("last"), int(self.options.get("files", FILES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format ``frames`` known to a session."""
    spark.dataSource.register(Frames)


def between(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """The frames of a folder from first to last; the other files are not opened."""
    return spark.read.format("frames").option("first", first).option("last", last).load(folder)
