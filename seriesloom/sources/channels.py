"""Binary files of channels as a Spark data source: a partition per file, and only the channels asked for are read.

A file holds a magic word, the number of channels, the place of each channel's
end, and the channels' values as little-endian doubles.  ``write`` puts one file
per row under a name of its own and moves all files to their place when the job
commits.  Paths are opened through Arrow's file systems, so a folder may be local
to all machines (``file:``) or in a store that Arrow knows.

The option ``files`` drops files before tasks are planned, the option ``channels``
names the byte ranges that are read.  An empty channel has no values; null
values are NaN.  A file that is cut short or is no channel file fails the task.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MAGIC = b"LOOMCHN1"
SUFFIX = ".channels"
SCHEMA = "file long, channel int, values array<double>"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """An Arrow file system and the path in it."""
    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def encoded(channels: list[list[float | None]]) -> bytes:
    """A file's bytes."""
    values = [np.array([np.nan if x is None else x for x in c or []], "<f8") for c in channels]
    ends = np.cumsum([len(v) for v in values], dtype="<u8") if values else np.zeros(0, "<u8")
    return MAGIC + struct.pack("<I", len(values)) + ends.tobytes() + b"".join(v.tobytes() for v in values)


def read_channels(stream, wanted: set[int] | None) -> Iterator[tuple[int, np.ndarray]]:
    """(channel, values) of the wanted channels, each by its own byte range."""

    def take(at: int, n: int) -> bytes:
        stream.seek(at)
        got = stream.read(n)
        if len(got) < n:
            raise ValueError("the channel file is cut short")
        return got

    head = take(0, len(MAGIC) + 4)
    if not head.startswith(MAGIC):
        raise ValueError("not a channel file")
    (n,) = struct.unpack("<I", head[len(MAGIC) :])
    ends = np.frombuffer(take(len(head), 8 * n), "<u8").astype(np.int64)
    base = len(head) + 8 * n
    for channel in range(n) if wanted is None else sorted(c for c in wanted if 0 <= c < n):
        first = int(ends[channel - 1]) if channel else 0
        yield channel, np.frombuffer(take(base + 8 * first, 8 * (int(ends[channel]) - first)), "<f8")


@dataclass
class File(InputPartition):
    path: str
    file: int


class ChannelReader(DataSourceReader):
    def __init__(self, path: str, files: set[int] | None, channels: set[int] | None):
        self.path, self.files, self.channels = path, files, channels

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        names = {int(m[1]): f.path for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if (m := re.fullmatch(rf"(-?\d+){SUFFIX}", f.base_name))}
        return [File(path, file) for file, path in sorted(names.items()) if self.files is None or file in self.files]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        store, _ = opened(self.path)
        with store.open_input_file(partition.path) as stream:
            for channel, values in read_channels(stream, self.channels):
                row = [pa.array([partition.file], pa.int64()), pa.array([channel], pa.int32()), pa.array([values], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(row, names=["file", "channel", "values"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class ChannelWriter(DataSourceWriter):
    """Rows (file, channels array<array<double>>), one file each."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        names = []
        for row in rows:
            hidden = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(encoded(row["channels"]))
            names.append((hidden, f"{root}/{row['file']}{SUFFIX}"))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for hidden, name in (x for m in messages if m for x in m.names):
            store.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for hidden, _ in (x for m in messages if m for x in m.names):
            store.delete_file(hidden)


class ChannelFiles(DataSource):
    """``spark.read.format("channel_files").load(path)``: (file, channel, values)."""

    @classmethod
    def name(cls) -> str:
        return "channel_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChannelReader:
        asked = lambda name: {int(c) for c in self.options[name].split(",") if c} if name in self.options else None
        return ChannelReader(self.options["path"], asked("files"), asked("channels"))

    def writer(self, schema, overwrite: bool) -> ChannelWriter:
        return ChannelWriter(self.options["path"])


def write_channels(rows: DataFrame, path: str) -> None:
    """``rows``: (file long, channels array<array<double>>); a file's channels are one value, so bound their number."""
    rows.sparkSession.dataSource.register(ChannelFiles)
    rows.select("file", "channels").write.format("channel_files").mode("append").save(path)


def channel_table(spark: SparkSession, path: str, channels: list[int] | None = None, files: list[int] | None = None) -> DataFrame:
    """(file, channel, values) of all files and channels, or of those named alone."""
    spark.dataSource.register(ChannelFiles)
    reader = spark.read.format("channel_files")
    for name, asked in (("channels", channels), ("files", files)):
        if asked is not None:
            reader = reader.option(name, ",".join(map(str, asked)))
    return reader.load(path)
