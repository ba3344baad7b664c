"""A Spark data source for files of raw sensor frames: `spark.read.format("sensor_frames")`.

A file is a run of records of 18 bytes: an id (8 bytes, big-endian), the frame's length (1 byte) and the
frame, padded to nine bytes. Records are of one size, so a file is read in ranges of any number of
them by as many tasks. As a stream the source reads files in the order of their names, which begin with the
time of their commit; an offset is the name of the last file taken. The sink writes under hidden names and
renames when the whole job is done. Files are reached through `pyarrow.fs`, so a path may name any store
that it knows.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

NAME = "sensor_frames"
SCHEMA = "event_id bigint, frame binary"
FRAME_BYTES = 9
RECORD = 8 + 1 + FRAME_BYTES
SUFFIX = ".frames"
RANGE_BYTES = 64 << 20  # of one task
BATCH = 65_536          # records of one Arrow batch


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/(?!//)", path):
        path = "file:///" + path[len("file:"):].lstrip("/")
    if re.match(r"[a-z][a-z0-9+.-]*://", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the committed files, by name."""
    store, root = opened(path)
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    names = [(f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name.endswith(SUFFIX) and not f.base_name.startswith("_")]
    for name, size in names:
        if size % RECORD:
            raise ValueError(f"{name} does not hold whole records: {size} bytes")
    return sorted(names)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def ranges(files: list[tuple[str, int]], most: int) -> list[Range]:
    step = max(1, most // RECORD) * RECORD
    return [Range(path, lo, min(lo + step, size)) for path, size in files for lo in range(0, size, step)]


def batches(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    store, _ = opened(path)
    with store.open_input_file(part.path) as file:
        for lo in range(part.start, part.stop, BATCH * RECORD):
            raw = file.read_at(min(BATCH * RECORD, part.stop - lo), lo)
            records = [raw[k:k + RECORD] for k in range(0, len(raw), RECORD)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int.from_bytes(r[:8], "big", signed=True) for r in records], pa.int64()),
                pa.array([None if r[8] == 255 else r[9:9 + r[8]] for r in records], pa.binary()),
            ], ["event_id", "frame"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return ranges(listed(self.path), self.most) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.stop:
            yield from batches(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = listed(self.path)
        return {"after": names[-1][0] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges([f for f in listed(self.path) if start["after"] < f[0] <= end["after"]], self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, partition)

    def commit(self, end: dict) -> None:
        """Files stay; nothing is kept for a restart but the offset."""


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("frame files are only appended")
        self.path = options["path"]

    def write(self, iterator) -> _Written:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        name = f"_{uuid.uuid4().hex}{SUFFIX}"
        with store.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                frame = row["frame"]
                if frame is not None and len(frame) > FRAME_BYTES:
                    raise ValueError(f"a frame of {len(frame)} bytes")
                size = 255 if frame is None else len(frame)
                out.write(int(row["event_id"]).to_bytes(8, "big", signed=True) + bytes([size]) + bytes(frame or b"").ljust(FRAME_BYTES, b"\0"))
        return _Written(name)

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        at = f"{time.time_ns():020d}"
        for m in messages:
            if m is not None:
                store.move(f"{root}/{m.name}", f"{root}/{at}-{m.name[1:]}")

    def abort(self, messages: list) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> str:
    """Make the format known to the session; returns its name."""
    spark.dataSource.register(FrameSource)
    return NAME
