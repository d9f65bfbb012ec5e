"""Write-ahead spools: records of partition (4 bytes), offset (8), length (4) and value, big-endian."""

from __future__ import annotations

import os
import struct
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RECORD = struct.Struct(">iqI")


def records(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """The whole records; what a crash has cut off at the end is left out."""
    at = 0
    while at + RECORD.size <= len(raw):
        partition, offset, size = RECORD.unpack_from(raw, at)
        at += RECORD.size
        if at + size > len(raw):
            return
        yield partition, offset, raw[at : at + size]
        at += size


def packed(partition: int, offset: int, value: bytes) -> bytes:
    return RECORD.pack(partition, offset, len(value)) + value


class Spool:
    """An appending writer: a record is on disk when `append` returns, or `append` has raised.

    A crash can leave a cut record at the end, which readers skip; a new writer removes it, so
    that the records after it are found.
    """

    def __init__(self, path: str) -> None:
        self._lock = threading.Lock()
        self._file = open(path, "a+b", buffering=0)  # noqa: SIM115
        self._file.truncate(self._whole())

    def _whole(self) -> int:
        """Where the last whole record ends."""
        size, at = self._file.seek(0, os.SEEK_END), 0
        while at + RECORD.size <= size:
            self._file.seek(at)
            after = at + RECORD.size + RECORD.unpack(self._file.read(RECORD.size))[2]
            if after > size:
                break
            at = after
        return at

    def append(self, partition: int, offset: int, value: bytes) -> None:
        with self._lock:
            left = memoryview(packed(partition, offset, value))
            while left:
                left = left[self._file.write(left) :]
            os.fsync(self._file.fileno())

    def close(self) -> None:
        with self._lock:
            self._file.close()

    def __enter__(self) -> Spool:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """`partition`, `offset`, `value` of all spool files under a path."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = list(records(content.as_py()))
                if rows:
                    p, o, v = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(o, pa.int64()), pa.array(v, pa.binary())], names=["partition", "offset", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "partition int, offset long, value binary")
