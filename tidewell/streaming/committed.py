"""A streaming sink whose batches appear whole, as a Spark data source with task messages and commits.

    spark.dataSource.register(CommittedSink)
    rows.writeStream.format("committed").option("path", folder).option("checkpointLocation", ...).start()
    read_committed(spark, folder, rows.schema)

Each task writes a Parquet file of its own and answers with its name.  When all tasks of a batch have
answered, the driver publishes the names in one small file, by a rename; a reader takes only the
files that such a list names.  So a task that is killed or runs twice, and a batch that fails,
leave nothing that is read, and a batch that is run again after its commit is dropped: one copy,
whatever is lost.  Rows pass from tasks to files, never through the driver.

`run` (an option) tells writers of one folder apart that number their batches each from 0.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

DATA = "data"
LIST = "run string, batch long, file string, n_rows long"


@dataclass
class Written(WriterCommitMessage):
    """A task's file (none if it had no rows)."""

    file: str | None
    n_rows: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; without a scheme it is a local one."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str, run: str) -> None:
        self.path, self.run = path.rstrip("/"), run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        name, writer, n = f"part-{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if writer is None:
                    store.create_dir(f"{root}/{DATA}", recursive=True)
                    writer = pq.ParquetWriter(f"{root}/{DATA}/{name}", batch.schema, filesystem=store)
                writer.write_batch(batch)
                n += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if writer is not None else None, n)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        store, root = opened(self.path)
        name = f"{root}/commit-{self.run}-{batchId}.json"
        if store.get_file_info(name).type != fs.FileType.NotFound:  # it was committed before a crash
            self.abort(messages, batchId)
            return
        rows = [{"run": self.run, "batch": batchId, "file": m.file, "n_rows": m.n_rows} for m in messages if m is not None and m.file]
        store.create_dir(root, recursive=True)
        part = f"{root}/_commit-{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        store.move(part, name)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, root = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                store.delete_file(f"{root}/{DATA}/{m.file}")


class CommittedSink(DataSource):
    """The sink `committed`; options `path` and `run`."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def streamWriter(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        if overwrite:
            raise ValueError("batches are appended")
        run = self.options.get("run", "")
        if not re.fullmatch(r"\w*", run):
            raise ValueError("a run is named by letters, digits and underscores")
        return CommittedWriter(self.options["path"], run)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """`run`, `batch`, `file`, `n_rows` of every file that a batch has published."""
    return spark.read.schema(LIST).option("pathGlobFilter", "commit-*.json").json(path)


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that were committed."""
    listed = commits(spark, path).select(F.col("file").alias("_file"))
    rows = spark.read.schema(schema).parquet(f"{path}/{DATA}")
    columns = rows.columns
    return rows.withColumn("_file", F.col("_metadata.file_name")).join(listed, "_file", "left_semi").select(*columns)
