"""A table as a log of a stream's batches, each written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class BatchLog:
    """Folders `batch-<number>[-<marks>]` below a path, each with a batch's rows as Parquet.

    A folder appears by a rename when it is complete, so a batch that is run again, after a crash
    too, changes nothing.  Marks are whole numbers that the next batch goes on from: they cost no
    pass over the table.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> dict[int, tuple[int, ...]]:
        """The batches that are there, in order, with their marks."""
        if not self._fs.exists(self._at("")):
            return {}
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))]
        found = [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("batch-")]
        return {k: tuple(marks) for k, *marks in sorted(found)}

    def folder(self, number: int) -> str:
        return f"{self.path}/batch-" + "-".join(map(str, (number, *self.batches()[number])))

    def publish(self, rows: DataFrame, number: int, marks: tuple[int, ...] = ()) -> None:
        if number in self.batches():
            return
        part = f"_part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        name = "batch-" + "-".join(map(str, (number, *marks)))
        if not self._fs.rename(self._at(part), self._at(name)):
            self._fs.delete(self._at(part), True)
            raise OSError(f"{name} was not written")

    def read(self, schema: str) -> DataFrame:
        folders = [self.folder(k) for k in self.batches()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stream(self, schema: str, per_batch: int | None = None) -> DataFrame:
        """The rows as a stream, in the order in which batches appear."""
        reader = self.spark.readStream.schema(schema)
        self._fs.mkdirs(self._at(""))
        return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(f"{self.path}/batch-*")
