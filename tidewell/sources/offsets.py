"""Where a topic's blocks are by their time: an index kept beside the stream, and starts looked up in it.

A row for each block message: partition, offset, height and block time.  The stream that writes or
reads the topic keeps the index up (`index_into`); a replay asks it for the first offset of every
partition that holds a block of some time or later.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.batches import BatchLog

INDEX = "partition int, offset long, number long, ts long"
LATEST = -1


def time_index(blocks: DataFrame) -> DataFrame:
    """The index rows of decoded block messages (`messages.block_rows`) with their `partition`."""
    return blocks.select(F.col("partition").cast("int").alias("partition"), "offset", "number", "ts")


def index_into(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch` on block rows: appends their index rows, once for each batch."""
    log = BatchLog(spark, path)

    def run(batch: DataFrame, number: int) -> None:
        log.publish(time_index(batch).sortWithinPartitions("ts"), number)

    return run


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return BatchLog(spark, path).read(INDEX)


def starting_offsets(index: DataFrame, since: int) -> DataFrame:
    """`partition`, `offset`: the first message of a block at `since` or later; where there is none, the
    place after the last one known."""
    first = F.min(F.when(F.col("ts") >= since, F.col("offset")))
    return index.groupBy("partition").agg(F.coalesce(first, F.max("offset") + 1).alias("offset"))


def kafka_offsets(topic: str, starts: DataFrame) -> str:
    """`startingOffsets` of a Kafka source: a number for each partition of the topic."""
    return json.dumps({topic: {str(r["partition"]): r["offset"] for r in starts.orderBy("partition").collect()}})


def from_offsets(messages: DataFrame, starts: DataFrame) -> DataFrame:
    """Messages from the starts on; a partition without one is read whole.  The starts are a row for
    each partition."""
    at = F.broadcast(starts.select(F.col("partition").alias("_p"), F.col("offset").alias("_from")))
    return messages.join(at, F.col("partition") == F.col("_p"), "left").where(F.col("_from").isNull() | (F.col("offset") >= F.col("_from"))).drop("_p", "_from")
