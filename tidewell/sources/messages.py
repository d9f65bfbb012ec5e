"""Block messages: from files or Kafka to rows, and back.

Kafka needs its connector on the class path; the readers only set options, so every step
after them also runs on files of the same messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.schemas import BLOCK
from tidewell.sources.offsets import kafka_offsets, starting_offsets

REPLAY_SECONDS = 86_400


def kafka_options(servers: str, topic: str, since_ms: int | None = None, per_batch: int | None = 8192, group: str | None = None, offsets: str | None = None) -> dict[str, str]:
    """Options of a source that starts at `offsets` (JSON, see `sources.offsets`), else at messages that
    the broker took in `since_ms` or later, else at the earliest offset."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "failOnDataLoss": "true"}
    out |= {"startingOffsets": offsets} if offsets is not None else {"startingTimestamp": str(since_ms), "startingOffsetsByTimestampStrategy": "latest"} if since_ms is not None else {"startingOffsets": "earliest"}
    if per_batch:
        out["maxOffsetsPerTrigger"] = str(per_batch)
    if group:
        out["kafka.group.id"] = group
    return out


def producer_options(servers: str, topic: str) -> dict[str, str]:
    """Acknowledged by all replicas, idempotent, in order."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.max.in.flight.requests.per.connection": "1", "kafka.retries": "10"}


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(**options)).load()


def replay_kafka(spark: SparkSession, servers: str, topic: str, now: int, seconds: int = REPLAY_SECONDS, index: DataFrame | None = None, **more) -> DataFrame:
    """A stream that begins `seconds` before `now`.

    index: the topic's time index (`sources.offsets`): the stream begins at the first block of that
    time, whatever the broker's clock said.  Without one the broker's time decides: a message that
    Spark's writer sent has the time at which it was sent, as that writer sets none.
    """
    since = max(now - seconds, 0)
    if index is None:
        return read_kafka(spark, servers=servers, topic=topic, since_ms=since * 1000, **more)
    return read_kafka(spark, servers=servers, topic=topic, offsets=kafka_offsets(topic, starting_offsets(index, since)), **more)


def write_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    """A writer, not started, of `key` (if there) and `value` to a topic; what is acknowledged is in the
    checkpoint, so a restart goes on from there.  Spark's writer sends no message time: a block's
    time is in its value, and a reader that starts by it needs the index of `sources.offsets`."""
    columns = [F.col(c).cast("string").alias(c) for c in ("key", "value") if c in messages.columns]
    return messages.select(*columns).writeStream.format("kafka").options(**producer_options(servers, topic)).option("checkpointLocation", checkpoint).outputMode("append")


def watch(messages: DataFrame, rows: int = 20):
    """A writer, not started, that prints messages as they come: place and text."""
    shown = messages.select(*[c for c in ("partition", "offset") if c in messages.columns], F.col("value").cast("string").alias("value"))
    return shown.writeStream.format("console").option("truncate", "false").option("numRows", rows).outputMode("append")


def read_files(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of JSON lines with `partition`, `offset` and `value`."""
    return spark.readStream.schema("partition int, offset long, value string").option("maxFilesPerTrigger", files_per_batch).json(path)


def _place(messages: DataFrame) -> list[str]:
    return [c for c in ("partition", "offset") if c in messages.columns]


def decode(messages: DataFrame, base: int = 0) -> DataFrame:
    """`offset`, `block` (and `partition`) of messages from offset `base` on; what is no block is dropped,
    missing numbers are 0 and missing lists are empty."""
    schema = T.StructType([*BLOCK.fields, T.StructField("_bad", T.StringType())])
    b = messages.where(F.col("offset") >= base).select(*_place(messages), F.from_json(F.col("value").cast("string"), schema, {"columnNameOfCorruptRecord": "_bad"}).alias("block"))
    return b.where("block is not null and block._bad is null")


def block_rows(decoded: DataFrame) -> DataFrame:
    """`offset` (and `partition`), `number`, `ts`, `n_tx`, `hash`, `txs` of decoded messages."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    txs = F.coalesce(F.col("block.txs"), F.array().cast(BLOCK["txs"].dataType))
    return decoded.select(*_place(decoded), z("block.header.number").alias("number"), z("block.header.timestamp").alias("ts"), F.size(txs).cast("long").alias("n_tx"), F.col("block.hash").alias("hash"), txs.alias("txs"))


def first_seen(messages: DataFrame) -> DataFrame:
    """`partition`, `offset`: the first offset of each partition."""
    return messages.groupBy("partition").agg(F.min("offset").alias("offset"))


def encode(blocks: DataFrame) -> DataFrame:
    """`key`, `value`, `timestamp` of the messages for blocks with `header`, `hash` and `txs`."""
    return blocks.select(F.col("header.number").cast("string").alias("key"), F.to_json(F.struct("header", "hash", "txs")).alias("value"), F.timestamp_seconds("header.timestamp").alias("timestamp"))
