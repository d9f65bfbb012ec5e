"""Dense ids in a stream, and the log of encoded transfers it gives.

A micro-batch of blocks is put in order, its transfers are numbered on from those before, names not
seen yet get the next ids in the order of first sight, and the batch's names and encoded transfers are
published under its number.  A log's marks hold what the next batch goes on from: the last height, the
transfers so far, the highest id of each kind.  So the ids are those of `dictionary.dictionaries` over
the whole chain for any split into batches, and a restart goes on where the last complete batch
ended: names first, then transfers, each published once.

Work of a batch: its own transfers, and a join of its distinct names with the table of names, for
which Catalyst broadcasts the batch's names while they are few, so the table is scanned and not
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import dictionary
from tidewell.plans.prefix import with_prefix
from tidewell.plans.windows import in_order
from tidewell.sources.batches import BatchLog
from tidewell.sources.store import drop, scratch, stored

NAMES = "kind int, name string, id long"
EVENTS = "idx long, ts long, from_id long, to_id long, token_id int, amount long"
BLOCKS = ("offset", "number", "ts", "n_tx", "txs")


class EventLog:
    """Encoded transfers and their dictionary below `path`, by batch."""

    def __init__(self, spark: SparkSession, path: str, drop_bad_address: bool = True, drop_no_token: bool = False) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.names, self.sent = BatchLog(spark, f"{self.path}/names"), BatchLog(spark, f"{self.path}/events")
        self.rules = drop_bad_address, drop_no_token

    def dictionaries(self) -> tuple[DataFrame, DataFrame]:
        """(`addr`, `id`) and (`tok`, `id`) of all names so far."""
        ids = self.names.read(NAMES)
        return (
            ids.where(F.col("kind") == dictionary.ADDRESS).select(F.col("name").alias("addr"), "id"),
            ids.where(F.col("kind") == dictionary.TOKEN).select(F.col("name").alias("tok"), F.col("id").cast("int").alias("id")),
        )

    def events(self) -> DataFrame:
        return self.sent.read(EVENTS)

    def stream(self, per_batch: int | None = None) -> DataFrame:
        """The encoded transfers as a stream, for `graph.live_graph`."""
        return self.sent.stream(EVENTS, per_batch)

    def _flattened(self, blocks: DataFrame, last: int, total: int, folder: str) -> tuple[DataFrame, int, int]:
        """The batch's transfers, numbered on from `total`, and the new last height and total."""
        known = stored(in_order(blocks.where(F.col("number") > last).select(*BLOCKS[:4])), folder)
        end, more = known.agg(F.max("number"), F.sum("n_tx")).first()
        head = with_prefix(known, "number", {"head": F.col("n_tx")})
        rel = head.select("number", "offset", (F.col("head") - F.col("n_tx") + total).alias("rel"))
        header = F.struct("number", F.col("ts").alias("timestamp")).alias("header")
        rows = blocks.join(rel, ["number", "offset"]).select(header, "txs", "rel")
        return dictionary.flatten_json(rows), last if end is None else end, total + (more or 0)

    def append(self, batch: DataFrame, number: int) -> None:
        """Takes a batch of `messages.block_rows`, of one partition or in order of height."""
        done = self.sent.batches()
        if number in done:
            return
        last, total, addresses, tokens = done[max(done)] if done else (0, 0, 0, 0)
        folder = scratch(self.spark, "encode")
        blocks = stored(batch.select(*BLOCKS), folder)
        flat, last, total = self._flattened(blocks, last, total, folder)
        flat = stored(flat, folder)
        if number not in self.names.batches():  # else the last attempt came this far
            first = dictionary.first_sight(flat, drop_bad_address=self.rules[0])
            known = self.names.read(NAMES).select("kind", "name")
            ids = dictionary.numbered(stored(first.join(known, ["kind", "name"], "left_anti"), folder))
            base = F.when(F.col("kind") == dictionary.ADDRESS, addresses).otherwise(tokens)
            self.names.publish(ids.select(F.col("kind").cast("int").alias("kind"), "name", (F.col("id") + base).alias("id")), number)
        new = self.spark.read.schema(NAMES).parquet(self.names.folder(number))
        top = {r["kind"]: r["id"] for r in new.groupBy("kind").agg(F.max("id").alias("id")).collect()}
        marks = (last, total, top.get(dictionary.ADDRESS, addresses), top.get(dictionary.TOKEN, tokens))
        encoded = dictionary.encoded(flat, *self.dictionaries(), *self.rules)
        self.sent.publish(encoded.select(*[x.split()[0] for x in EVENTS.split(", ")]), number, marks)
        drop(self.spark, folder)


def encode_into(log: EventLog) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`."""
    return log.append
