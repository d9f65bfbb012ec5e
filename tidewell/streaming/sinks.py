"""Envelopes, their reading back, and the idempotent tick table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.schemas import TICK
from tidewell.sources.store import stored

INSERT, DELETE, TRUNCATE = "insert", "delete", "truncate"


def envelope(rows: DataFrame, kind: str, fields: list[str], keep: list[str] | None = None, now_ms=None) -> DataFrame:
    """`type`, `data` (JSON of the fields), and `ts` in milliseconds if a column for it is given."""
    extra = [now_ms.cast("long").alias("ts")] if now_ms is not None else []
    return rows.select(*(keep or []), F.lit(kind).alias("type"), *extra, F.to_json(F.struct(*fields)).alias("data"))


def as_messages(envelopes: DataFrame) -> DataFrame:
    """`value`: the envelopes as JSON texts with `data` as an object."""
    body = F.concat(F.lit('{"type":'), F.to_json(F.array("type")).substr(F.lit(2), F.length(F.to_json(F.array("type"))) - 2), F.lit(',"ts":'), F.col("ts").cast("string"), F.lit(',"data":'), "data", F.lit("}"))
    return envelopes.select(body.alias("value"))


def demux(messages: DataFrame, kind: str = "win_tick") -> DataFrame:
    """The ticks in `value` texts; other types, broken envelopes and broken ticks are skipped."""
    e = messages.select(F.from_json(F.col("value").cast("string"), "type string, ts long, data string").alias("e")).where(F.col("e.type") == kind)
    tick = F.from_json("e.data", T.StructType([*TICK.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    zero = lambda c, v: F.coalesce(F.col(f"t.{c}"), F.lit(v)).alias(c)
    good = e.select(tick.alias("t")).where("t is not null and t._bad is null")
    return good.select(zero("win_idx", 0), zero("head", 0).cast("long").alias("head"), zero("tail", 0).cast("long").alias("tail"), zero("open_win", False))


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key, the last by `order` (an aggregation, so a hot key combines early)."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_l"))
    return last.select(*key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def differences(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """`op` and the rows that turn the keyed table `before` into `after`: `delete` for keys that are
    gone, `insert` for keys that are new or hold other values."""
    rest = [c for c in after.columns if c not in key]
    old = before.select(*key, F.struct(*rest).alias("_old"), F.lit(True).alias("_had"))
    new = after.select(*key, F.struct(*rest).alias("_new"), F.lit(True).alias("_has"))
    both = old.join(new, key, "full").where(F.col("_has").isNull() | F.col("_had").isNull() | ~F.col("_old").eqNullSafe(F.col("_new")))
    kept = F.when(F.col("_has").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return both.select(F.when(F.col("_has").isNull(), DELETE).otherwise(INSERT).alias("op"), *key, kept.alias("_k")).select("op", *key, *[F.col("_k")[c].alias(c) for c in rest])


def applied(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The keyed table after changes of one `op` a key."""
    kept = table.join(changes.select(*key), key, "left_anti")
    return kept.unionByName(changes.where(F.col("op") == INSERT).select(*table.columns))


class TickTable:
    """A keyed table of ticks as a log of batches: `upsert` writes its batch alone.

    Heads and tails count from where a run began, and a run numbers its batches from 0, so each run
    has a log of its own below the table's folder (`run_id`; by default the folder itself).  A
    batch's folder appears under its number by a rename when it is complete, so a batch that is run again changes nothing, and one that fails
    leaves nothing.  A reader keeps the last row of each key: that of the latest block, if blocks
    are given, else of the latest batch, within a batch the last by `seq`; what is deleted is gone.  `compact` folds the
    log into one folder and deletes what that replaces.  One writer at a time.
    """

    KEY = ("win_idx", "head", "tail")
    EXTRA = (("number", T.LongType(), None), ("deleted", T.BooleanType(), False))
    SCHEMA = T.StructType([*TICK.fields, *[T.StructField(n, k) for n, k, _ in EXTRA], T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType())])

    def __init__(self, spark: SparkSession, path: str, run_id: str = "") -> None:
        if not re.fullmatch(r"[\w.-]*", run_id):
            raise ValueError("a run's id is a folder's name")
        self.spark, self.path = spark, path.rstrip("/") + (f"/run={run_id}" if run_id else "")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda name: hadoop.Path(f"{self.path}/{name}" if name else self.path)
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[tuple[int, str]]:
        """(batch, folder) of the last compaction and all batches after it; of a batch and a
        compaction up to it the compaction counts."""
        if not self._fs.exists(self._at("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))]
        found = sorted((int(n.partition("-")[2]), n) for n in names if n.startswith(("base-", "batch-")))
        base = max((k for k, n in found if n.startswith("base-")), default=-1)
        return [(k, n) for k, n in found if k > base or n == f"base-{k}"]

    def ensure_schema(self) -> None:
        """Makes the table's folder, if it is not there."""
        self._fs.mkdirs(self._at(""))

    def _log(self) -> DataFrame:
        out = self.spark.createDataFrame([], self.SCHEMA).withColumn("batch", F.lit(0).cast("long"))
        for k, name in self.batches():
            out = out.union(self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{name}").withColumn("batch", F.lit(k).cast("long")))
        return out.withColumn("last", F.struct("batch", "seq"))

    def _live(self) -> DataFrame:
        """The last row of each key and block, if it is no deletion.  Blocks without transfers have one key;
        when the later of them is cut, the earlier one's tick is there again."""
        return keep_last(self._log(), [*self.KEY, "number"], "last").where("not deleted")

    def rows(self) -> DataFrame:
        """One row for each key, with its block's `number` (if it was given) and `ts`, the time of its
        last upsert."""
        latest = F.struct(F.coalesce("number", F.lit(-1)).alias("number"), "last")
        return keep_last(self._live().withColumn("last", latest), list(self.KEY), "last").drop("last", "batch", "deleted", "seq")

    def read(self) -> DataFrame:
        return self.rows().select("win_idx", "head", "tail", "open_win")

    def _publish(self, rows: DataFrame, name: str) -> None:
        part = f"_part-{uuid.uuid4().hex}"
        rows.select(*self.SCHEMA.fieldNames()).write.parquet(f"{self.path}/{part}")
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(part), self._at(name)):
            self._fs.delete(self._at(part), True)

    def _without_truncated(self, rows: DataFrame, cuts: DataFrame) -> DataFrame:
        """The rows, and a deletion for every key that a truncation voids: of the rows before it in
        the batch, and of those in the table."""
        # a key is void if some later truncation keeps less: of those after a row the least counts
        least = cuts.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("at"), F.col("number").alias("keep")))).alias("_cuts"))  # one row, of one batch
        ours = rows.withColumn("deleted", F.lit(False))
        known = ours.unionByName(self._live().withColumn("seq", F.lit(-1).cast("long")).select(*ours.columns))
        hit = F.filter("_cuts", lambda c: (c["keep"] < F.col("number")) & (c["at"] > F.col("seq")))
        void = known.join(F.broadcast(least)).withColumn("_at", F.array_max(F.transform(hit, lambda c: c["at"]))).where("_at is not null")
        gone = void.groupBy(*self.KEY, "number").agg(F.max("_at").alias("seq"), F.first("open_win").alias("open_win"))
        return ours.unionByName(gone.withColumn("deleted", F.lit(True)))

    def upsert(self, batch: DataFrame, number: int | None = None, seq: str | None = None) -> None:
        """Inserts the batch's keys, or updates them.  number: the batch's (by default the next one);
        one that is there already is not written again.  seq: a column that orders rows of one
        key, by default their order in the batch's partitions.

        A batch with `op` and `number` holds changes (see `ticks.live_changes`): `truncate` deletes the
        ticks of blocks above its number that come before it.  Such a batch is written first, as
        a stateful stream must be computed once.
        """
        done = [k for k, _ in self.batches()]
        if number is None:
            number = max(done, default=-1) + 1
        elif number in done or number <= max((k for k, n in self.batches() if n.startswith("base-")), default=-1):
            return
        order = F.col(seq).cast("long") if seq else F.monotonically_increasing_id()
        extra = [F.col(n) if n in batch.columns else F.lit(v).cast(k).alias(n) for n, k, v in self.EXTRA]
        rows = batch.select("win_idx", "head", "tail", "open_win", *extra, order.alias("seq"), *(["op"] if "op" in batch.columns else []))
        if "op" in rows.columns:
            rows = stored(rows)
            cuts, rows = rows.where(F.col("op") == TRUNCATE), rows.where(F.col("op") != TRUNCATE).drop("op")
            if not cuts.isEmpty():
                rows = self._without_truncated(rows, cuts)
        self._publish(keep_last(rows, [*self.KEY, "number"], "seq").withColumn("ts", F.current_timestamp()), f"batch-{number}")

    def compact(self) -> None:
        """Folds all batches into one folder; readers that began before must be done."""
        old = self.batches()
        if len(old) < 2:
            return
        last = old[-1][0]
        self._publish(self._live(), f"base-{last}")
        for _, name in old:
            self._fs.delete(self._at(name), True)


def upsert_into(table: TickTable, compact_every: int = 100) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`.  Of rows of one key the last by `seq` counts, else the one of the
    highest block `number`, if the batch has such a column."""

    def run(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number, next((c for c in ("seq", "number") if c in batch.columns), None))
        if number % compact_every == compact_every - 1:
            table.compact()

    return run
