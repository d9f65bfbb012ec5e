"""Blocks and transfers derived from the `events` table: one block for each 600 s with events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import encoding as E
from tidewell.plans.prefix import with_prefix

BUCKET = 600


def _hex_address(c):
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 40, "0"))


def transfers(spark: SparkSession, sf_dir: str, bucket: int = BUCKET) -> DataFrame:
    """Raw transfers: `ts` of the block, `pos` in it, `sender`, `receiver`, `token`, `amount`, `nonce`."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value", "props")
    block_ts = (F.floor(F.unix_seconds("at") / bucket) * bucket).cast("long")
    in_block = Window.partitionBy("ts").orderBy("at", "event_id")
    return e.select(
        block_ts.alias("ts"),
        "at",
        "event_id",
        _hex_address(F.col("user_id")).alias("sender"),
        _hex_address(F.get_json_object("props", "$.k").cast("long")).alias("receiver"),
        F.col("event_type").alias("token"),
        F.round(F.col("value") * 100).cast("long").alias("amount"),
    ).select("ts", (F.row_number().over(in_block) - 1).cast("long").alias("pos"), "sender", "receiver", "token", "amount", F.col("event_id").alias("nonce"))


def blocks(spark: SparkSession, sf_dir: str, bucket: int = BUCKET) -> DataFrame:
    """`number` (from 1), `ts`, `n_tx`, `head`, `rel` (transfers up to and before the block) and `hash`."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket) * bucket).cast("long").alias("ts"))
    counted = e.groupBy("ts").agg(F.count("*").alias("n_tx"))
    out = with_prefix(counted, "ts", {"number": F.lit(1), "head": F.col("n_tx")})
    return out.select("number", "ts", "n_tx", "head", (F.col("head") - F.col("n_tx")).alias("rel"), F.concat(F.lit("0x"), E.sha256_hex(F.concat(E.be64(F.col("number")), E.be64(F.col("ts"))))).alias("hash"))
