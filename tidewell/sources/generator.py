"""Synthetic chains: addresses, transfers and blocks, the same for the same seed.

Every draw is a SHA-256 of (seed of a named stream, position), so any partition can make its
rows alone, a repeated task makes the same rows, and any SQL engine can check them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import encoding as E

TOKEN, SELF_LOOPS, LEAST_TX, SPREAD_TX, MAX_AMOUNT = "MOCK", 0.1, 50, 50, 1000


def stream_seed(base: int, name: str) -> int:
    """Seed of a named stream: the 64-bit FNV-1a hash of the name, combined with the base."""
    h = 0xCBF29CE484222325
    for byte in name.encode():
        h = (h ^ byte) * 0x100000001B3 % 2**64
    h ^= base % 2**64
    return h - 2**64 if h >= 2**63 else h


def draw(base: int, name: str, *at: Column) -> Column:
    """A number from 0 to 2**52 - 1 for a position of a named stream."""
    text = F.concat_ws(":", F.lit(str(stream_seed(base, name))), *[c.cast("string") for c in at])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def address(seed: int, k: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(F.sha2(F.concat_ws(":", F.lit(str(stream_seed(seed, "addr"))), k.cast("string")), 256), 1, 40))


def addresses(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """`k`, `addr`: n addresses of 20 bytes."""
    return spark.range(n).select(F.col("id").alias("k"), address(seed, F.col("id")).alias("addr"))


def schedule(spark: SparkSession, start: int, n: int, step: int, first: int = 1) -> DataFrame:
    """`number`, `ts` of n blocks, `step` seconds apart."""
    return spark.range(n).select((F.col("id") + first).alias("number"), (F.col("id") * step + start).alias("ts"))


def transfers(blocks: DataFrame, n_addresses: int, seed: int = 1, self_loops: float = SELF_LOOPS) -> DataFrame:
    """50 to 99 transfers for each block (`number`, `ts`), a share of them from an address to itself."""
    count = (draw(seed, "tx_count", F.col("number")) % SPREAD_TX + LEAST_TX).cast("int")
    rows = blocks.select("number", "ts", F.posexplode(F.sequence(F.lit(1), count)).alias("p", "_n")).select("number", "ts", F.col("p").cast("long").alias("pos"))
    at = (F.col("number"), F.col("pos"))
    src = draw(seed, "from", *at) % n_addresses
    other = (src + 1 + draw(seed, "to", *at) % max(1, n_addresses - 1)) % n_addresses
    looped = draw(seed, "choose", *at) / float(2**52) < self_loops
    return rows.select(
        "number", "ts", "pos",
        address(seed, src).alias("sender"),
        address(seed, F.when(looped, src).otherwise(other)).alias("receiver"),
        F.lit(TOKEN).alias("token"),
        (draw(seed, "amount", *at) % MAX_AMOUNT + 1).alias("amount"),
        draw(seed, "nonce", *at).alias("nonce"),
    )


def block_messages(blocks: DataFrame, txs: DataFrame, seed: int = 1) -> DataFrame:
    """`number`, `ts`, `header`, `hash`, `txs` as on the wire.

    A block's hash takes its parent's, so the chain of hashes is folded in one task, over the
    headers alone.
    """
    h = E.tx_hash(F.col("sender"), F.col("receiver"), F.col("token"), F.col("amount"), F.col("ts"), F.col("nonce"))
    body = F.struct(F.col("sender").alias("from"), F.col("receiver").alias("to"), "token", "amount", F.col("ts").alias("timestamp"))
    listed = txs.withColumn("h", h).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("pos", "h", body.alias("body")))).alias("l"))
    rows = blocks.join(listed, "number", "left").withColumn("l", F.coalesce("l", F.array().cast(listed.schema["l"].dataType)))
    rows = rows.select("number", "ts", E.tx_root(F.transform("l", lambda x: x["h"])).alias("root"), F.transform("l", lambda x: F.struct(F.concat(F.lit("0x"), x["h"]).alias("hash"), x["body"].alias("tx_body"), F.col("number").alias("block_num"))).alias("txs"))

    def fold(frame):
        import hashlib

        frame, parent, out = frame.sort_values("number"), "00" * 32, []
        for number, ts, root, nonce in zip(frame["number"], frame["ts"], frame["root"], frame["nonce"], strict=True):
            raw = int(number).to_bytes(8, "big", signed=True) + int(ts).to_bytes(8, "big", signed=True) + bytes.fromhex(parent) + bytes.fromhex(root) + int(nonce).to_bytes(8, "big", signed=True)
            own = hashlib.sha256(raw).hexdigest()
            out.append(("0x" + parent, "0x" + own))
            parent = own
        return frame[["number"]].assign(parent_hash=[p for p, _ in out], hash=[o for _, o in out])

    headers = rows.select("number", "ts", "root", draw(seed, "block_nonce", F.col("number")).alias("nonce"), F.lit(0).alias("chain"))
    chained = headers.groupBy("chain").applyInPandas(fold, "number long, parent_hash string, hash string")
    joined = rows.join(chained, "number")
    header = F.struct("number", "parent_hash", F.col("ts").alias("timestamp"), F.concat(F.lit("0x"), "root").alias("tx_root"))
    return joined.select("number", "ts", header.alias("header"), "hash", "txs")
