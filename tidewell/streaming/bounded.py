"""Streams whose state is bounded by event time: replays, sessions and tumbling windows.

The event time is the block's.  The watermark follows the latest one by `delay` seconds; a row
behind it is late and dropped, and Spark counts it (`late_rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELAY = 86_400


def timed(rows: DataFrame, delay: int = DELAY) -> DataFrame:
    """The rows with `at`, the event time of `ts`, under a watermark."""
    return rows.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{delay} seconds")


def without_replays(blocks: DataFrame, delay: int = DELAY) -> DataFrame:
    """A stream of blocks in which a height that comes again is dropped.  A height is remembered for `delay`
    seconds of block time, so the state holds that much and no more; a replay from before that is
    late, and dropped as such."""
    return timed(blocks, delay).dropDuplicatesWithinWatermark(["number"]).drop("at")


def live_sessions(events: DataFrame, gap: int, delay: int = DELAY) -> DataFrame:
    """`from_id`, `start`, `end`, `n_tx`, `amount` of each session of a sender when the watermark has passed
    its end; as `graph.sender_sessions` gives them for a table."""
    found = timed(events, delay).groupBy("from_id", F.session_window("at", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n_tx"), F.sum("amount").alias("amount"))
    return found.select("from_id", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n_tx", "amount")


def live_windows(events: DataFrame, width: int, delay: int = DELAY) -> DataFrame:
    """`from_id`, `start`, `n_tx`, `amount` of each sender and tumbling window that the watermark has passed;
    as `graph.sender_windows`."""
    found = timed(events, delay).groupBy("from_id", F.window("at", f"{width} seconds").alias("w")).agg(F.count("*").alias("n_tx"), F.sum("amount").alias("amount"))
    return found.select("from_id", F.unix_seconds("w.start").alias("start"), "n_tx", "amount")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, over the query's recent batches."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query: StreamingQuery) -> list[int]:
    """Rows of state after each of the query's recent batches."""
    return [sum(int(s["numRowsTotal"]) for s in p["stateOperators"]) for p in query.recentProgress]
