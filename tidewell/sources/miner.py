"""A live source of blocks: one is mined at each tick of the clock.

    spark.dataSource.register(MinerSource)
    spark.readStream.format("chain_miner").option("tick", 1).load()

Rows are `number`, `ts`; `generator.transfers` and `generator.block_messages` fill them.  Times are
whole seconds and strictly increase, also when the clock stands still or goes back: a block is
never earlier than one second after the last.  The place in the stream is (height, time), so a
batch that is run again has the same blocks.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class MinerReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, clock=time.time) -> None:
        self.tick, self.clock = float(options.get("tick", 1)), clock
        self.start = {"number": int(options.get("head", 0)), "ts": int(options.get("ts", 0))}
        self.mined_at: float | None = None

    def initialOffset(self) -> dict:
        return self.start

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        """At most one block for each tick of the clock; it follows the one before by a second at least."""
        now = self.clock()
        if self.mined_at is not None and abs(now - self.mined_at) < self.tick:
            return iter(()), start
        self.mined_at = now
        end = {"number": start["number"] + 1, "ts": max(int(now), start["ts"] + 1)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        n = end["number"] - start["number"]
        return iter([(start["number"] + k, end["ts"] - (n - k)) for k in range(1, n + 1)])

    def commit(self, end: dict) -> None:
        pass


class MinerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chain_miner"

    def schema(self) -> str:
        return "number long, ts long"

    def simpleStreamReader(self, schema) -> MinerReader:
        return MinerReader(self.options)
