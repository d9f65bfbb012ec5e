"""Blocks of several partitions in the order of their heights.

A partition orders its own blocks only, so heights arrive mixed.  A buffer in keyed state holds the
blocks above the next height; when that comes, it and all that follow without a hole go on.  A
height that does not come within `wait` seconds is given up by a timer: the order goes on from
the lowest one held, and if the missing block comes after all it is dropped as a replay.  Only
blocks' headers pass here, not their transfers; the buffer holds what is ahead of a hole, each
block an entry of a map.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "offset long, number long, ts long, n_tx long"
WAIT = 60


class Buffer:
    """Blocks ahead of a hole.  held: a mapping of height -> (ts, n_tx); a `MapState` is wrapped by
    the processor."""

    def __init__(self, held: Any, next_: int | None) -> None:
        self.held, self.next = held, next_

    def add(self, number: int, ts: int, n_tx: int) -> None:
        """The first block of a height counts, and none that is below what has gone on."""
        if (self.next is None or number >= self.next) and number not in self.held:
            self.held[number] = (ts, n_tx)

    def ready(self) -> list[tuple[int, int, int, int]]:
        """The rows that can go on."""
        out = []
        while self.next is not None and self.next in self.held:
            out.append((self.next, self.next, *self.held.pop(self.next)))
            self.next += 1
        return out

    def skip(self) -> None:
        """Gives up the heights below the lowest one held."""
        self.next = min(self.held, default=self.next)


class _Held:
    """The mapping of `Buffer` over a MapState; its heights are read once a batch."""

    def __init__(self, state: Any) -> None:
        self.state = state
        self.heights = {int(k[0]) for k in state.keys()} if state.exists() else set()

    def __contains__(self, number: int) -> bool:
        return number in self.heights

    def __iter__(self) -> Iterator[int]:
        return iter(self.heights)

    def __len__(self) -> int:
        return len(self.heights)

    def __setitem__(self, number: int, value: tuple[int, int]) -> None:
        self.heights.add(number)
        self.state.updateValue((number,), value)

    def pop(self, number: int) -> tuple[int, int]:
        value = tuple(map(int, self.state.getValue((number,))))
        self.heights.remove(number)
        self.state.removeKey((number,))
        return value


class OrderProcessor(StatefulProcessor):
    def __init__(self, start: int | None, wait: int) -> None:
        self.start, self.wait = start, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, deadline long")
        self.held = handle.getMapState("held", "number long", "ts long, n_tx long")

    def _state(self) -> tuple[Buffer, int]:
        next_, deadline = map(int, self.place.get()) if self.place.exists() else (-1 if self.start is None else self.start, 0)
        return Buffer(_Held(self.held), None if next_ < 0 else next_), deadline

    def _given(self, buffer: Buffer, deadline: int, rows: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        if deadline and (rows or not len(buffer.held)):  # what it waited for has come
            self.handle.deleteTimer(deadline)
            deadline = 0
        if len(buffer.held) and not deadline:
            deadline = now + self.wait * 1000
            self.handle.registerTimer(deadline)
        self.place.update((-1 if buffer.next is None else buffer.next, deadline))
        yield pd.DataFrame(rows, columns=["offset", "number", "ts", "n_tx"], dtype="int64")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        buffer, deadline = self._state()
        batch = pd.concat(list(rows)).sort_values(["number", "partition", "offset"], kind="stable")
        for number, ts, n in zip(batch["number"], batch["ts"], batch["n_tx"], strict=True):
            buffer.add(int(number), int(ts), int(n))
        yield from self._given(buffer, deadline, buffer.ready(), timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        buffer, deadline = self._state()
        if expiredTimerInfo.getExpiryTimeInMs() != deadline:
            return
        buffer.skip()
        yield from self._given(buffer, 0, buffer.ready(), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def in_height_order(blocks: DataFrame, start: int | None = 1, wait: int = WAIT) -> DataFrame:
    """`offset` (the height), `number`, `ts`, `n_tx` of a stream of `partition`, `offset`, `number`, `ts`, `n_tx`, for
    `live_ticks`.

    start: the first height; None: the lowest that has come when the first wait is over.  Needs the
    RocksDB state store.
    """
    keyed = blocks.select(F.lit(0).alias("chain"), F.col("partition").cast("long").alias("partition"), "offset", "number", "ts", "n_tx")
    return keyed.groupBy("chain").transformWithStateInPandas(OrderProcessor(start, wait), OUT, "Append", "ProcessingTime")
