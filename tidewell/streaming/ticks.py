"""Live ticks: the four trailing windows as a fold over the ordered block stream.

Heads, tails and the gate depend on all blocks before, so blocks (one small row each, not
their transfers) share one key.  Rows of a micro-batch are put in offset order, replayed
heights are skipped, and each window's tail only moves forward, so a block with an older
time never reopens a window.  State: running totals, and the blocks since the longest
window's tail as entries of a map, of which a block reads and writes its own and those a tail
passes.  Any split of the stream into batches gives the ticks of the batch query.

Offsets order one partition.  A stream of several goes through `streaming.order` first; without
that a second partition is an error, not a loss.

`live_changes` follows a chain that is cut: a truncation takes the fold back to the height kept (every
block's entry holds the totals after it, for the last `undo` blocks), and tells the sink to
delete what the cut blocks had sent.  Rows carry the run's id, as heads and tails count from where
a run began.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.plans.windows import CADENCE, DEFAULT_EVERY, WIDTHS
from tidewell.streaming.sinks import INSERT, TRUNCATE
from tidewell.streaming.state import Entries

OUT = "number long, win_idx int, head long, tail long, open_win boolean"
CHANGES = f"run_id string, seq long, op string, {OUT}"
#: Blocks that a truncation can take back.
UNDO = 1000


class WindowFold:
    """The fold itself: `step` takes a block and returns its ticks."""

    def __init__(self, widths: tuple[int, ...] = WIDTHS, cadence: tuple[int, ...] = CADENCE, blocks: Entries | None = None, undo: int = 0) -> None:
        self.widths, self.cadence, self.undo = widths, tuple(c if c > 0 else DEFAULT_EVERY for c in cadence), undo
        self.head = self.last = self.moves = self.place = 0  # place: blocks so far
        self.dropped = 0  # blocks no longer kept
        self.tails = [0] * len(widths)  # places of the windows' first blocks
        self.blocks = blocks or Entries()  # place -> number, ts, transfers before and after, moves, tails

    def load(self, state: tuple) -> None:
        self.head, self.last, self.moves, self.place, self.dropped, *tails = state
        self.tails = list(tails)

    def state(self) -> tuple:
        return (self.head, self.last, self.moves, self.place, self.dropped, *self.tails)

    def _block(self, place: int) -> list[int]:
        return [int(x) for x in self.blocks.get(place)]

    def step(self, number: int, ts: int, n_tx: int) -> list[tuple[int, int, int, int, bool]]:
        """The ticks of a block: its moves, counted from the gate on."""
        moves = self.move(number, ts, n_tx)
        if not moves or not self.moves:
            return []
        return [m for m, every in zip(moves, self.cadence, strict=True) if self.moves % every == 0]

    def move(self, number: int, ts: int, n_tx: int) -> list[tuple[int, int, int, int, bool]]:
        """The new bounds of every window; none for a height that was there."""
        if number <= self.last:
            return []
        place, rel = self.place, self.head
        self.last, self.head, self.place = number, rel + n_tx, place + 1
        first = []
        for k, width in enumerate(self.widths):
            at, start = self.tails[k], rel
            while at < place:
                _, then, start, *_ = self._block(at)
                if ts - then <= width:
                    break
                at += 1
            self.tails[k] = at
            first.append(start if at < place else rel)
        opened = self.tails[max(range(len(self.widths)), key=lambda k: self.widths[k])] != 0
        self.moves += bool(opened or self.moves)
        self.blocks.put((place,), (number, ts, rel, self.head, self.moves, *self.tails))
        return [(number, k, self.head, tail, opened) for k, tail in enumerate(first)]

    def prune(self) -> None:
        """Forgets the blocks before every window's tail, as it was `undo` blocks ago."""
        back = self.place - 1 - self.undo
        first = min(self.tails) if not self.undo else min(self._block(back)[5:]) if back >= self.dropped else 0
        for place in range(self.dropped, first):
            self.blocks.put((place,), None)
        self.dropped = max(first, self.dropped)

    def truncate(self, keep: int) -> bool:
        """Back to the state after height `keep`; False if no block is above it."""
        if keep >= self.last:
            return False
        place = self.place - 1
        while place >= self.dropped and self._block(place)[0] > keep:
            self.blocks.put((place,), None)
            place -= 1
        if place >= self.dropped and place >= self.place - 1 - self.undo:
            self.last, _, _, self.head, self.moves, *self.tails = self._block(place)
        elif place < 0 == self.dropped:
            self.head = self.last = self.moves = 0
            self.tails = [0] * len(self.widths)
        else:
            raise ValueError(f"a truncation to {keep} takes back more than {self.undo} blocks: begin a new run")
        self.place = place + 1
        return True


class TickProcessor(StatefulProcessor):
    """run_id: with one, rows are changes and the stream may hold truncations."""

    def __init__(self, widths: tuple[int, ...] = WIDTHS, cadence: tuple[int, ...] = CADENCE, every_move: bool = False, run_id: str | None = None, undo: int = 0) -> None:
        self.widths, self.cadence, self.every_move, self.run_id, self.undo = widths, cadence, every_move, run_id, undo

    def init(self, handle: StatefulProcessorHandle) -> None:
        tails = [f"t{k}" for k in range(len(self.widths))]
        names = ["head", "last", "moves", "place", "dropped", *tails, "source"]
        self.totals = handle.getValueState("totals", ", ".join(f"{n} long" for n in names))
        self.blocks = handle.getMapState("blocks", "place long", ", ".join(f"{n} long" for n in ["number", "ts", "rel", "head", "moves", *tails]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fold, source = WindowFold(self.widths, self.cadence, Entries(self.blocks), self.undo), -1
        if self.totals.exists():
            *state, source = map(int, self.totals.get())
            fold.load(tuple(state))
        batch = pd.concat(list(rows)).sort_values(["offset"], kind="stable")
        found = {int(x) for x in batch["source"]} | ({source} if source >= 0 else set())
        if len(found) > 1:
            raise ValueError(f"blocks of partitions {sorted(found)} have no common order: put the stream through in_height_order")
        taken = fold.move if self.every_move else fold.step
        out: list[tuple] = []
        for number, ts, n, offset, cut in zip(batch["number"], batch["ts"], batch["n_tx"], batch["offset"], batch["cut"], strict=True):
            if not cut:
                ticks = taken(int(number), int(ts), int(n))
                out += [(self.run_id, 2 * int(offset) + 1, INSERT, *t) for t in ticks] if self.run_id is not None else ticks
            elif fold.truncate(max(int(number), 0)):
                out.append((self.run_id, 2 * int(offset), TRUNCATE, max(int(number), 0), 0, 0, 0, False))
        fold.prune()
        fold.blocks.flush()
        self.totals.update((*fold.state(), max(found)))
        names = [x.split()[0] for x in (OUT if self.run_id is None else CHANGES).split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"number": "int64", "win_idx": "int32", "head": "int64", "tail": "int64", "open_win": "bool"} | ({"seq": "int64"} if self.run_id is not None else {}))

    def close(self) -> None:
        pass


def live_ticks(blocks: DataFrame, widths: tuple[int, ...] = WIDTHS, cadence: tuple[int, ...] = CADENCE) -> DataFrame:
    """Ticks of a stream of `offset`, `number`, `ts`, `n_tx` (and `partition`); needs the RocksDB state store."""
    return _folded(blocks, TickProcessor(widths, cadence))


def live_moves(blocks: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The bounds of every window after every block, before the gate opens too (`open_win` tells);
    the moves of `streaming.graph`."""
    return _folded(blocks, TickProcessor(widths, (1,) * len(widths), every_move=True))


def live_changes(blocks: DataFrame, run_id: str, widths: tuple[int, ...] = WIDTHS, cadence: tuple[int, ...] = CADENCE, undo: int = UNDO) -> DataFrame:
    """Ticks as changes: `run_id`, `seq`, `op` (`insert`, or `truncate`: what is above `number` is void) and
    the tick's columns.

    blocks: as for `live_ticks`, with `kind`; a row of kind `truncate` keeps the blocks up to its `number`.
    """
    return _folded(blocks, TickProcessor(widths, cadence, run_id=run_id, undo=undo))


def _folded(blocks: DataFrame, processor: TickProcessor) -> DataFrame:
    source = F.col("partition").cast("long") if "partition" in blocks.columns else F.lit(0).cast("long")
    cut = F.coalesce(F.col("kind") == TRUNCATE, F.lit(False)) if "kind" in blocks.columns else F.lit(False)
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    keyed = blocks.select(F.lit(0).alias("chain"), "offset", "number", zero("ts"), zero("n_tx"), source.alias("source"), cut.alias("cut"))
    return keyed.groupBy("chain").transformWithStateInPandas(processor, OUT if processor.run_id is None else CHANGES, "Append", "None")
