"""The live transfer graph: every window's edges kept by adding and evicting, and strategies over it.

Moves and events meet in keyed state.  The key is a window and a shard of senders, so a window's
graph is spread over `shards` tasks, an edge is in one shard, and a node's out-edges are too.  What
a strategy gives at a move is therefore a part; `live_merged` chains a second stateful operator that
closes a move when all shards have sent theirs, and gives the whole window's result.

State is kept by edge, by node and by range of indexes, in maps of the state store, and a move
touches the entries of the transfers it adds and evicts only: a block's cost does not grow with
what the window holds.  Within a micro-batch moves are taken in order.  A move adds the events
below its head and evicts those below its tail, which never pass each other; an event that comes
late is added by the next move if its window still holds it.  An edge stays until its last
transfer is evicted.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.plans.windows import WIDTHS
from tidewell.streaming.state import Entries

SHARDS = 8
#: Indexes whose transfers are one entry of the state.
SPAN = 256
#: Entries of a node of the rank tree, and its levels: room for WIDE**LEVELS senders in a shard.
WIDE, LEVELS = 64, 5


class Move(NamedTuple):
    """A window's new bounds: transfers tail <= idx < head."""

    number: int
    win_idx: int
    head: int
    tail: int
    open_win: bool


class RankTree:
    """Senders by out-degree, the first by (most, smallest id), as a tree of maxima over their places.

    A change rewrites one node a level; the first n are found from the root down.
    """

    def __init__(self, nodes: Entries) -> None:
        self.nodes = nodes

    def entries(self, level: int, at: int) -> list[tuple[int, int]]:
        """(-degree, id) of a tree node's entries; (0, 0) where there is none."""
        found = self.nodes.get(level, at)
        return [(int(d), int(i)) for d, i in zip(*found, strict=True)] if found else [(0, 0)] * WIDE

    def set(self, place: int, degree: int, node: int) -> None:
        entry = (-degree, node) if degree else (0, 0)
        for level in range(LEVELS):
            place, k = divmod(place, WIDE)
            own = self.entries(level, place)
            before = min(own)
            own[k] = entry
            self.nodes.put((level, place), ([d for d, _ in own], [i for _, i in own]))
            entry = min(own)
            if entry == before:
                return

    def at(self, place: int) -> tuple[int, int]:
        degree, node = self.entries(0, place // WIDE)[place % WIDE]
        return -degree, node

    def first(self, n: int) -> list[tuple[int, int]]:
        """(node, degree) of the first n."""
        out: list[tuple[int, int]] = []
        heap = [(e, LEVELS - 1, k) for k, e in enumerate(self.entries(LEVELS - 1, 0)) if e[0]]
        heapq.heapify(heap)
        while heap and len(out) < n:
            (degree, node), level, place = heapq.heappop(heap)
            if level == 0:
                out.append((node, -degree))
                continue
            for k, e in enumerate(self.entries(level - 1, place)):
                if e[0]:
                    heapq.heappush(heap, (e, level - 1, place * WIDE + k))
        return out


#: The maps of a window's graph: name -> (key, value).
MAPS = {
    "held": ("span long", "idx array<long>, a array<long>, b array<long>"),
    "edges": ("a long, b long", "n long, out_at long, in_at long"),
    "nodes": ("node long", "sent long, received long, receivers long, senders long, place long"),
    "near": ("node long, side long, at long", "other long"),
    "rank": ("level long, at long", "degree array<long>, node array<long>"),
}
TOTALS = ("number", "head", "tail", "low", "n_edges", "n_tx", "n_senders")
OUT, IN = 0, 1


class WindowGraph:
    """The simple graph of the transfers in a window (of a shard of senders), with their indexes."""

    def __init__(self, maps: dict[str, Entries] | None = None, totals: tuple[int, ...] | None = None) -> None:
        self.maps = maps or {name: Entries() for name in MAPS}
        self.number, self.head, self.tail, self.low, self.n_edges, self.n_tx, self.n_senders = totals or (0, 0, 0, -1, 0, 0, 0)
        self.rank = RankTree(self.maps["rank"])
        self.late: list[tuple[int, int, int]] = []  # below the head, but not added yet
        self.changes: dict[tuple[int, int], int] = {}  # edges that came (1) and went (-1) by the last move

    def totals(self) -> tuple[int, ...]:
        return self.number, self.head, self.tail, self.low, self.n_edges, self.n_tx, self.n_senders

    # what a strategy may ask for; none of it walks over the window but `evidence` and `transfers`

    def count(self, a: int, b: int) -> int:
        """Transfers of an edge."""
        found = self.maps["edges"].get(a, b)
        return int(found[0]) if found else 0

    def out_degree(self, node: int) -> int:
        return self._node(node)[0]

    def in_degree(self, node: int) -> int:
        return self._node(node)[1]

    def receivers(self, node: int) -> list[int]:
        return [int(self.maps["near"].get(node, OUT, k)[0]) for k in range(self._node(node)[2])]

    def senders(self, node: int) -> list[int]:
        return [int(self.maps["near"].get(node, IN, k)[0]) for k in range(self._node(node)[3])]

    def top_senders(self, n: int) -> list[tuple[int, int]]:
        """(node, out-degree) of the n with most transfers out, ties to the smaller id."""
        return self.rank.first(n)

    def transfers(self, start: int | None = None, end: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(idx, from, to) of the transfers held from `start` to `end`, by default those in the window."""
        start, end = max(self.low, self.tail if start is None else start), self.head if end is None else end
        if self.low < 0:
            return
        for span in range(start // SPAN, -(-end // SPAN)):
            for x in self._span(span):
                if start <= x[0] < end:
                    yield x

    def evidence(self, a: int, b: int) -> list[int]:
        """The indexes of an edge's transfers in the window."""
        return [i for i, x, y in self.transfers() if (x, y) == (a, b)]

    # changes

    def _span(self, span: int) -> list[tuple[int, int, int]]:
        found = self.maps["held"].get(span)
        return [(int(i), int(a), int(b)) for i, a, b in zip(*found, strict=True)] if found else []

    def hold(self, events: Iterable[tuple[int, int, int]]) -> None:
        """Keeps events for the move that passes them; those known already are left out."""
        spans: dict[int, dict[int, tuple[int, int, int]]] = {}
        for event in events:
            if event[0] < self.tail:
                continue
            span = event[0] // SPAN
            if span not in spans:
                spans[span] = {x[0]: x for x in self._span(span)}
            if event[0] not in spans[span]:
                spans[span][event[0]] = event
                self.low = event[0] if self.low < 0 else min(self.low, event[0])
                if event[0] < self.head:
                    self.late.append(event)
        for span, rows in spans.items():
            self.maps["held"].put((span,), tuple(map(list, zip(*sorted(rows.values()), strict=True))))

    def move(self, number: int, head: int, tail: int) -> None:
        """Takes in the events below `head` and forgets those below `tail`; neither goes back."""
        self.number, self.changes = number, {}
        for _, a, b in self.late:
            self._add(a, b)
        self.late = []
        for _, a, b in self.transfers(self.head, head):
            self._add(a, b)
        self.head = max(head, self.head)
        tail = min(max(tail, self.tail), self.head)
        for _, a, b in self.transfers(self.tail, tail):
            self._evict(a, b)
        if self.low >= 0:
            for span in range(max(self.tail, self.low) // SPAN, tail // SPAN):
                if self.maps["held"].get(span):
                    self.maps["held"].put((span,), None)
        self.tail = tail

    def _node(self, node: int) -> tuple[int, int, int, int, int]:
        found = self.maps["nodes"].get(node)
        return tuple(map(int, found)) if found else (0, 0, 0, 0, -1)

    def _set_node(self, node: int, **new: int) -> None:
        value = dict(zip(("sent", "received", "receivers", "senders", "place"), self._node(node), strict=True)) | new
        self.maps["nodes"].put((node,), tuple(value.values()) if value["sent"] or value["received"] else None)

    def _change(self, a: int, b: int, by: int) -> None:
        now = self.changes.get((a, b), 0) + by
        if now:
            self.changes[a, b] = now
        else:
            del self.changes[a, b]

    def _add(self, a: int, b: int) -> None:
        self.n_tx += 1
        self._set_node(a, sent=self._node(a)[0] + 1)
        self._set_node(b, received=self._node(b)[1] + 1)
        edge = self.maps["edges"].get(a, b)
        if edge:
            self.maps["edges"].put((a, b), (int(edge[0]) + 1, *map(int, edge[1:])))
        else:
            out_at, in_at = self._node(a)[2], self._node(b)[3]
            self.maps["edges"].put((a, b), (1, out_at, in_at))
            self.maps["near"].put((a, OUT, out_at), (b,))
            self.maps["near"].put((b, IN, in_at), (a,))
            self._set_node(a, receivers=out_at + 1)
            self._set_node(b, senders=in_at + 1)
            self.n_edges += 1
            self._change(a, b, 1)
        self._ranked(a, self._node(a)[0])

    def _evict(self, a: int, b: int) -> None:
        self.n_tx -= 1
        n, out_at, in_at = map(int, self.maps["edges"].get(a, b))
        if n > 1:
            self.maps["edges"].put((a, b), (n - 1, out_at, in_at))
        else:
            # the last neighbour of each list takes the place that is free
            last, near = self._node(a)[2] - 1, self.maps["near"]
            other = int(near.get(a, OUT, last)[0])
            if last != out_at:
                own = self.maps["edges"].get(a, other)
                near.put((a, OUT, out_at), (other,))
                self.maps["edges"].put((a, other), (int(own[0]), out_at, int(own[2])))
            near.put((a, OUT, last), None)
            last = self._node(b)[3] - 1
            other = int(near.get(b, IN, last)[0])
            if last != in_at:
                own = self.maps["edges"].get(other, b)
                near.put((b, IN, in_at), (other,))
                self.maps["edges"].put((other, b), (int(own[0]), int(own[1]), in_at))
            near.put((b, IN, last), None)
            self.maps["edges"].put((a, b), None)
            self._set_node(a, receivers=self._node(a)[2] - 1)
            self._set_node(b, senders=self._node(b)[3] - 1)
            self.n_edges -= 1
            self._change(a, b, -1)
        self._ranked(a, self._node(a)[0] - 1)
        self._set_node(a, sent=self._node(a)[0] - 1)
        self._set_node(b, received=self._node(b)[1] - 1)

    def _ranked(self, node: int, degree: int) -> None:
        """Keeps the sender's place in the rank tree; places stay dense."""
        place = self._node(node)[4]
        if degree:
            if place < 0:
                place, self.n_senders = self.n_senders, self.n_senders + 1
                self._set_node(node, place=place)
            self.rank.set(place, degree, node)
            return
        last, self.n_senders = self.n_senders - 1, self.n_senders - 1
        if place != last:
            of_last, other = self.rank.at(last)
            self.rank.set(place, of_last, other)
            self._set_node(other, place=place)
        self.rank.set(last, 0, 0)
        self._set_node(node, place=-1)


class Strategy(Protocol):
    """What is run at every move of an open window; `fields` is the DDL of its rows."""

    fields: str

    def on_move(self, graph: WindowGraph, move: Move) -> Iterable[tuple]: ...

    def merge(self, parts: list[tuple]) -> Iterable[tuple]:
        """The rows of the whole window from those of all shards."""
        ...


class EmitMove:
    """The bounds themselves."""

    fields = "head long, tail long, open_win boolean"

    def on_move(self, graph: WindowGraph, move: Move) -> Iterable[tuple]:
        return [(move.head, move.tail, move.open_win)]

    def merge(self, parts: list[tuple]) -> Iterable[tuple]:
        return parts[:1]


class EdgeCounts:
    """Edges and transfers in the window (of the shard; merged: of all)."""

    fields = "n_edges long, n_tx long"

    def on_move(self, graph: WindowGraph, move: Move) -> Iterable[tuple]:
        return [(graph.n_edges, graph.n_tx)]

    def merge(self, parts: list[tuple]) -> Iterable[tuple]:
        return [tuple(map(sum, zip(*parts, strict=True)))]


class TopSenders:
    """The nodes with most transfers out (of the shard, which holds all of a sender's; merged: of all)."""

    fields = "node long, out_degree long"

    def __init__(self, n: int = 5) -> None:
        self.n = n

    def on_move(self, graph: WindowGraph, move: Move) -> Iterable[tuple]:
        return graph.top_senders(self.n)

    def merge(self, parts: list[tuple]) -> Iterable[tuple]:
        return sorted(parts, key=lambda x: (-x[1], x[0]))[: self.n]


class EdgeChanges:
    """The edges that came into the window (1) and left it (-1) by the move."""

    fields = "from_id long, to_id long, change long"

    def on_move(self, graph: WindowGraph, move: Move) -> Iterable[tuple]:
        return [(*edge, by) for edge, by in sorted(graph.changes.items())]

    def merge(self, parts: list[tuple]) -> Iterable[tuple]:
        return sorted(parts)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def _names(fields: str) -> list[str]:
    return [x.split()[0] for x in fields.split(", ")]


class GraphProcessor(StatefulProcessor):
    """A part for every move of an open window: the strategy's rows, or one of nulls if it has none
    (`n_rows` tells), so that whoever merges the shards knows when all have answered."""

    def __init__(self, strategy: Strategy) -> None:
        self.strategy = strategy
        self.names = ["number", "win_idx", "shard", "n_rows", *_names(strategy.fields)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", ", ".join(f"{n} long" for n in TOTALS))
        self.late = handle.getListState("late", "idx long, a long, b long")
        self.states = {name: handle.getMapState(name, key, value) for name, (key, value) in MAPS.items()}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        win_idx, shard = int(key[0]), int(key[1])
        graph = WindowGraph({name: Entries(state) for name, state in self.states.items()}, tuple(map(int, self.totals.get())) if self.totals.exists() else None)
        waited = self.late.exists()
        if waited:
            graph.late = [tuple(map(int, x)) for x in self.late.get()]
        batch = pd.concat(list(rows))
        events = batch[~batch["is_move"]]
        graph.hold((int(i), int(a), int(b)) for i, a, b in zip(events["idx"], events["a"], events["b"], strict=True))
        moves = batch[batch["is_move"]].sort_values("number")
        out: list[tuple] = []
        none = (None,) * (len(self.names) - 4)
        for n, head, tail, is_open in zip(moves["number"], moves["head"], moves["tail"], moves["open_win"], strict=True):
            if n <= graph.number:  # replayed
                continue
            graph.move(int(n), int(head), int(tail))
            if is_open:
                found = list(self.strategy.on_move(graph, Move(graph.number, win_idx, graph.head, graph.tail, True)))
                out += [(graph.number, win_idx, shard, len(found), *r) for r in found or [none]]
        for entries in graph.maps.values():
            entries.flush()
        self.totals.update(graph.totals())
        if graph.late:
            self.late.put(graph.late)
        elif waited:
            self.late.clear()
        yield _frame(out, self.names)

    def close(self) -> None:
        pass


class MergeProcessor(StatefulProcessor):
    """Closes a move of a window when the parts of all its shards are there."""

    def __init__(self, strategy: Strategy, shards: int) -> None:
        self.strategy, self.shards = strategy, shards
        self.fields = _names(strategy.fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", f"shard int, n_rows int, {self.strategy.fields}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waited = self.parts.exists()
        parts = [tuple(x) for x in self.parts.get()] if waited else []
        batch = pd.concat(list(rows))
        parts += list(batch[["shard", "n_rows", *self.fields]].astype(object).itertuples(index=False, name=None))
        out: list[tuple] = []
        if len({int(p[0]) for p in parts}) < self.shards:
            self.parts.put(parts)
        else:
            out = [(int(key[0]), int(key[1]), *r) for r in self.strategy.merge([p[2:] for p in parts if p[1]])] if any(p[1] for p in parts) else []
            if waited:
                self.parts.clear()
        yield _frame(out, ["number", "win_idx", *self.fields])

    def close(self) -> None:
        pass


def sharded(moves: DataFrame, events: DataFrame, windows: int = len(WIDTHS), shards: int = SHARDS) -> DataFrame:
    """Rows for `live_graph`: moves go to every shard of their window, events to their sender's
    shard of every window."""
    zero, own = F.lit(0).cast("long"), F.pmod(F.xxhash64("from_id"), F.lit(shards)).cast("int")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    m = moves.select(
        F.col("win_idx").cast("int").alias("win_idx"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_move"),
        long("number", "number"), long("head", "head"), long("tail", "tail"), F.col("open_win").alias("open_win"), zero.alias("idx"), zero.alias("a"), zero.alias("b"),
    )
    e = events.select(
        F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("win_idx"), own.alias("shard"), F.lit(False).alias("is_move"),
        zero.alias("number"), zero.alias("head"), zero.alias("tail"), F.lit(False).alias("open_win"), long("idx", "idx"), long("from_id", "a"), long("to_id", "b"),
    )
    return m.union(e)


def live_parts(moves: DataFrame, events: DataFrame, strategy: Strategy, windows: int = len(WIDTHS), shards: int = SHARDS) -> DataFrame:
    """The shards' parts: `number`, `win_idx`, `shard`, `n_rows` and the strategy's rows."""
    rows = sharded(moves, events, windows, shards)
    return rows.groupBy("win_idx", "shard").transformWithStateInPandas(GraphProcessor(strategy), f"number long, win_idx int, shard int, n_rows int, {strategy.fields}", "Append", "None")


def live_graph(moves: DataFrame, events: DataFrame, strategy: Strategy, windows: int = len(WIDTHS), shards: int = SHARDS) -> DataFrame:
    """`number`, `win_idx`, `shard` and the strategy's rows at every move of an open window.

    moves: a stream of `number`, `win_idx`, `head`, `tail`, `open_win`; events: a stream of `idx`,
    `from_id`, `to_id`, which brings a transfer no later than the move that passes it.  Needs the
    RocksDB state store.
    """
    return live_parts(moves, events, strategy, windows, shards).where("n_rows > 0").drop("n_rows")


def live_merged(moves: DataFrame, events: DataFrame, strategy: Strategy, windows: int = len(WIDTHS), shards: int = SHARDS) -> DataFrame:
    """`number`, `win_idx` and the strategy's rows for the whole window at every move of an open one: the
    parts of the shards meet in a second operator, keyed by move and window."""
    parts = live_parts(moves, events, strategy, windows, shards)
    return parts.groupBy("number", "win_idx").transformWithStateInPandas(MergeProcessor(strategy, shards), f"number long, win_idx int, {strategy.fields}", "Append", "None")
