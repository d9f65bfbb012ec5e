"""The transfer graph inside windows: edges, evidence, adjacency, degrees, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.plans.prefix import previous, with_prefix
from tidewell.plans.windows import WIDTHS
from tidewell.sources.store import drop, scratch, stored

SPAN = 256
#: Indexes, or tick numbers, that are summed in one task.
STRETCH = 1 << 20
#: How many times over ticks may hold the transfers and still be met one by one.
SPREAD = 2.0
_WINDOWS = range(len(WIDTHS))


def window_events(ticks: DataFrame, events: DataFrame, span: int = SPAN) -> DataFrame:
    """Events with tail <= idx < head of each tick, joined on ranges of `span` indexes."""
    t = ticks.select("win_idx", "head", "tail").where("head > tail")
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(F.col("tail") / span), F.floor((F.col("head") - 1) / span))))
    e = events.withColumn("_b", F.floor(F.col("idx") / span))
    return t.join(e, "_b").where("idx >= tail and idx < head").drop("_b")


def _tick_numbers(ticks: DataFrame) -> DataFrame:
    """`win_idx`, `head`, `tail`, `j`: the ticks of each window, numbered from 1.  Heads and tails never
    fall, so their sum orders a window's ticks; those that are equal in both are one.  A window's
    ticks, one for many blocks, are sorted in one task."""
    own = ticks.select(F.col("win_idx").cast("int").alias("win_idx"), "head", "tail").where("head > tail").distinct()
    line = Window.partitionBy("win_idx").orderBy(F.col("head") + F.col("tail"))
    return stored(own.withColumn("j", F.row_number().over(line).cast("long")))


def _passed(ticks: DataFrame, events: DataFrame) -> DataFrame:
    """`idx`, `from_id`, `to_id`, and for each window k `h<k>` and `t<k>`: how many of its ticks have their head,
    their tail, at or below idx.  So the ticks that hold a transfer are h + 1 to t."""
    names = [f"{c}{k}" for k in _WINDOWS for c in "ht"]
    ends = F.array(F.struct(F.col("head").alias("idx"), F.lit("h").alias("c")), F.struct(F.col("tail").alias("idx"), F.lit("t").alias("c")))
    none = F.lit(None).cast("long")
    marks = ticks.select("win_idx", F.inline(ends)).select("idx", none.alias("from_id"), none.alias("to_id"), *[((F.col("c") == n[0]) & (F.col("win_idx") == int(n[1:]))).cast("int").alias(n) for n in names])
    rows = marks.union(stored(events.select("idx", "from_id", "to_id")).select("*", *[F.lit(0) for _ in names]))
    places = rows.groupBy("idx").agg(F.max("from_id").alias("from_id"), F.max("to_id").alias("to_id"), *[F.sum(n).alias(f"_{n}") for n in names])
    steps = with_prefix(places, "idx", {n: F.col(f"_{n}") for n in names}, day=STRETCH)
    return steps.where("from_id is not null").select("idx", "from_id", "to_id", *names)


def _overlap(numbers: DataFrame) -> float:
    """How many times over the ticks' windows hold the transfers that they reach."""
    held, first, last = numbers.agg(F.sum(F.col("head") - F.col("tail")), F.min("tail"), F.max("head")).first()
    return held / (last - first) if held else 0.0


def edge_counts(ticks: DataFrame, events: DataFrame, spread: float = SPREAD) -> DataFrame:
    """`win_idx`, `head`, `tail`, `n_edges` (distinct), `n_tx` at each tick that has transfers.

    Ticks whose windows overlap little (they hold the transfers at most `spread` times) meet them as
    `window_events`.  Else nothing is spread over the ticks: a transfer stands for its edge in the
    ticks that hold it but not the edge's transfer before, a run of ticks, found from the counts of
    ticks passed by the two, so every transfer gives two marks a window and the counts are their
    running sums.  Both are exact.  ticks: of `windows.ticks` or `moves`, whose heads and tails
    never fall.
    """
    numbers = _tick_numbers(ticks)
    if _overlap(numbers) <= spread:
        pairs = window_events(numbers, events).groupBy("win_idx", "head", "tail", "from_id", "to_id").agg(F.count("*").alias("c"))
        return pairs.groupBy("win_idx", "head", "tail").agg(F.count("*").alias("n_edges"), F.sum("c").alias("n_tx"))
    seen = previous(stored(_passed(numbers, events)), ["from_id", "to_id"], "idx", [f"t{k}" for k in _WINDOWS])
    spans = []
    for k in _WINDOWS:
        first, last = F.col(f"h{k}") + 1, F.col(f"t{k}")
        lone = F.greatest(first, F.coalesce(F.col(f"prev_t{k}"), F.lit(0)) + 1)
        spans += [F.struct(F.lit(k).alias("win_idx"), j.alias("j"), F.lit(e).alias("e"), F.lit(n).alias("n"), ok.alias("ok")) for j, e, n, ok in (
            (first, 0, 1, first <= last), (last + 1, 0, -1, first <= last), (lone, 1, 0, lone <= last), (last + 1, -1, 0, lone <= last))]
    marks = seen.select(F.inline(F.array(*spans))).where("ok").groupBy("win_idx", "j").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    so_far = Window.partitionBy("win_idx").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(F.coalesce(c, F.lit(0))).over(so_far)
    counted = numbers.join(marks, ["win_idx", "j"], "left").select("win_idx", "head", "tail", run("e").alias("n_edges"), run("n").alias("n_tx"))
    return counted.where("n_tx > 0")


def evidence(ticks: DataFrame, events: DataFrame) -> DataFrame:
    """`win_idx`, `head`, edge and the sorted indexes of its transfers."""
    return window_events(ticks, events).groupBy("win_idx", "head", "from_id", "to_id").agg(F.sort_array(F.collect_list("idx")).alias("evidence"))


def adjacency(ticks: DataFrame, events: DataFrame, reverse: bool = False) -> DataFrame:
    """`win_idx`, `head`, `node`, and its sorted neighbours: receivers, or senders if reverse."""
    node, other = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    return window_events(ticks, events).groupBy("win_idx", "head", F.col(node).alias("node")).agg(F.sort_array(F.collect_set(other)).alias("neighbours"))


def degrees(ticks: DataFrame, events: DataFrame, spread: float = SPREAD) -> DataFrame:
    """`win_idx`, `head`, `node`, `out_degree`, `in_degree`, counted by transfer.

    Ticks that overlap little are met as in `edge_counts`.  Else: a node's degrees change at the ticks where one of its transfers comes or goes; between them they
    are the same.  Changes are summed by tick before they are shuffled, and only the result has a row for each tick.
    """
    numbers = _tick_numbers(ticks)
    if _overlap(numbers) <= spread:
        ends = F.array(F.struct(F.col("from_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        met = window_events(numbers, events).select("win_idx", "head", "tail", F.inline(ends))
        return met.groupBy("win_idx", "head", "tail", "node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree")).drop("tail")
    marks = []
    for k in _WINDOWS:
        first, last = F.col(f"h{k}") + 1, F.col(f"t{k}")
        for j, v in ((first, 1), (last + 1, -1)):
            marks += [F.struct(F.lit(k).cast("int").alias("win_idx"), F.col(c).alias("node"), j.alias("j"), F.lit(v * o).alias("o"), F.lit(v * i).alias("i"), (first <= last).alias("ok")) for c, o, i in (("from_id", 1, 0), ("to_id", 0, 1))]
    change = _passed(numbers, events).select(F.inline(F.array(*marks))).where("ok").groupBy("win_idx", "node", "j").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    line = Window.partitionBy("win_idx", "node").orderBy("j")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    held = change.withColumns({"out_degree": F.sum("o").over(so_far), "in_degree": F.sum("i").over(so_far), "until": F.lead("j").over(line)})
    held = held.where("out_degree > 0 or in_degree > 0")
    each = held.select("win_idx", F.explode(F.sequence(F.col("j"), F.col("until") - 1)).alias("j"), "node", "out_degree", "in_degree")
    heads = numbers.select("win_idx", "j", "head")
    return each.join(heads, ["win_idx", "j"]).select("win_idx", "head", "node", "out_degree", "in_degree")


def top_out_degree(ticks: DataFrame, events: DataFrame, n: int = 5) -> DataFrame:
    """The `n` nodes of most transfers out at each tick, ties to the smaller id."""
    best = Window.partitionBy("win_idx", "head").orderBy(F.desc("out_degree"), "node")
    d = degrees(ticks, events).where("out_degree > 0")
    return d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select("win_idx", "head", F.col("rank").cast("int").alias("rank"), "node", "out_degree")


def sender_sessions(events: DataFrame, gap: int) -> DataFrame:
    """`from_id`, `start`, `end`, `n_tx`, `amount`: a sender's transfers that follow each other within
    `gap` seconds; `end` is `gap` after the last.

    Sessions are made by sender and day, then those that meet at midnight are merged, so a sender of a
    third of all transfers is dealt by days and its days' sessions only come together.
    """
    t, half = F.timestamp_seconds("ts"), F.floor(F.col("ts") / 86_400)
    parts = events.groupBy("from_id", half.alias("day"), F.session_window(t, f"{gap} seconds").alias("w")).agg(F.count("*").alias("n_tx"), F.sum("amount").alias("amount"))
    parts = parts.select("from_id", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("end"), "n_tx", "amount")
    line = Window.partitionBy("from_id").orderBy("start")
    fresh = F.coalesce(F.col("start") > F.lag("end").over(line), F.lit(True))  # parts of a sender do not overlap
    named = parts.withColumn("fresh", fresh.cast("int")).withColumn("k", F.sum("fresh").over(line))
    return named.groupBy("from_id", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_tx").alias("n_tx"), F.sum("amount").alias("amount")).drop("k")


def sender_windows(events: DataFrame, width: int) -> DataFrame:
    """`from_id`, `start`, `n_tx`, `amount` of each sender in tumbling windows of `width` seconds."""
    w = F.window(F.timestamp_seconds("ts"), f"{width} seconds")
    return events.groupBy("from_id", w.alias("w")).agg(F.count("*").alias("n_tx"), F.sum("amount").alias("amount")).select("from_id", F.unix_seconds("w.start").alias("start"), "n_tx", "amount")


def active_edges(events: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """`ts`, `n_edges`: distinct edges in the trailing window of each block, without a self-join.

    An edge that comes up counts +1, and -1 one second after it has been quiet for `width`.
    """
    seen = events.select("from_id", "to_id", "ts").distinct()
    line = Window.partitionBy("from_id", "to_id").orderBy("ts")
    around = seen.withColumns({"before": F.lag("ts").over(line), "after": F.lead("ts").over(line)})
    begins = F.when(F.col("before").isNull() | (F.col("ts") - F.col("before") > width), F.struct(F.col("ts").alias("t"), F.lit(1).alias("v"), F.lit(False).alias("b")))
    ends = F.when(F.col("after").isNull() | (F.col("after") - F.col("ts") > width), F.struct((F.col("ts") + width + 1).alias("t"), F.lit(-1).alias("v"), F.lit(False).alias("b")))
    marks = around.select(F.inline(F.array_compact(F.array(begins, ends)))).union(blocks.select(F.col("ts").alias("t"), F.lit(0).alias("v"), F.lit(True).alias("b")))
    change = stored(marks.groupBy("t").agg(F.sum("v").alias("v"), F.max("b").alias("b")))
    return with_prefix(change, "t", {"n_edges": F.col("v")}).where("b").select(F.col("t").alias("ts"), "n_edges")


def _reached(nodes: DataFrame, along: DataFrame, folder: str) -> DataFrame:
    """`node`, `p`, `root`: the node of least priority among those from which each can be reached.

    Every round looks at the neighbours' roots and then at the roots of those roots, so with
    priorities drawn at random the stretch of a path that is known grows by a factor a round.
    """
    now = stored(nodes.select("node", "p", F.col("node").alias("root")), folder)
    seen = None
    while True:
        sent = along.join(now.select(F.col("node").alias("src"), "p", "root"), "src").select(F.col("dst").alias("node"), "p", "root")
        least = F.min(F.struct("p", "root")).alias("m")
        near = now.union(sent).groupBy("node").agg(least).select("node", "m.p", "m.root")
        far = now.select(F.col("node").alias("root"), F.col("p").alias("p2"), F.col("root").alias("root2"))
        # the priority of a root's root is never above the root's own
        new = stored(near.join(far, "root").select("node", F.col("p2").alias("p"), F.col("root2").alias("root")), folder)
        total = new.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]  # no priority ever rises
        if total == seen:
            return new
        now, seen = new, total


def strong_components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """`node`, `component` (its smallest node): strongly connected components of edges (`src`, `dst`).

    Nodes get random priorities.  The least node that reaches a node and the least one it
    reaches are the same within a component; where they are one node, it is in the component of
    both, which leaves.  Edges between nodes that differ in them are in no cycle and go.  Paths
    are cut at random places in every round, so rounds grow with the logarithm of the longest
    one; each ends with at least the component of the least node.  Tables go to `folder`.
    """
    spark = edges.sparkSession
    own, folder = folder is None, folder or scratch(spark, "scc")
    ends = edges.select("src", "dst").distinct()
    nodes = stored(ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), folder)
    e = stored(ends.where("src <> dst"), folder)
    done: list[DataFrame] = []
    turn = 0
    while not e.isEmpty():
        turn += 1
        live = stored(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.xxhash64("node", F.lit(turn)).alias("p")), folder)
        ahead = _reached(live, e, folder)
        back = _reached(live, e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), folder)
        both = stored(ahead.select("node", F.col("root").alias("f")).join(back.select("node", F.col("root").alias("b")), "node"), folder)
        done.append(both.where("f = b").select("node", F.col("f").alias("root")))
        open_ = both.where("f <> b")
        kept = e.join(open_.select(F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), "src")
        kept = kept.join(open_.select(F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2")), "dst")
        e = stored(kept.where("f1 = f2 and b1 = b2").select("src", "dst"), folder)
    found = nodes.select("node", F.col("node").alias("root")).where("false")
    for part in done:
        found = found.union(part)
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    out = nodes.join(found.join(least, "root").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    if own:
        out = stored(out)
        drop(spark, folder)
    return out
