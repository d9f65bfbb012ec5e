"""The core query: four trailing windows over blocks, a gate, and every-N ticks.

A window holds the blocks with ts >= now - width (closed).  `head` counts the transfers up to
the block, `tail` those before the window's first block, both from the first block of the
input.  The gate opens for all windows at the first block for which the longest window has
lost a block of the input; from there every N-th block of a window is a tick.

Blocks are taken by height, or by `offset` if they have one, and then a height that is not above
all before it is a replay and left out; without offsets the earliest of a height's blocks counts.
A window's first block never goes back: `now` is the latest time up to the block.  So times may be
equal or step back, and batch and stream (`streaming.ticks`) agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.prefix import trailing, with_prefix

WIDTHS = (60, 300, 3600, 86_400)
CADENCE = (50, 200, 1000, 5000)
DEFAULT_EVERY = 200


def in_order(blocks: DataFrame) -> DataFrame:
    """`number`, `ts`, `n_tx` (and `offset`) of the blocks that count: a row for each height, replays left out."""
    if "offset" not in blocks.columns:
        return blocks.groupBy("number").agg(F.min(F.struct("ts", "n_tx")).alias("b")).select("number", "b.ts", "b.n_tx")
    known = with_prefix(blocks.select("offset", "number", "ts", "n_tx"), "offset", {}, maxes={"top": F.col("number")})
    # a new highest height is the first offset that has it
    return known.where("number = top").groupBy("number").agg(F.min(F.struct("offset", "ts", "n_tx")).alias("b")).select("number", "b.ts", "b.n_tx", "b.offset")


def indexed(blocks: DataFrame) -> DataFrame:
    """`number`, `ts`, `latest` (time up to the block), `at` (place in the input, from 1), `head` and `rel`:
    all counted from the first block of the input, whatever its height, as a reader that starts
    there counts them."""
    counted = with_prefix(in_order(blocks), "number", {"at": F.lit(1), "head": F.col("n_tx")}, maxes={"latest": F.col("ts")})
    return counted.select("number", "ts", "latest", "at", "head", (F.col("head") - F.col("n_tx")).alias("rel"))


def opened(blocks: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row, `since`: the longest window has lost the input's first block when the latest time is above this."""
    first = F.min(F.struct("offset", "ts") if "offset" in blocks.columns else F.struct("number", "ts"))
    return blocks.agg((first["ts"] + max(widths)).alias("since"))


def moves(blocks: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """`number`, `ts`, `at`, `win_idx`, `head`, `tail`, `open_win` for every block and window."""
    framed = trailing(indexed(blocks), "latest", {f"_tail{k}": ("rel", w) for k, w in enumerate(widths)})
    framed = framed.join(F.broadcast(opened(blocks, widths)))
    windows = F.array(*[F.struct(F.lit(k).alias("win_idx"), F.col(f"_tail{k}").alias("tail")) for k in range(len(widths))])
    out = framed.select("number", "ts", "at", "head", (F.col("latest") > F.col("since")).alias("open_win"), F.explode(windows).alias("w"))
    return out.select("number", "ts", "at", "w.win_idx", "head", "w.tail", "open_win")


def gate(blocks: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row: `open_at`, the height of the first block for which the longest window lost one (null: never).
    The latest time never falls, so that is the first block beyond it."""
    later = in_order(blocks).join(F.broadcast(opened(blocks, widths))).where(F.col("ts") > F.col("since"))
    return later.agg(F.min("number").alias("open_at"))


def ticks(blocks: DataFrame, cadence: tuple[int, ...] = CADENCE, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """`number`, `win_idx`, `head`, `tail`, `open_win` of every tick.  A cadence of 0 or less means 200.

    Blocks are counted, not heights: a height that is missing moves no window.
    """
    every = F.element_at(F.array(*[F.lit(c if c > 0 else DEFAULT_EVERY) for c in cadence]), F.col("win_idx") + 1)
    first = gate(blocks, widths)
    before = in_order(blocks).join(F.broadcast(first)).agg(F.count(F.when(F.col("open_at").isNull() | (F.col("number") < F.col("open_at")), 1)).alias("before"))
    gated = moves(blocks, widths).where("open_win").join(F.broadcast(before))
    return gated.where((F.col("at") - F.col("before")) % every == 0).select("number", "win_idx", "head", "tail", "open_win")
