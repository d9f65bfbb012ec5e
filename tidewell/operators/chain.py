"""Lookups and continuity questions over a table of blocks (`number`, `ts`, `hash`, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import encoding as E

MAX_RANGE = 2000
REBUILD, KEEP, TRIM = "REBUILD", "KEEP_ALL_CATCH_UP", "TRIM_AFTER_KEEP"


def gap_rule(tick_seconds: float) -> int:
    """Seconds between blocks from which a gap is one: three ticks, at least 1."""
    return max(1, int(3 * tick_seconds))


def head(blocks: DataFrame) -> DataFrame:
    """One row: `head_num`, `head_hash`, `head_timestamp`, `empty`."""
    last = blocks.agg(F.max(F.struct("number", "hash", "ts")).alias("h"))
    return last.select(F.col("h.number").alias("head_num"), F.col("h.hash").alias("head_hash"), F.col("h.ts").alias("head_timestamp"), F.col("h").isNull().alias("empty"))


def by_number(blocks: DataFrame, number: int) -> DataFrame:
    if number <= 0:
        raise ValueError("heights begin at 1")
    return blocks.where(F.col("number") == number)


def canonical_hash(text: str) -> str:
    """A hash as tables hold it, `0x` and lower case: a literal that reaches the scan as a filter."""
    bare = text.strip().lower()
    return bare if bare.startswith("0x") else f"0x{bare}"


def by_hash(blocks: DataFrame, text: str) -> DataFrame:
    """The block with this hash, given with or without 0x and in any case."""
    return blocks.where(F.col("hash") == canonical_hash(text))


def at_or_after(blocks: DataFrame, ts: int) -> DataFrame:
    """The first block at `ts` or later; no row if there is none."""
    if ts < 0:
        raise ValueError("a time below 0")
    first = blocks.where(F.col("ts") >= ts).agg(F.min(F.struct("number", "hash", "ts")).alias("b")).where("b is not null")
    return first.select(F.col("b.number").alias("block_num"), F.col("b.hash").alias("block_hash"), F.col("b.ts").alias("block_timestamp"))


def _checked(start: int, end: int) -> None:
    if start <= 0 or end <= 0 or start > end:
        raise ValueError("bad range")
    if end - start + 1 > MAX_RANGE:
        raise ValueError("range too large")


def block_range(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """Blocks from `start` to `end` (at most 2,000 heights), up to the first height that is missing."""
    _checked(start, end)
    return contiguous(blocks.where(F.col("number").between(start, end)), start)


def contiguous(blocks: DataFrame, start: int) -> DataFrame:
    """The rows from height `start` on, up to the first hole."""
    numbers = blocks.where(F.col("number") >= start).select("number").distinct()
    after = numbers.select((F.col("number") + 1).alias("number")).union(blocks.sparkSession.range(1).select(F.lit(start).cast("long").alias("number")))
    hole = after.join(numbers, "number", "left_anti").agg(F.min("number").alias("_hole"))
    return blocks.where(F.col("number") >= start).join(F.broadcast(hole), F.col("number") < F.col("_hole")).drop("_hole")


def range_status(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """One row: `from`, `to` (clamped to the head), `n`, `partial`, `last_ok` (0: none).

    No row for an empty chain.
    """
    _checked(start, end)
    top = blocks.agg(F.max("number").alias("h")).where("h is not null")
    got = block_range(blocks, start, end).agg(F.count("*").alias("n"), F.coalesce(F.max("number"), F.lit(0)).alias("last"))
    to = F.least(F.col("h"), F.lit(end)).cast("long")
    beyond = F.lit(start) > to
    return top.join(F.broadcast(got)).select(
        F.lit(start).cast("long").alias("from"), to.alias("to"), "n", (~beyond & (F.col("n") < to - start + 1)).alias("partial"), F.when(beyond, F.lit(0)).otherwise(F.col("last")).cast("long").alias("last_ok")
    )


def with_gap(blocks: DataFrame) -> DataFrame:
    """`blocks` with `prev_ts`, by an equi-join on heights (no ordered pass over all of them)."""
    before = blocks.select((F.col("number") + 1).alias("number"), F.col("ts").alias("prev_ts"))
    return blocks.join(before, "number", "left")


def gaps(blocks: DataFrame, gap_seconds: int) -> DataFrame:
    """Places where neighbouring blocks are more than `gap_seconds` apart."""
    far = with_gap(blocks).where(F.col("ts") - F.col("prev_ts") > gap_seconds)
    return far.select("number", F.col("prev_ts").alias("start_ts"), F.col("ts").alias("end_ts"), (F.col("ts") - F.col("prev_ts")).alias("seconds"))


def first_gap_after(blocks: DataFrame, position: int, gap_seconds: int) -> DataFrame:
    """`number` of the first block beyond `position` that ends a gap; no row if there is none."""
    return gaps(blocks, gap_seconds).where(F.col("number") > position).agg(F.min("number").alias("number")).where("number is not null")


def tail_decision(blocks: DataFrame, now: int, backfill: int, gap_seconds: int, inclusive: bool = True) -> DataFrame:
    """One row: `action` and `keep`, the height up to which the chain can be kept.

    inclusive: a gap that ends at the first block of the backfill window counts.
    """
    target = now - backfill
    b = with_gap(blocks)
    inside = F.col("ts") >= target
    far = F.coalesce(F.col("ts") - F.col("prev_ts") > gap_seconds, F.lit(False))
    row = b.agg(
        F.max("number").alias("hn"),
        F.max_by("ts", "number").alias("hts"),
        F.min(F.when(inside, F.col("number"))).alias("pos"),
        F.min(F.when(inside, F.col("ts"))).alias("pts"),
        F.min(F.when(inside & far, F.col("number"))).alias("gh"),
        F.min(F.when(inside & far & (F.col("prev_ts") >= target), F.col("number"))).alias("gh_beyond"),
    )
    gh: Column = F.col("gh") if inclusive else F.col("gh_beyond")
    keep = F.lit(0).cast("long")
    decided = (
        F.when(F.lit(backfill <= 0), F.struct(F.lit(KEEP).alias("action"), keep.alias("keep")))
        .when(F.col("hn").isNull(), F.struct(F.lit(REBUILD).alias("action"), keep.alias("keep")))
        .when(F.col("pos").isNull(), F.struct(F.lit(KEEP).alias("action"), F.col("hn").alias("keep")))
        .when((F.col("pts") > target + gap_seconds) & (F.col("pos") <= 1), F.struct(F.lit(REBUILD).alias("action"), keep.alias("keep")))
        .when(F.col("pts") > target + gap_seconds, F.struct(F.lit(TRIM).alias("action"), (F.col("pos") - 1).alias("keep")))
        .when(gh.isNotNull() & (gh <= 1), F.struct(F.lit(REBUILD).alias("action"), keep.alias("keep")))
        .when(gh.isNotNull(), F.struct(F.lit(TRIM).alias("action"), (gh - 1).alias("keep")))
        .otherwise(F.struct(F.lit(KEEP).alias("action"), F.col("hn").alias("keep")))
    )
    return row.select(decided.alias("d")).select("d.action", "d.keep")


def start_height(blocks: DataFrame, backfill: int, checkpoint: tuple[int, str] | None = None) -> DataFrame:
    """One row: `start`, `mode` (resume, head, backfill); no row for an empty chain without checkpoint.

    A checkpoint counts only if it has a hash that equals the block's.
    """
    height, text = checkpoint or (0, "")
    known = F.max(F.when((F.col("number") == height) & E.equal_hex(F.col("hash"), F.lit(text)), F.col("number")))
    top = blocks.agg(F.max("number").alias("hn"), F.max_by("ts", "number").alias("hts"), (known if height > 0 and text else F.lit(None).cast("long")).alias("ok"))
    first = blocks.join(F.broadcast(top), F.col("ts") >= F.greatest(F.col("hts") - max(backfill, 0), F.lit(0))).agg(F.min("number").alias("pos"))
    start = F.when(F.col("ok").isNotNull(), F.col("ok") + 1).when(F.lit(backfill < 0), F.col("hn")).otherwise(F.coalesce("pos", F.lit(1).cast("long")))
    mode = F.when(F.col("ok").isNotNull(), "resume").when(F.lit(backfill < 0), "head").otherwise("backfill")
    return top.join(F.broadcast(first)).where("hn is not null").select(start.alias("start"), mode.alias("mode"))


def truncate_after(blocks: DataFrame, keep: int) -> DataFrame:
    """Blocks up to height `keep`; a negative height counts as 0 (nothing stays)."""
    return blocks.where(F.col("number") <= max(keep, 0))


def replay_since(blocks: DataFrame, now: int, seconds: int = 86_400) -> DataFrame:
    """Blocks of the last `seconds`, as a cold start replays them; windows over them count from the
    first of them (`windows.moves` and `windows.indexed` number the blocks they are given)."""
    return blocks.where(F.col("ts") >= now - seconds)


def _unseen(blocks: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """The first row of `new` for each height that `blocks` does not hold: first by `offset` if there
    is one, else the least row (by time, then the other columns)."""
    given = [c for c in ("offset", "ts") if c in new.columns]
    rank = F.struct(*given, *[c for c in columns if c not in given])
    first = new.groupBy("number").agg(F.min_by(F.struct(*columns), rank).alias("_b")).select("_b.*")
    return first.join(blocks.select("number"), "number", "left_anti").select(*columns)


def append(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """`blocks` and those of `new` whose height is not there yet; of a height that comes several times,
    in `new` too, the first stays."""
    return blocks.unionByName(_unseen(blocks, new, blocks.columns))


def gap_events(blocks: DataFrame, new: DataFrame, gap_seconds: int) -> DataFrame:
    """`end_ts`, `number` of the gaps that appending `new` adds to the index: appended blocks more
    than `gap_seconds` after the block one height below, which may be old or new.  With a rule of
    0 or less there is no index; the first height ends no gap."""
    added = _unseen(blocks, new, ["number", "ts"])
    before = blocks.select("number", "ts").unionByName(added).select((F.col("number") + 1).alias("number"), F.col("ts").alias("prev_ts"))
    far = added.join(before, "number").where((F.col("number") > 1) & (F.col("ts") - F.col("prev_ts") > gap_seconds))
    return far.where(F.lit(gap_seconds > 0)).select(F.col("ts").alias("end_ts"), "number")


def seek_gap(events: DataFrame, blocks: DataFrame, target: int, gap_seconds: int) -> DataFrame:
    """`end_ts`, `number` of the first indexed gap that ends at `target` or later and that the chain
    still holds: an index entry whose block or predecessor has changed is passed over."""
    real = gaps(blocks, gap_seconds).select("number", "end_ts")
    first = events.where(F.col("end_ts") >= target).join(real, ["number", "end_ts"]).agg(F.min(F.struct("end_ts", "number")).alias("g"))
    return first.where("g is not null").select("g.end_ts", "g.number")


def linked(blocks: DataFrame) -> DataFrame:
    """Heights whose `parent_hash` is not the hash of the block before."""
    before = blocks.select((F.col("number") + 1).alias("number"), F.col("hash").alias("_before"))
    return blocks.join(before, "number").where(~F.col("parent_hash").eqNullSafe(F.col("_before"))).select("number")


def warm_up(blocks: DataFrame, now: int, backfill: int, step: int) -> DataFrame:
    """`number`, `ts` of the blocks a warm-up adds: from the later of head + step and now - backfill,
    while a step further is before `now`.  The head is read first, so that the schedule is a
    distributed range."""
    top, last = blocks.agg(F.max("number"), F.max_by("ts", "number")).first()
    first = max(now - backfill, 0, *([last + step] if last is not None else []))
    n = max(-(-(now - step - first) // step), 0)
    k = F.col("id")
    return blocks.sparkSession.range(n).select((k + ((top or 0) + 1)).alias("number"), (k * step + first).alias("ts"))
