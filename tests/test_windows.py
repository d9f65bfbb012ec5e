import json
import os
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.plans.prefix import with_prefix
from tidewell.plans.windows import gate, moves, ticks
from tidewell.streaming.order import Buffer, in_height_order
from tidewell.streaming import sinks
from tidewell.streaming.ticks import WindowFold, live_changes, live_ticks


def table(spark, rows):
    """rows: (ts, n_tx) in order."""
    head, out = 0, []
    for k, (ts, n) in enumerate(rows):
        out.append((k + 1, ts, n, head + n, head))
        head += n
    return spark.createDataFrame(out, "number long, ts long, n_tx long, head long, rel long")


def model(rows, widths, cadence):
    """Windows by looking at all blocks each time."""
    out, place, opened, head = [], 0, False, 0
    rels = []
    for k, (ts, n) in enumerate(rows):
        rels.append(head)
        head += n
        first = [min(j for j in range(k + 1) if rows[j][0] >= ts - w) for w in widths]
        opened = opened or first[widths.index(max(widths))] > 0
        if opened:
            place += 1
            out += [(k + 1, i, head, rels[first[i]], True) for i, c in enumerate(cadence) if place % c == 0]
    return out


chains = st.lists(st.tuples(st.integers(1, 120), st.integers(0, 3)), min_size=1, max_size=60)


@settings(max_examples=60, deadline=None)
@given(chains)
def test_fold_equals_model(steps):
    ts, rows = 1000, []
    for gap, n in steps:
        ts += gap
        rows.append((ts, n))
    widths, cadence = (10, 60, 300), (1, 2, 3)
    fold, got = WindowFold(widths, cadence), []
    for k, (t, n) in enumerate(rows):
        got += fold.step(k + 1, t, n)
        if k % 7 == 0:
            fold.prune()
    assert got == model(rows, widths, cadence)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(chains)
def test_batch_equals_model(spark, steps):
    ts, rows = 86_000, []
    for gap, n in steps:
        ts += gap * 50
        rows.append((ts, n))
    widths, cadence = (60, 500, 3000), (1, 2, 3)
    got = sorted(tuple(r) for r in ticks(table(spark, rows), cadence, widths).collect())
    assert got == sorted(model(rows, widths, cadence))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(chains, st.integers(1, 900), st.sets(st.integers(0, 59)))
def test_batch_equals_fold_from_any_height_and_with_holes(spark, steps, start, holes):
    """A replay: heights begin anywhere, some are missing, and transfers were counted from elsewhere."""
    ts, rows = 86_000, []
    for k, (gap, n) in enumerate(steps):
        ts += gap * 50
        if k not in holes:
            rows.append((start + k, ts, n, 7 * k, 7 * k))
    widths, cadence = (60, 500, 3000), (1, 2, 3)
    fold, want = WindowFold(widths, cadence), []
    for number, t, n, *_ in rows:
        want += fold.step(number, t, n)
    df = spark.createDataFrame(rows, "number long, ts long, n_tx long, head long, rel long")
    assert sorted(tuple(r) for r in ticks(df, cadence, widths).collect()) == sorted(want)
    assert gate(df, widths).first().open_at == (min(t[0] for t in want) if want else None)


uneven = st.lists(st.tuples(st.integers(-3, 4), st.integers(0, 3), st.integers(-2, 3)), min_size=1, max_size=50)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(uneven)
def test_batch_equals_fold_with_equal_times_steps_back_and_replays(spark, steps):
    """steps: (time, transfers, height) against the block before; a height of 0 or less repeats one."""
    ts, number, rows = 90_000, 20, []
    for offset, (gap, n, up) in enumerate(steps):
        ts, number = ts + gap * 300, max(1, number + up)
        rows.append((3 * offset, number, ts, n))
    widths, cadence = (60, 500, 1500), (1, 2, 3)
    fold, every, want = WindowFold(widths, cadence), WindowFold(widths, cadence), []
    bounds = []
    for _, height, t, n in rows:
        want += fold.step(height, t, n)
        bounds += every.move(height, t, n)
    df = spark.createDataFrame(rows, "offset long, number long, ts long, n_tx long").repartition(3)
    assert sorted(map(tuple, moves(df, widths).select("number", "win_idx", "head", "tail", "open_win").collect())) == sorted(bounds)
    assert sorted(map(tuple, ticks(df, cadence, widths).collect())) == sorted(want)


def test_of_repeated_heights_without_offsets_the_earliest_counts(spark):
    df = spark.createDataFrame([(1, 10, 1), (2, 30, 5), (2, 20, 1), (2, 20, 1)], "number long, ts long, n_tx long")
    assert [(r.number, r.head) for r in moves(df, (60,)).orderBy("number").collect()] == [(1, 1), (2, 2)]


def test_window_is_closed_and_gate_needs_a_lost_block(spark):
    rows = [(0, 0), (60, 2), (121, 1)]
    got = {(r.number, r.win_idx): r.tail for r in moves(table(spark, rows), (60,)).collect()}
    assert got == {(1, 0): 0, (2, 0): 0, (3, 0): 2}
    assert gate(table(spark, rows), (60,)).first().open_at == 3
    assert gate(table(spark, rows[:2]), (60,)).first().open_at is None
    assert ticks(table(spark, rows[:2]), (1,), (60,)).count() == 0


def test_cadence_of_zero_means_two_hundred(spark):
    rows = [(k * 100, 1) for k in range(450)]
    assert [r.number for r in ticks(table(spark, rows), (0,), (60,)).orderBy("number").collect()] == [201, 401]


def test_prefix_crosses_days(spark):
    df = spark.createDataFrame([(t, 1) for t in (5, 86_399, 86_400, 300_000)], "t long, v long")
    assert [r.s for r in with_prefix(df, "t", {"s": F.col("v")}).orderBy("t").collect()] == [1, 2, 3, 4]


def test_late_times_never_reopen_a_window():
    fold = WindowFold((10,), (1,))
    for number, ts in ((1, 100), (2, 200), (3, 105), (4, 206)):
        out = fold.step(number, ts, 1)
    assert out == [(4, 0, 4, 1, True)]


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_equals_batch_for_any_split(spark, tmp_path, parts):
    rng, ts, rows = random.Random(parts), 0, []
    for _ in range(120):
        ts += rng.randrange(1, 90)
        rows.append((ts, rng.randrange(4)))
    widths, cadence = (60, 600), (2, 5)
    lines = [json.dumps({"offset": k, "number": k + 1, "ts": t, "n_tx": n}) for k, (t, n) in enumerate(rows)]
    lines.append(lines[10])  # a replayed height
    size = -(-len(lines) // parts)
    for p in range(parts):
        own = lines[p * size : (p + 1) * size]
        rng.shuffle(own)
        (tmp_path / f"{p}.json").write_text("\n".join(own))
        os.utime(tmp_path / f"{p}.json", (1_700_000_000 + 10 * p,) * 2)  # files are read oldest first
    stream = spark.readStream.schema("offset long, number long, ts long, n_tx long").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    name = f"ticks{parts}"
    q = live_ticks(stream, widths, cadence).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.table(name).collect())
    assert got == sorted(tuple(r) for r in ticks(table(spark, rows), cadence, widths).collect())


chain_ops = st.lists(st.one_of(st.tuples(st.integers(-2, 6), st.integers(0, 3)), st.integers(0, 12)), min_size=1, max_size=80)


@settings(max_examples=150, deadline=None)
@given(chain_ops, st.integers(1, 9))
def test_a_cut_chain_equals_a_fresh_run(ops, every):
    """ops: a block (time step, transfers), or how many of the last blocks are cut."""
    widths, cadence = (60, 500, 1500), (1, 2, 3)
    fold, chain_, sent = WindowFold(widths, cadence, undo=100), [], []
    for k, op in enumerate(ops):
        if isinstance(op, tuple):
            chain_.append((len(chain_) + 1, 90_000 + 100 * len(chain_) + op[0] * 50, op[1]))
            sent += fold.step(*chain_[-1])
        else:
            chain_ = chain_[: max(0, len(chain_) - op)]
            fold.truncate(len(chain_))
            sent = [t for t in sent if t[0] <= len(chain_)]
        if k % every == 0:
            fold.prune()
    fresh, want = WindowFold(widths, cadence), []
    for block in chain_:
        want += fresh.step(*block)
    assert sent == want
    assert (fold.head, fold.last, fold.moves, fold.tails) == (fresh.head, fresh.last, fresh.moves, fresh.tails)


def test_a_truncation_that_goes_too_far_is_refused():
    fold = WindowFold((60,), (1,), undo=3)
    for k in range(1, 30):
        fold.step(k, 100 * k, 1)
        fold.prune()
    assert not fold.truncate(29)
    assert fold.truncate(26)
    with pytest.raises(ValueError, match="new run"):
        fold.truncate(5)


@settings(max_examples=100, deadline=None)
@given(st.permutations(range(1, 13)), st.sets(st.integers(1, 12), max_size=3), st.integers(1, 5))
def test_buffer_gives_heights_in_order(heights, missing, size):
    held, out = {}, []
    buffer = Buffer(held, 1)
    heights = [h for h in heights if h not in missing]
    for at in range(0, len(heights), size):
        for h in heights[at : at + size]:
            buffer.add(h, 10 * h, 1)
            buffer.add(h, 99, 9)  # the first counts
        out += buffer.ready()
    hole = min(missing, default=13)
    assert out == [(h, h, 10 * h, 1) for h in range(1, hole)]
    while held:
        buffer.skip()
        out += buffer.ready()
    assert [r[1] for r in out] == sorted(heights)


def stream_of(spark, at, parts, schema):
    at.mkdir()
    for p, rows in enumerate(parts):
        (at / f"{p}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(at / f"{p}.json", (1_700_000_000 + 10 * p,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(at))


def until(spark, df, name, at, enough, seconds=90):
    """Rows of the query, which is stopped as soon as there are enough."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(at)).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + seconds
        while time.time() < end and q.isActive and spark.table(name).count() < enough:
            time.sleep(0.5)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def test_four_partitions_give_the_ticks_of_one(spark, tmp_path):
    rng, ts, rows = random.Random(3), 0, []
    for _ in range(100):
        ts += rng.randrange(1, 90)
        rows.append((ts, rng.randrange(4)))
    widths, cadence = (60, 600), (2, 5)
    sent = [{"partition": k % 4, "offset": k // 4, "number": k + 1, "ts": t, "n_tx": n} for k, (t, n) in enumerate(rows)]
    parts = [[], [], [], [], []]
    for k, r in enumerate(sent):  # a partition's blocks stay in order, but partitions run ahead of each other
        parts[min(4, k // 25 + (r["partition"] % 2))].append(r)
    for p in parts:
        rng.shuffle(p)
    schema = "partition int, offset long, number long, ts long, n_tx long"
    want = sorted(map(tuple, ticks(table(spark, rows), cadence, widths).collect()))
    got = until(spark, live_ticks(in_height_order(stream_of(spark, tmp_path / "in", parts, schema), wait=600), widths, cadence), "ordered", tmp_path / "ck", len(want))
    assert got == want
    # without the buffer a second partition is refused
    q = live_ticks(stream_of(spark, tmp_path / "in2", parts, schema), widths, cadence).writeStream.format("memory").queryName("refused").option("checkpointLocation", str(tmp_path / "ck2")).start()
    with pytest.raises(Exception, match="in_height_order"):
        q.processAllAvailable()


def test_a_height_that_never_comes_is_given_up(spark, tmp_path):
    rows = [{"partition": k % 2, "offset": k // 2, "number": k, "ts": 10 * k, "n_tx": 1} for k in range(5, 30) if k not in (5, 9, 20, 21)]
    df = in_height_order(stream_of(spark, tmp_path / "in", [rows[:9], rows[9:]], "partition int, offset long, number long, ts long, n_tx long"), start=None, wait=1)
    got = until(spark, df, "given_up", tmp_path / "ck", len(rows))
    assert [r[1] for r in got] == [r["number"] for r in rows]


def test_a_table_follows_a_cut_chain(spark, tmp_path):
    """Truncate, append other blocks: the table of the run equals a fresh run of the final chain, and
    keeps the rows of another run."""
    rng = random.Random(9)
    chain_, sent, ops = [], [], [30, -7, 12, -40, 25, -3, -1, 20]
    for op in ops:
        if op > 0:
            for _ in range(op):
                chain_.append((len(chain_) + 1, (chain_[-1][1] if chain_ else 90_000) + rng.randrange(1, 90), rng.randrange(4)))
                sent.append({"offset": len(sent), "kind": "block", "number": chain_[-1][0], "ts": chain_[-1][1], "n_tx": chain_[-1][2]})
        else:
            chain_ = chain_[: max(0, len(chain_) + op)]
            sent.append({"offset": len(sent), "kind": "truncate", "number": len(chain_)})
    widths, cadence = (60, 300), (1, 3)
    out = {run: sinks.TickTable(spark, str(tmp_path / "table"), run) for run in "ab"}
    schema = "offset long, kind string, number long, ts long, n_tx long"
    parts = [sent[k : k + 17] for k in range(0, len(sent), 17)]
    for run in ("a", "b"):
        df = live_changes(stream_of(spark, tmp_path / run, parts if run == "b" else [sent[:30]], schema), run, widths, cadence, undo=60)
        q = df.writeStream.foreachBatch(sinks.upsert_into(out[run], compact_every=3)).option("checkpointLocation", str(tmp_path / f"ck{run}")).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    fold, want = WindowFold(widths, cadence), []
    for block in chain_:
        want += fold.step(*block)
    got = sorted((r.number, r.win_idx, r.head, r.tail, r.open_win) for r in out["b"].rows().collect())
    assert got == sorted({t[1:4]: t for t in sorted(want)}.values())  # blocks without transfers share a key
    fold, want = WindowFold(widths, cadence), []
    for r in sent[:30]:
        want += fold.step(r["number"], r["ts"], r["n_tx"])
    assert sorted(r.number for r in out["a"].rows().collect()) == sorted(t[0] for t in {t[1:4]: t for t in sorted(want)}.values())
