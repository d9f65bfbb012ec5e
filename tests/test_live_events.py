"""Streams of messages: ids and the time index by batch, over restarts; replays, sessions and windows by watermark."""

import json
import os
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import dictionary, graph
from tidewell.plans.prefix import previous
from tidewell.sources import messages, offsets
from tidewell.sources.batches import BatchLog
from tidewell.streaming import bounded
from tidewell.streaming.ids import EventLog, encode_into


def block(rng, number, ts):
    address = lambda: rng.choice([f"0x{rng.randrange(12):040x}", f"{rng.randrange(12):040X}", "bad", " 0X" + "ab" * 20])
    txs = [{"hash": "", "tx_body": {"from": address(), "to": address(), "token": rng.choice(["A", "B", " ", "C "]), "amount": rng.randrange(100), "timestamp": ts}, "block_num": number} for _ in range(rng.randrange(4))]
    return {"header": {"number": number, "parent_hash": "", "timestamp": ts, "tx_root": ""}, "hash": "", "txs": txs}


def sent(seed, n, partitions=1):
    rng, ts, out = random.Random(seed), 1_700_000_000, []
    for k in range(n):
        ts += rng.randrange(1, 900)
        out.append({"partition": k % partitions, "offset": k // partitions, "value": json.dumps(block(rng, k + 1, ts))})
    return out


def files(at, parts, first=0):
    at.mkdir(exist_ok=True)
    for p, rows in enumerate(parts, first):
        (at / f"{p}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(at / f"{p}.json", (1_700_000_000 + 10 * p,) * 2)
    return str(at)


def drain(df, each, at, mode="append"):
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", str(at)).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return q


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ids_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    all_ = sent(1, 60)
    parts = [all_[:7], all_[5:30], all_[30:31], [all_[3]], all_[28:50], all_[50:]]  # some blocks come again
    for k, p in enumerate(parts):  # a replay has a later offset
        parts[k] = [r | {"offset": 100 * k + j} for j, r in enumerate(p)]
    at = tmp_path / "in"
    stream = lambda: messages.block_rows(messages.decode(messages.read_files(spark, str(at))))
    files(at, parts[:3])
    drain(stream(), encode_into(EventLog(spark, str(tmp_path / "log"))), tmp_path / "ck")
    files(at, parts[3:], 3)
    log = EventLog(spark, str(tmp_path / "log"))  # a restart knows its place
    failing = {"left": 1}

    def crash_between(batch, number):
        """The names of a batch are there, its transfers are not: the batch runs again."""
        if failing["left"] and number == 4:
            failing["left"] = 0
            publish = log.sent.publish
            log.sent.publish = lambda *a, **k: (_ for _ in ()).throw(OSError("lost"))
            try:
                log.append(batch, number)
            except OSError:
                pass
            finally:
                log.sent.publish = publish
        log.append(batch, number)

    drain(stream(), crash_between, tmp_path / "ck")
    assert not failing["left"] and len(log.sent.batches()) == 6
    log.append(spark.createDataFrame([], stream().schema), 3)  # a batch that is there changes nothing

    whole = spark.createDataFrame([(r["offset"], r["value"]) for r in all_], "offset long, value string")
    rows = messages.block_rows(messages.decode(whole))
    total = [0]
    for r in rows.orderBy("number").collect():
        total.append(total[-1] + r["n_tx"])
    rel = spark.createDataFrame([(k + 1, v) for k, v in enumerate(total[:-1])], "number long, rel long")
    flat = dictionary.flatten_json(rows.join(rel, "number").select(F.struct("number", F.col("ts").alias("timestamp")).alias("header"), "txs", "rel"))
    ids = dictionary.dictionaries(flat)
    assert [rows_of(d) for d in log.dictionaries()] == [rows_of(d) for d in ids]
    want = rows_of(dictionary.encoded(flat, *ids))
    assert rows_of(log.events()) == want and len(want) > 20

    q = log.stream().writeStream.format("memory").queryName("encoded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert rows_of(spark.table("encoded")) == want


def test_a_replay_begins_at_a_block_time(spark, tmp_path):
    all_ = sent(2, 80, partitions=4)
    at, table = tmp_path / "in", str(tmp_path / "index")
    files(at, [all_[:33], all_[33:]])
    stream = messages.block_rows(messages.decode(messages.read_files(spark, str(at))))
    drain(stream, offsets.index_into(spark, table), tmp_path / "ck")
    offsets.index_into(spark, table)(spark.createDataFrame([], stream.schema), 0)  # run again: no change
    index = offsets.read_index(spark, table)
    assert index.count() == 80
    times = {(r["partition"], r["offset"]): json.loads(r["value"])["header"]["timestamp"] for r in all_}
    for since in (0, sorted(times.values())[30], sorted(times.values())[-2], 2_000_000_000):
        starts = {r["partition"]: r["offset"] for r in offsets.starting_offsets(index, since).collect()}
        want = {p: min((o for (q, o), t in times.items() if q == p and t >= since), default=20) for p in range(4)}
        assert starts == want
        kept = offsets.from_offsets(spark.createDataFrame(all_, "partition int, offset long, value string"), offsets.starting_offsets(index, since))
        assert {(r["partition"], r["offset"]) for r in kept.collect()} == {k for k, t in times.items() if t >= since}
    assert json.loads(offsets.kafka_offsets("t", offsets.starting_offsets(index, 0))) == {"t": {"0": 0, "1": 0, "2": 0, "3": 0}}
    assert messages.kafka_options("s", "t", offsets="{}") == {"kafka.bootstrap.servers": "s", "subscribe": "t", "failOnDataLoss": "true", "startingOffsets": "{}", "maxOffsetsPerTrigger": "8192"}


def test_a_batch_is_published_once(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    assert log.read("x long").count() == 0
    log.publish(spark.range(3).select(F.col("id").alias("x")), 0, (7, 9))
    log.publish(spark.range(9).select(F.col("id").alias("x")), 0, (8, 9))
    log.publish(spark.range(2).select(F.col("id").alias("x")), 10)
    assert log.batches() == {0: (7, 9), 10: ()}
    assert log.read("x long").count() == 5


def test_replays_are_dropped_while_the_state_stays_flat(spark, tmp_path):
    day = [{"number": k, "ts": 1_700_000_000 + 600 * k, "n_tx": 1} for k in range(1, 601)]
    parts = []
    for k in range(0, 600, 60):
        parts.append([*day[k : k + 60], *day[max(0, k - 20) : k], *day[k : k + 5]])  # heights come again, in the batch too
    parts.append([day[3], *day[598:]])  # long behind the watermark, and the last two again
    schema = "number long, ts long, n_tx long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(files(tmp_path / "in", parts))
    q = bounded.without_replays(stream, delay=24_000).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    late, held = bounded.late_rows(q), bounded.state_rows(q)
    q.stop()
    assert rows_of(spark.table("once")) == sorted(((r["number"], r["ts"], r["n_tx"]) for r in day), key=repr)
    assert late == 1
    assert max(held) < 240 and max(held[6:]) <= max(held[3:6]) + 5


def transfers(seed, n):
    rng, ts, out = random.Random(seed), 1_700_000_000, []
    for k in range(n):
        ts += rng.choice([0, 60, 600, 3600, 20_000])
        out.append((k, ts, rng.choice([1, 1, 1, 2, 3]), rng.randrange(4), rng.randrange(50)))
    return out


def test_sessions_and_windows_of_a_stream_equal_the_table(spark, tmp_path):
    rows = transfers(5, 200)
    schema = "idx long, ts long, from_id long, to_id long, amount long"
    table = spark.createDataFrame(rows, schema)
    names = [x.split()[0] for x in schema.split(", ")]
    parts = [[dict(zip(names, r, strict=True)) for r in rows[k : k + 40]] for k in range(0, 200, 40)]
    for p in parts:
        random.Random(1).shuffle(p)
    end = [{"idx": 999, "ts": rows[-1][1] + 10**7, "from_id": 99, "to_id": 0, "amount": 0}]  # moves the watermark past all
    stream = lambda at: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(files(tmp_path / at, [*parts, end]))
    for name, live, want in (
        ("sessions", bounded.live_sessions(stream("a"), 3600, 10**6), graph.sender_sessions(table, 3600)),
        ("tumbling", bounded.live_windows(stream("b"), 7200, 10**6), graph.sender_windows(table, 7200)),
    ):
        q = live.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert rows_of(spark.table(name).where("from_id <> 99")) == rows_of(want)


def test_sessions_equal_a_loop(spark):
    rows = transfers(6, 150)
    got = rows_of(graph.sender_sessions(spark.createDataFrame(rows, "idx long, ts long, from_id long, to_id long, amount long"), 3600))
    want = []
    for sender in {r[2] for r in rows}:
        own = sorted((r[1], r[4]) for r in rows if r[2] == sender)
        start = last = own[0][0]
        n = total = 0
        for ts, amount in own:
            if ts - last > 3600:
                want.append((sender, start, last + 3600, n, total))
                start, n, total = ts, 0, 0
            last, n, total = ts, n + 1, total + amount
        want.append((sender, start, last + 3600, n, total))
    assert got == sorted(want, key=repr)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=60), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25), st.integers(1, 40))
def test_counts_at_ticks_equal_a_look_at_each_window(spark, events, steps, stretch):
    events = [(i, a, b) for i, (kept, a, b) in enumerate(events) if kept]  # dropped transfers leave holes
    ticks, head, tail = [], 0, 0
    for k, (up, off) in enumerate(steps):
        head = head + up
        tail = min(tail + off, head)
        ticks.append((k % 2, head, tail))
    before = graph.STRETCH
    graph.STRETCH = stretch
    try:
        t = spark.createDataFrame(ticks, "win_idx int, head long, tail long")
        e = spark.createDataFrame(events, "idx long, from_id long, to_id long")
        found = [(rows_of(graph.edge_counts(t, e, spread)), rows_of(graph.degrees(t, e, spread))) for spread in (-1.0, 1e9)]
    finally:
        graph.STRETCH = before
    want, of_nodes = [], []
    for w, h, a in sorted(set(ticks)):
        inside = [x for x in events if a <= x[0] < h]
        if inside:
            want.append((w, h, a, len({x[1:] for x in inside}), len(inside)))
            of_nodes += [(w, h, a, n, sum(x[1] == n for x in inside), sum(x[2] == n for x in inside)) for n in {x[1] for x in inside} | {x[2] for x in inside}]
    for got, degrees in found:  # by counting, and by meeting every tick
        assert got == sorted(want, key=repr)
        assert degrees == sorted(((w, h, n, o, i) for w, h, _, n, o, i in of_nodes), key=repr)


@pytest.mark.parametrize("stretch", [1, 4, 1000])
def test_the_row_before_of_a_hot_key(spark, stretch):
    rng = random.Random(2)
    rows = [(k, rng.choice("aaab"), k * k) for k in sorted(rng.sample(range(100), 50))]
    got = {r.i: r.prev_v for r in previous(spark.createDataFrame(rows, "i long, k string, v long"), ["k"], "i", ["v"], stretch).collect()}
    assert got == {i: next((v for j, c, v in reversed(rows) if j < i and c == k), None) for i, k, _ in rows}
