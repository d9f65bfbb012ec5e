import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidewell.operators import chain
from tidewell.sources import checkpoint, generator, messages, miner, spool, store
from tidewell.sources.rpc import ChainSource, Client, Page, fetched
from tidewell.streaming import jdbc, sinks


@pytest.fixture(scope="module")
def made(spark):
    """Blocks as on the wire, from the generator."""
    b = generator.schedule(spark, 1000, 30, 10)
    return generator.block_messages(b, generator.transfers(b, 20, seed=3), seed=3).cache()


def test_generator_is_repeatable_and_linked(spark, made):
    b = generator.schedule(spark, 1000, 30, 10)
    again = generator.block_messages(b, generator.transfers(b.repartition(5), 20, seed=3), seed=3)
    assert {r.hash for r in again.collect()} == {r.hash for r in made.collect()}
    flat = made.select("number", F.col("hash"), F.col("header.parent_hash").alias("parent_hash"))
    assert chain.linked(flat).count() == 0
    assert chain.linked(flat.withColumn("hash", F.lit("0x"))).count() == 29
    sizes = [len(r.txs) for r in made.collect()]
    assert min(sizes) >= 50 and max(sizes) <= 99
    txs = generator.transfers(b, 20, seed=3)
    loops = txs.agg(F.avg((F.col("sender") == F.col("receiver")).cast("int"))).first()[0]
    assert 0.05 < loops < 0.15
    assert txs.agg(F.min("amount"), F.max("amount")).first()[1] <= 1000
    assert generator.addresses(spark, 50).select("addr").distinct().count() == 50


def test_messages_round_trip(spark, made):
    sent = messages.encode(made).select(F.col("key").cast("long").alias("offset"), "value")
    bad = spark.createDataFrame([(98, "{broken"), (99, '{"header": {"number": "x"}}'), (0, "{}")], "offset long, value string")
    got = messages.block_rows(messages.decode(sent.union(bad), base=1))
    assert got.count() == 30
    assert got.agg(F.sum("n_tx")).first()[0] == made.agg(F.sum(F.size("txs"))).first()[0]
    empty = spark.createDataFrame([(5, '{"header": {}}')], "offset long, value string")
    assert tuple(messages.block_rows(messages.decode(empty)).drop("txs").first()) == (5, 0, 0, 0, None)
    opts = messages.kafka_options("h:1", "t", since_ms=5, group="g")
    assert opts["startingTimestamp"] == "5" and "startingOffsets" not in opts
    assert messages.producer_options("h:1", "t")["kafka.acks"] == "all"
    raw = spark.createDataFrame([(0, 5), (0, 3), (1, 9)], "partition int, offset long")
    assert sorted(tuple(r) for r in messages.first_seen(raw).collect()) == [(0, 3), (1, 9)]


class Recorded:
    """Stands for a session's or a table's reader or writer and keeps the calls."""

    def __init__(self):
        self.calls, self.columns = [], ["key", "value", "timestamp"]

    def __getattr__(self, name):
        if name in ("readStream", "writeStream"):
            return self

        def call(*args, **named):
            self.calls.append((name, args, named))
            return self

        return call

    def of(self, name):
        return next((a or n) for k, a, n in self.calls if k == name)


def test_kafka_readers_and_writers(spark):
    read = messages.replay_kafka(Recorded(), "h:9092", "blocks", now=1_700_000_000, group="g")
    assert read.of("format") == ("kafka",) and read.calls[-1][0] == "load"
    want = {"kafka.bootstrap.servers": "h:9092", "subscribe": "blocks", "startingTimestamp": "1699913600000", "kafka.group.id": "g", "maxOffsetsPerTrigger": "8192"}
    assert want.items() <= read.of("options").items()
    written = messages.write_kafka(Recorded(), "h:9092", "out", "/ck")
    assert written.of("format") == ("kafka",) and written.of("option") == ("checkpointLocation", "/ck")
    assert written.of("options")["topic"] == "out" and written.of("options")["kafka.enable.idempotence"] == "true"
    assert len(written.of("select")) == 2


def test_watching_messages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"partition": 1, "offset": 7, "value": "seen here"}\n')
    q = messages.watch(messages.read_files(spark, str(tmp_path / "in"))).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert q.lastProgress["numInputRows"] <= 1 and q.exception() is None
    finally:
        q.stop()


@pytest.fixture(scope="module")
def server(made):
    blocks = {r.number: json.loads(r.value) for r in made.select("number", F.to_json(F.struct("header", "hash", "txs")).alias("value")).collect()}
    holes: set[int] = set()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            url = urlparse(self.path)
            q = {k: int(v[0]) for k, v in parse_qs(url.query).items()}
            if url.path == "/chain/head":
                out = {"head_num": 30, "head_hash": blocks[30]["hash"], "head_timestamp": blocks[30]["header"]["timestamp"]}
            elif url.path == "/block/at-or-after":
                out = {"block_num": min(n for n, b in blocks.items() if b["header"]["timestamp"] >= q["ts"])}
            elif url.path == "/blocks/range":
                out = {"blocks": [blocks[n] for n in range(q["from"], q["to"] + 1) if n not in holes], "partial": bool(holes)}
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", holes
    http.shutdown()


def test_rpc_batch_and_stream(spark, server, tmp_path):
    url, holes = server
    spark.dataSource.register(ChainSource)
    b = spark.read.format("chain_rpc").options(url=url, page=7).load()
    assert [r.number for r in b.orderBy("number").collect()] == list(range(1, 31))
    assert b.select(F.sum("n_tx")).first()[0] > 30 * 50
    s = spark.readStream.format("chain_rpc").options(url=url, page=4, backfill=95, maxHeightsPerTrigger=6).load()
    q = s.writeStream.format("memory").queryName("rpc").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r.number for r in spark.table("rpc").collect()) == list(range(21, 31))
    holes.add(5)
    try:
        with pytest.raises(RuntimeError, match="height 5"):
            list(fetched(Client(url), Page(3, 8)))
    finally:
        holes.clear()
    with pytest.raises(Exception, match="page must be"):
        spark.read.format("chain_rpc").options(url=url, page=2001).load().count()


def test_heights_already_produced_are_skipped():
    """A server may answer from an earlier height, or repeat one."""

    class Server:
        def blocks(self, start, end):
            return {"blocks": [{"header": {"number": n, "timestamp": 10 * n}, "hash": f"h{k}"} for k, n in enumerate([1, 2, 3, 3, 2, 4, 5, 6])]}

    got = [r[:3] for r in fetched(Server(), Page(3, 5))]
    assert got == [(3, 30, "h2"), (4, 40, "h5"), (5, 50, "h6")]
    with pytest.raises(RuntimeError, match="height 7"):
        list(fetched(Server(), Page(3, 8)))


def test_stored_tables_and_the_shared_folder(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("b"))
    table = store.stored(df, str(tmp_path / "t"))
    assert table.dtypes == df.dtypes and sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))
    at = store.scratch(spark, "kind")
    assert at.startswith(store.shared_dir(spark)) and at != store.scratch(spark, "kind")
    store.stored(df, at)
    store.drop(spark, at)
    assert not os.path.exists(at.removeprefix("file:"))

    class Context:
        applicationId, _jsc = "app-1", spark.sparkContext._jsc

        def __init__(self, master):
            self.master = master

        def getConf(self):
            return {}

    class Session:
        conf = {}

        def __init__(self, master):
            self.sparkContext = Context(master)

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        own = store.shared_dir(Session("local[4]"))
        assert own == store.shared_dir(Session("local"))
        for cluster in ("local-cluster[2,1,1024]", "yarn", "spark://h:7077"):
            with pytest.raises(RuntimeError, match="checkpoint.dir"):
                store.shared_dir(Session(cluster))


def test_envelopes_and_upserts(spark, tmp_path):
    rows = spark.createDataFrame([(0, 5, 1, True), (0, 5, 1, False), (1, 9, 2, True)], "win_idx int, head long, tail long, open_win boolean")
    sent = sinks.as_messages(sinks.envelope(rows.limit(1), "win_tick", rows.columns, now_ms=F.lit(7)))
    assert json.loads(sent.first().value) == {"type": "win_tick", "ts": 7, "data": {"win_idx": 0, "head": 5, "tail": 1, "open_win": True}}
    odd = spark.createDataFrame([('{"type":"other","data":{}}',), ("{",), ('{"type":"win_tick","data":{"head":"x"}}',), ('{"type":"win_tick","data":{"head":3}}',)], "value string")
    assert sorted(tuple(r) for r in sinks.demux(sent.union(odd)).collect()) == [(0, 3, 0, False), (0, 5, 1, True)]
    table = sinks.TickTable(spark, str(tmp_path / "t"))
    table.ensure_schema()
    assert table.read().count() == 0
    table.upsert(rows.filter("win_idx = 1"))
    again = spark.createDataFrame([(1, 9, 2, False), (2, 1, 0, True)], rows.schema)
    want = [(1, 9, 2, False), (2, 1, 0, True)]
    for _ in range(2):
        table.upsert(again, 1)
    assert [n for _, n in table.batches()] == ["batch-0", "batch-1"]
    assert sorted(tuple(r) for r in table.read().collect()) == want
    # a batch that is there is not written again, before a compaction and after it
    other = spark.createDataFrame([(1, 9, 2, True)], rows.schema)
    table.upsert(other, 1)
    table.compact()
    table.upsert(other, 0)
    assert [n for _, n in table.batches()] == ["base-1"]
    assert sorted(tuple(r) for r in table.read().collect()) == want
    # of one key in a batch the last by `seq` counts
    twice = spark.createDataFrame([(1, 9, 2, True, 7), (1, 9, 2, False, 3)], "win_idx int, head long, tail long, open_win boolean, seq long")
    table.upsert(twice.repartition(3), 2, seq="seq")
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 9, 2, True), (2, 1, 0, True)]
    assert table.rows().where("ts is null").count() == 0
    last = sinks.keep_last(rows.withColumn("n", F.monotonically_increasing_id()), ["win_idx", "head", "tail"], "n")
    assert sorted((r.win_idx, r.open_win) for r in last.collect()) == [(0, False), (1, True)]


def test_ticks_in_a_database(spark):
    ticks = jdbc.JdbcTicks(spark, "jdbc:derby:memory:ticks;create=true")
    for _ in range(2):
        ticks.ensure_schema()
    rows = spark.createDataFrame([(0, 5, 1, True, 2), (0, 5, 1, False, 1), (1, 9, 2, True, 3)], "win_idx int, head long, tail long, open_win boolean, seq long")
    ticks.upsert(rows.repartition(2), "seq")
    before = {r.WIN_IDX: r.TS for r in ticks.read().collect()}
    for _ in range(2):
        ticks.upsert(spark.createDataFrame([(1, 9, 2, False), (2, 7, 0, True)], "win_idx int, head long, tail long, open_win boolean"))
    got = sorted((r.WIN_IDX, r.HEAD, r.TAIL, r.OPENWIN) for r in ticks.read().collect())
    assert got == [(0, 5, 1, True), (1, 9, 2, False), (2, 7, 0, True)]
    after = {r.WIN_IDX: r.TS for r in ticks.read().collect()}
    assert after[0] == before[0] and after[1] > before[1]


def test_database_addresses(monkeypatch):
    assert jdbc.options("postgres://u:p%40ss@db:5433/web?sslmode=disable") == {"url": "jdbc:postgresql://db:5433/web?sslmode=disable", "driver": "org.postgresql.Driver", "numPartitions": "8", "user": "u", "password": "p@ss"}
    monkeypatch.setenv("PG_DSN", "postgresql://db/x")
    assert jdbc.options()["url"] == "jdbc:postgresql://db:5432/x"
    monkeypatch.delenv("PG_DSN")
    for bad in (None, " ", "mysql://db/x", "postgres://db"):
        with pytest.raises(ValueError):
            jdbc.options(bad)


def test_spool_writer(spark, tmp_path):
    path = tmp_path / "own.spool"
    with spool.Spool(str(path)) as out:
        out.append(0, 5, b"{}")
        out.append(1, -1, b"")
    path.write_bytes(path.read_bytes() + spool.packed(0, 6, b"cut")[:-1])
    with spool.Spool(str(path)) as out:
        out.append(0, 7, b"after")
    assert list(spool.records(path.read_bytes())) == [(0, 5, b"{}"), (1, -1, b""), (0, 7, b"after")]


def test_miner_never_goes_back():
    now = iter([100.0, 100.2, 101.5, 90.0, 90.5, 91.5, 300.0])
    reader = miner.MinerReader({"tick": "1", "head": "7", "ts": "99"}, clock=lambda: next(now))
    at, got = reader.initialOffset(), []
    for _ in range(7):
        rows, end = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(at, end))
        got, at = got + rows, end
    assert got == [(8, 100), (9, 101), (10, 102), (11, 103), (12, 300)]


def test_miner_as_a_stream(spark, tmp_path):
    spark.dataSource.register(miner.MinerSource)
    blocks = spark.readStream.format("chain_miner").options(tick=0.2).load()
    txs = generator.transfers(blocks, 50, seed=2).select("number", "ts", "pos", "sender")
    q = txs.writeStream.format("memory").queryName("mined").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(100):
            if q.lastProgress and spark.table("mined").select("number").distinct().count() >= 3:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    got = spark.table("mined").groupBy("number").agg(F.min("ts").alias("ts"), F.max("ts").alias("last"), F.count("*").alias("n")).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, len(got) + 1)) and len(got) >= 3
    assert all(r.ts == r.last and 50 <= r.n <= 99 for r in got)
    assert all(a.ts < b.ts for a, b in zip(got, got[1:], strict=False))


def test_checkpoint_file(tmp_path):
    path = str(tmp_path / "ck")
    assert checkpoint.load(path) is None
    assert [checkpoint.parse(t) for t in ("", " \n", "7", "7\n", " 7 \n 0xab \n")] == [None, None, None, None, (7, "0xab")]
    with pytest.raises(ValueError):
        checkpoint.parse("x\n0xab")
    checkpoint.save(path, 9, "0xcd")
    assert checkpoint.load(path) == (9, "0xcd")


def test_spool(spark, tmp_path):
    whole = spool.packed(0, 5, b"{}") + spool.packed(1, 2**40, b"")
    (tmp_path / "a.spool").write_bytes(whole + spool.packed(0, 6, b"lost")[:-1])
    (tmp_path / "b.spool").write_bytes(b"")
    assert sorted(tuple(r) for r in spool.read(spark, str(tmp_path)).collect()) == [(0, 5, bytearray(b"{}")), (1, 2**40, bytearray())]
