import json
import os
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import graph as batch
from tidewell.plans import windows
from tidewell.streaming import graph
from tidewell.streaming.graph import MAPS, EdgeChanges, EdgeCounts, EmitMove, Entries, RankTree, TopSenders, WindowGraph, live_graph, live_merged
from tidewell.streaming.ticks import live_moves


class Stored:
    """A map of the state store that counts what is read and written."""

    def __init__(self):
        self.rows, self.uses = {}, 0

    def getValue(self, key):
        self.uses += 1
        return self.rows.get(key)

    def containsKey(self, key):
        return key in self.rows

    def updateValue(self, key, value):
        self.uses += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.uses += 1
        del self.rows[key]


def resumed(states, totals, late=()):
    g = WindowGraph({n: Entries(x) for n, x in states.items()}, totals)
    g.late = list(late)
    return g


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=60),
    st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 3)), max_size=25),
    st.sampled_from([1, 3, 256]),
)
def test_graph_holds_what_is_in_the_window(edges, steps, span):
    """Over restarts, with events that come late or twice: as a look at all transfers of the window."""
    before = graph.SPAN
    graph.SPAN = span
    try:
        states, totals, late = {n: Stored() for n in MAPS}, None, []
        head = tail = sent = 0
        come, inside = set(), set()
        for k, (up, off, lag) in enumerate(steps):
            g = resumed(states, totals, late)
            new = list(range(max(0, sent - lag), min(sent + up, len(edges))))
            if lag == 2 and new:  # one is missing for now
                new = new[1:]
            g.hold([(i, *edges[i]) for i in new])
            come |= {i for i in new if i >= tail}
            sent = max(sent, min(sent + up, len(edges)))
            if lag != 3:  # else no move in this batch
                old = set(inside)
                head = min(head + up, sent)
                tail = min(tail + off, head)
                g.move(k + 1, head, tail)
                inside = {i for i in come if tail <= i < head}
                came, went = {edges[i] for i in inside} - {edges[i] for i in old}, {edges[i] for i in old} - {edges[i] for i in inside}
                assert g.changes == dict.fromkeys(came, 1) | dict.fromkeys(went, -1)
            for m in g.maps.values():
                m.flush()
            totals, late = g.totals(), g.late
            g = resumed(states, totals, late)
            there = sorted(inside)
            assert [i for i, *_ in g.transfers() if i not in {x for x, *_ in late}] == there
            assert (g.n_tx, g.n_edges) == (len(there), len({edges[i] for i in there}))
            out = {}
            for i in there:
                out[edges[i][0]] = out.get(edges[i][0], 0) + 1
            assert g.top_senders(3) == sorted(out.items(), key=lambda x: (-x[1], x[0]))[:3]
            for a in range(5):
                assert sorted(g.receivers(a)) == sorted({edges[i][1] for i in there if edges[i][0] == a})
                assert sorted(g.senders(a)) == sorted({edges[i][0] for i in there if edges[i][1] == a})
                assert (g.out_degree(a), g.in_degree(a)) == (out.get(a, 0), sum(edges[i][1] == a for i in there))
                for b in range(5):
                    assert g.count(a, b) == sum(edges[i] == (a, b) for i in there)
                    if not late:
                        assert g.evidence(a, b) == [i for i in there if edges[i] == (a, b)]
        g = resumed(states, totals, late)
        g.move(99, sent, sent)
        for m in g.maps.values():
            m.flush()
        assert all(not states[n].rows for n in ("edges", "nodes", "near"))  # nothing is left behind
    finally:
        graph.SPAN = before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 5)), max_size=60), st.integers(1, 8))
def test_rank_tree(changes, n):
    tree, want = RankTree(Entries()), {}
    for place, degree in changes:
        tree.set(place, degree, place + 7)
        want[place + 7] = degree
        assert tree.first(n) == sorted(((i, d) for i, d in want.items() if d), key=lambda x: (-x[1], x[0]))[:n]


def test_a_block_costs_the_same_however_much_the_window_holds():
    """Uses of the state for one block: 75 transfers come, 75 go, the top senders are asked for."""
    used = {}
    for n in (2_000, 20_000, 60_000):
        rng = random.Random(1)
        states = {name: Stored() for name in MAPS}
        g = resumed(states, None)
        edge = lambda i, r=rng: (i, r.randrange(n), r.randrange(n))
        for at in range(0, n, 5000):
            g.hold([edge(i) for i in range(at, min(at + 5000, n))])
        g.move(1, n, 0)
        for m in g.maps.values():
            m.flush()
        start = sum(s.uses for s in states.values())
        g = resumed(states, g.totals())
        g.hold([edge(i) for i in range(n, n + 75)])
        g.move(2, n + 75, 75)
        g.top_senders(5)
        for m in g.maps.values():
            m.flush()
        used[n] = sum(s.uses for s in states.values()) - start
    assert max(used.values()) < 1.6 * used[2_000], used


def run(spark, df, name, at):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(at)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def files(at, parts):
    """Parts of JSON lines, read one a batch in order."""
    at.mkdir()
    for p, rows in enumerate(parts):
        (at / f"{p}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(at / f"{p}.json", (1_700_000_000 + 10 * p,) * 2)
    return str(at)


def test_live_graph_equals_batch(spark, tmp_path):
    rng, ts, blocks, events = random.Random(8), 0, [], []
    for k in range(60):
        ts += rng.randrange(1, 60)
        n = rng.randrange(1, 4)
        blocks.append({"offset": k, "number": k + 1, "ts": ts, "n_tx": n})
        events += [{"idx": len(events) + j, "ts": ts, "from_id": rng.randrange(5), "to_id": rng.randrange(5)} for j in range(n)]
    widths = (100, 400)
    schema = "offset long, number long, ts long, n_tx long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(files(tmp_path / "blocks", [blocks[:20], blocks[20:45], blocks[45:] + blocks[:3]]))
    moves = run(spark, live_moves(stream, widths), "moves", tmp_path / "ck1")
    table = spark.createDataFrame([(b["number"], b["ts"], b["n_tx"]) for b in blocks], "number long, ts long, n_tx long")
    want = windows.moves(table, widths).select("number", "win_idx", "head", "tail", "open_win")
    assert sorted(map(tuple, moves.collect())) == sorted(map(tuple, want.collect()))

    rows = [json.loads(x) for x in moves.toJSON().collect()]
    heads = {r["number"]: r["head"] for r in rows}
    cuts = [(0, 25), (25, 50), (50, 61)]
    moved = files(tmp_path / "moves", [[r for r in rows if a < r["number"] <= b] for a, b in cuts])
    sent = files(tmp_path / "events", [[e for e in events if heads.get(a, 0) <= e["idx"] < heads[min(b, 60)]] for a, b in cuts])
    m = spark.readStream.schema("number long, win_idx int, head long, tail long, open_win boolean").option("maxFilesPerTrigger", 1).json(moved)
    e = spark.readStream.schema("idx long, ts long, from_id long, to_id long").option("maxFilesPerTrigger", 1).json(sent)
    opened = want.where("open_win")
    assert opened.count() > 20
    table = spark.createDataFrame(events, "idx long, ts long, from_id long, to_id long")

    counts = run(spark, live_graph(m, e, EdgeCounts(), 2, 3), "counts", tmp_path / "ck2").groupBy("number", "win_idx").agg(F.sum("n_edges").alias("e"), F.sum("n_tx").alias("t"))
    by = batch.edge_counts(opened, table).join(opened, ["win_idx", "head", "tail"]).select("number", "win_idx", F.col("n_edges").alias("e"), F.col("n_tx").alias("t"))
    assert sorted(map(tuple, counts.where("t > 0").collect())) == sorted(map(tuple, by.collect()))

    top = run(spark, live_graph(m, e, TopSenders(9), 2, 3), "top", tmp_path / "ck3").select("number", "win_idx", "node", "out_degree")
    by = batch.degrees(opened, table).where("out_degree > 0").join(opened.select("number", "win_idx", "head").distinct(), ["win_idx", "head"]).select("number", "win_idx", "node", "out_degree")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, by.collect()))

    bounds = run(spark, live_graph(m, e, EmitMove(), 2, 1), "bounds", tmp_path / "ck4").select("number", "win_idx", "head", "tail", "open_win")
    assert sorted(map(tuple, bounds.collect())) == sorted(map(tuple, opened.collect()))

    whole = run(spark, live_merged(m, e, EdgeCounts(), 2, 3), "whole", tmp_path / "ck5")
    assert sorted(map(tuple, whole.select("number", "win_idx", F.col("n_edges"), F.col("n_tx")).where("n_tx > 0").collect())) == sorted(map(tuple, counts.where("t > 0").collect()))
    first = run(spark, live_merged(m, e, TopSenders(2), 2, 3), "first", tmp_path / "ck6")
    best = batch.top_out_degree(opened, table, 2).join(opened.select("number", "win_idx", "head").distinct(), ["win_idx", "head"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, best.select("number", "win_idx", "node", "out_degree").collect()))

    # the changes of a window, summed up, are its edges after every move; before the gate opens none are told
    came = run(spark, live_merged(m.withColumn("open_win", F.lit(True)), e, EdgeChanges(), 2, 3), "came", tmp_path / "ck7").where("win_idx = 0").collect()
    evidence = batch.evidence(want.select("win_idx", "head", "tail").where("win_idx = 0"), table).collect()
    edges = {}
    for r in evidence:
        edges.setdefault(r["head"], set()).add((r["from_id"], r["to_id"]))
    now = set()
    for number, head in sorted(heads.items()):
        for r in [r for r in came if r["number"] == number]:
            (now.add if r["change"] == 1 else now.remove)((r["from_id"], r["to_id"]))
        assert now == edges.get(head, set())
