import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import chain, dictionary, graph


def table(spark, times):
    return spark.createDataFrame([(k + 1, t, f"0x{k + 1:064x}") for k, t in enumerate(times)], "number long, ts long, hash string")


def test_empty_chain(spark):
    b = table(spark, [])
    assert chain.head(b).first().empty
    assert chain.range_status(b, 1, 5).count() == 0
    assert chain.at_or_after(b, 0).count() == 0
    assert chain.start_height(b, 10).count() == 0
    assert tuple(chain.tail_decision(b, 100, 50, 3).first()) == (chain.REBUILD, 0)
    assert chain.truncate_after(b, 3).count() == 0


def test_lookups(spark):
    b = table(spark, [10, 20, 30])
    assert [chain.at_or_after(b, t).first().block_num for t in (0, 20, 21)] == [1, 2, 3]
    assert chain.at_or_after(b, 31).count() == 0
    assert chain.by_hash(b, f" {2:064X}").first().number == 2
    with pytest.raises(ValueError):
        chain.by_number(b, 0)
    with pytest.raises(ValueError):
        chain.at_or_after(b, -1)


def test_ranges(spark):
    b = table(spark, range(10)).where("number <> 6")
    assert tuple(chain.range_status(b, 4, 8).first()) == (4, 8, 2, True, 5)
    assert tuple(chain.range_status(b, 6, 8).first()) == (6, 8, 0, True, 0)
    assert tuple(chain.range_status(b, 8, 50).first()) == (8, 10, 3, False, 10)
    assert tuple(chain.range_status(b, 11, 12).first()) == (11, 10, 0, False, 0)
    for bad in ((0, 1), (5, 4), (1, 2001)):
        with pytest.raises(ValueError):
            chain.range_status(b, *bad)


def test_gap_is_more_than_the_rule(spark):
    b = table(spark, [0, 3, 7])
    assert [r.number for r in chain.gaps(b, 3).collect()] == [3]
    assert chain.first_gap_after(b, 3, 3).count() == 0
    assert chain.gap_rule(0.1) == 1


def test_start_height(spark):
    b = table(spark, [10, 20, 30])
    start = lambda *a: tuple(chain.start_height(b, *a).first())
    assert start(5, (2, f"{2:064X}")) == (3, "resume")
    assert start(5, (2, f"0x{3:064x}")) == (3, "backfill")
    assert start(15, (2, "")) == (2, "backfill")
    assert start(-1) == (3, "head")
    assert start(10**6) == (1, "backfill")


def decided(times, now, backfill, gap):
    """The rules in plain Python."""
    if backfill <= 0:
        return (chain.KEEP, 0)
    if not times:
        return (chain.REBUILD, 0)
    target = now - backfill
    inside = [k for k, t in enumerate(times) if t >= target]
    if not inside:
        return (chain.KEEP, len(times))
    if times[inside[0]] > target + gap:
        return (chain.TRIM, inside[0]) if inside[0] else (chain.REBUILD, 0)
    for k in inside:
        if k and times[k] - times[k - 1] > gap:
            return (chain.TRIM, k)
    return (chain.KEEP, len(times))


def test_tail_decision_equals_model(spark):
    rng = random.Random(5)
    for _ in range(12):
        t, times = 0, []
        for _ in range(rng.randrange(1, 15)):
            t += rng.choice([1, 1, 1, 2, 3, 4, 9])
            times.append(t)
        now, backfill, gap = t + rng.randrange(4), rng.randrange(0, 25), rng.choice([1, 3, 5])
        got = tuple(chain.tail_decision(table(spark, times), now, backfill, gap).first())
        assert got == decided(times, now, backfill, gap), (times, now, backfill, gap)


def test_gap_that_ends_at_the_window(spark):
    b = table(spark, [0, 1, 2, 3, *range(50, 100)])
    assert tuple(chain.tail_decision(b, 100, 51, 3).first()) == (chain.TRIM, 4)
    assert tuple(chain.tail_decision(b, 100, 51, 3, inclusive=False).first()) == (chain.KEEP, 54)


def test_appended_heights_keep_their_first_block(spark):
    b = chain.append(table(spark, [1, 2]), table(spark, [7, 8, 9]))
    assert sorted((r.number, r.ts) for r in b.collect()) == [(1, 1), (2, 2), (3, 9)]


def test_gap_index(spark):
    old, new = table(spark, [1, 2, 9]), table(spark, [1, 2, 5, 20, 21, 40]).where("number > 2")
    events = chain.gap_events(old, new, 3)
    assert sorted(tuple(r) for r in events.collect()) == [(20, 4), (40, 6)]
    assert chain.gap_events(old, new, 0).count() == 0
    grown = chain.append(old, new)
    assert tuple(chain.seek_gap(events, grown, 20, 3).first()) == (20, 4)
    assert tuple(chain.seek_gap(events, grown, 21, 3).first()) == (40, 6)
    assert chain.seek_gap(events, grown.where("number <> 5"), 21, 3).count() == 0


def test_warm_up(spark):
    got = lambda times, *a: [(r.number, r.ts) for r in chain.warm_up(table(spark, times), *a).orderBy("number").collect()]
    assert got([], 100, 10, 2) == [(1, 90), (2, 92), (3, 94), (4, 96)]
    assert got([95], 100, 10, 2) == [(2, 97)]
    assert got([99], 100, 10, 2) == []


def test_first_seen_ids_with_bad_addresses(spark):
    a, b, c = "a" * 40, "b" * 40, "c" * 40
    rows = [(0, a, "x", "T"), (1, "bad", b, "T"), (2, "0x" + c.upper(), b, ""), (3, b, b, "t")]
    flat = spark.createDataFrame([(i, 0, s, r, t, 1) for i, s, r, t in rows], "idx long, ts long, sender string, receiver string, token string, amount long")
    assert {r.addr: r.id for r in dictionary.address_ids(flat).collect()} == {a: 1, c: 2, b: 3}
    assert {r.tok: r.id for r in dictionary.token_ids(flat).collect()} == {"t": 1}
    for keep in (True, False):  # one pass for both kinds gives the same ids
        both = dictionary.dictionaries(flat, keep)
        assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, dictionary.address_ids(flat, keep).collect()))
        assert sorted(map(tuple, both[1].collect())) == sorted(map(tuple, dictionary.token_ids(flat, keep).collect()))
    assert {r.tok: r.id for r in dictionary.token_ids(flat, False).collect()} == {"T": 1, "t": 2}
    assert {r.addr: r.id for r in dictionary.address_ids(flat, False).collect()} == {a: 1, b: 2, c: 3}
    e = dictionary.encoded(flat, dictionary.address_ids(flat), dictionary.token_ids(flat)).orderBy("idx").collect()
    assert [(r.idx, r.from_id, r.to_id, r.token_id) for r in e] == [(2, 2, 3, 0), (3, 3, 3, 1)]


def test_edge_stays_until_its_last_transfer_leaves(spark):
    events = spark.createDataFrame([(0, 0, 1, 2), (1, 5, 1, 2), (2, 5, 3, 3), (3, 30, 2, 1)], "idx long, ts long, from_id long, to_id long")
    blocks = spark.createDataFrame([(0,), (5,), (12,), (16,), (30,)], "ts long")
    assert {r.ts: r.n_edges for r in graph.active_edges(events, blocks, 10).collect()} == {0: 1, 5: 2, 12: 2, 16: 0, 30: 1}
    ticks = spark.createDataFrame([(0, 3, 1), (0, 4, 4)], "win_idx int, head long, tail long")
    assert [tuple(r) for r in graph.edge_counts(ticks, events).collect()] == [(0, 3, 1, 2, 2)]


def test_strong_components(spark, tmp_path):
    rng = random.Random(3)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for s, t in edges:
            for n in nodes:
                if s in reach[n]:
                    reach[n].add(t)
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    got = graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long"), str(tmp_path))
    assert {r.node: r.component for r in got.collect()} == want


def test_strong_components_of_long_paths(spark):
    """A path of 60 hops, a cycle of 30 nodes, a lone node with an edge to itself, and nothing."""
    edges = [(k, k + 1) for k in range(60)] + [(1000 + k, 1000 + (k + 1) % 30) for k in range(30)] + [(5, 1007), (7777, 7777)]
    got = graph.strong_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {k: k for k in range(61)} | {1000 + k: 1000 for k in range(30)} | {7777: 7777}
    assert graph.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_append_keeps_the_first_of_a_height(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "number long, ts long")
    new = spark.createDataFrame([(2, 21, 1), (3, 31, 3), (3, 30, 2), (3, 31, 4)], "number long, ts long, offset long")
    assert sorted(map(tuple, chain.append(old, new).collect())) == [(1, 10), (2, 20), (3, 30)]
    assert sorted(map(tuple, chain.append(old, new.drop("offset")).collect())) == [(1, 10), (2, 20), (3, 30)]
    late = new.withColumn("offset", -F.col("offset"))
    assert sorted(map(tuple, chain.append(old, late).collect())) == [(1, 10), (2, 20), (3, 31)]
    assert [tuple(r) for r in chain.gap_events(old, new, 5).collect()] == [(30, 3)]


def test_warm_up_is_a_range(spark):
    plan = chain.warm_up(table(spark, [5]), 400_000_000, 31_536_000 * 10, 1)
    assert plan.agg(F.count("*")).first()[0] == 315_360_000 - 1
