"""SimHash against plain Python: fingerprints by loops, links by comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tidewell.llm import queries, simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    grams = [" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, distance=2):
    """[(doc_id, fingerprint, component_id)] of (doc_id, fingerprint)."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, f) in enumerate(rows):
        for j in range(i):
            if bin(f ^ rows[j][1]).count("1") <= distance:
                root[find(i)] = find(j)
    out = []
    for i, (doc, f) in enumerate(rows):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((doc, f"{f:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def texts(seed=5, n=60):
    draw = random.Random(seed)
    vocabulary = [draw.choice(["Été", "zwölf", "x", "A" * 40, "word"]) + str(k) for k in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (None, ""), (3, "one"), (4, "One TWO"), (5, "one two"), (None, "one two"), (6, "a b c"), (7, "a b c d"), (8, "a\x0bb\x0cc  d")]
    for k in range(10, 10 + n):
        w = [draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 40, 200, 900]))]
        rows.append((k, " ".join(w)))
        if k % 3 == 0:  # near copies: one word more at the end, another space
            rows += [(1000 + k, "  ".join(w) + " tail"), (2000 + k, " ".join(w).upper())]
    rows += [rows[-1], (rows[-1][0], "another text under that id")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def result(df):
    return sorted([(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()], key=repr)


@pytest.mark.parametrize(("most", "slab"), [(simhash.MOST, 1 << 16), (1, 7)])
def test_components_equal_plain_python(spark, monkeypatch, most, slab):
    monkeypatch.setattr(simhash, "SLAB", slab)
    rows = texts()
    got = result(simhash.component_ids(frame(spark, rows).repartition(3), most=most))
    want = components([(d, fingerprint(t)) for d, t in rows])
    assert got == want
    assert len({c for *_, c in want}) < len({f for _, f, _ in want})  # some fingerprints are linked


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB é\t", max_size=30), max_size=6), st.integers(1, 4))
def test_fingerprints_of_any_text(rows, n):
    raw = [t.encode() for t in rows]
    got = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), n)
    assert [int(x) & (1 << 64) - 1 for x in got] == [fingerprint(t, n) for t in rows]


def crowd(draw, n):
    """Fingerprints in two dense balls, in chains and at random."""
    found = {draw.getrandbits(64) for _ in range(n)}
    for centre in (0, draw.getrandbits(64)):
        for _ in range(n):
            found.add(centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(5))}))
    x = draw.getrandbits(64)
    for _ in range(n):
        x ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize(("distance", "parts", "most"), [(2, 5, 64), (2, 5, 1), (2, 3, 3), (1, 4, 2), (3, 6, 4), (0, 2, 1)])
def test_links_connect_all_close_pairs(spark, distance, parts, most):
    prints = crowd(random.Random(distance * 10 + most), 40)
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.near_links(df, distance, parts, most).collect()]
    assert all(bin(a ^ b).count("1") <= distance for a, b in links)
    reach = {x: {x} for x in prints}
    for a, b in links:
        joined = reach[a] | reach[b]
        for x in joined:
            reach[x] = joined
    assert all(b in reach[a] for a in prints for b in prints if bin(a ^ b).count("1") <= distance)
    with pytest.raises(ValueError):
        simhash.near_links(df, 5, 9)


def test_long_texts_names_and_no_rows(spark):
    long_ = " ".join(f"w{k % 5000}" for k in range(400_000))
    rows = [(1, long_), (2, long_ + " end"), (3, "x" * 3_000_000), (4, None)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in simhash.component_ids(docs).collect()}
    assert [got[k].component_id for k in (1, 2, 3, 4)] == [1, 1, 3, 4]
    assert got[3].fingerprint == f"{xxhash.xxh64_intdigest(b'x' * 3_000_000, 42):016x}"
    small = frame(spark, texts(n=6))
    crowded = small.select("*", *[F.lit("x").alias(c) for c in ("fp", "FINGERPRINT", "component_id", "least", "root", "a", "b", "size", "key", "block", "a.b", "q`uote")])
    assert result(simhash.component_ids(crowded)) == result(simhash.component_ids(small))
    assert simhash.component_ids(docs.where("false")).collect() == []


def test_query_equals_sql(spark):
    assert_same(spark, queries.QUERIES["op13_simhash"], queries.ORACLE["op13_simhash"])
