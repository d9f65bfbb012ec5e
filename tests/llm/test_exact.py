"""Operators with one right answer, against plain Python."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from tidewell.llm import common, jaccard, minimisers, suffix_dedup, superkmers
from tidewell.llm.common import sliding_min
from tidewell.llm.components import components
from tidewell.llm.decontaminate import FMIndex, decontaminate, decontaminated
from tidewell.sources.store import shared_dir

ROWS = brute.corpus()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=5))
def test_fm_index_finds_every_place(body, phrase):
    import numpy as np

    symbols = np.array([*body, 0], np.int64)
    index = FMIndex(symbols, sample_every=3)
    low, high = index.search(np.array([9, *phrase], np.int64), np.array([1]), np.array([len(phrase)]))
    got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert got == [p for p in range(len(body)) if body[p : p + len(phrase)] == phrase]


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12))
def test_sliding_min(x, w):
    import numpy as np

    assert sliding_min(np.array(x), w).tolist() == [min(x[k : k + w]) for k in range(len(x) - w + 1)]


@pytest.mark.parametrize(("heavy", "extra"), [(5000, False), (2, True)])
def test_suffix_dedup(spark, monkeypatch, heavy, extra):
    monkeypatch.setattr(suffix_dedup.repeated_grams, "__defaults__", (heavy,))
    rows = [*ROWS, ROWS[3]]  # a repeated row is one document
    out = suffix_dedup.dedup_substrings(brute.frame(spark, rows, extra).repartition(3))
    got = [(None if r._d == -(2**63) else r._d, (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256)) for r in out.collect()]
    assert len(got) == len(rows)
    assert dict(got) == brute.substrings(rows)


def test_suffix_dedup_keeps_columns_and_characters(spark):
    rows = [(1, "é" * 150), (2, "x" + "é" * 150), (3, "clean"), (4, None)]
    out = suffix_dedup.deduplicated(brute.frame(spark, rows, extra=True))
    assert out.columns == brute.frame(spark, rows, extra=True).columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("", 0), 2: ("x", 1), 3: ("clean", 5), 4: (None, None)} or got[4] in ((None, None), ("", None))


def same_hash(spark):
    """Two texts of which Spark's 32-bit hash is equal, one much longer than the other."""
    text = F.concat(F.lit("ab "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, F.lit(" tail " * 60)).otherwise(F.lit("")))
    rows = spark.range(600_000).select(text.alias("text"), (F.col("id") % 2).alias("odd"))
    pair = rows.groupBy(F.hash("text")).agg(F.max(F.when(F.col("odd") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("odd") == 1, F.col("text"))).alias("b"))
    return tuple(pair.where("a is not null and b is not null").first()[1:])


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_hash_are_two_documents(spark, doc_id):
    a, b = same_hash(spark)
    df = brute.frame(spark, [(doc_id, a), (doc_id, b), (8, a)])
    want = brute.substrings([("a", a), ("b", b), (8, a)])
    got = suffix_dedup.dedup_substrings(df).collect()
    assert sorted((r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in got) == sorted(want.values())
    want = brute.windows([(1, a), (2, b), (8, a)])
    got = superkmers.dedup_windows(df).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == sorted(v[:2] for v in want.values())
    got = jaccard.component_ids(df).collect()
    assert sorted(r.n_shingles for r in got) == sorted(len(brute.shingles(t, 5)) for t in (a, a, b))


def test_copies_without_id_are_documents(spark):
    """Copies under a null id repeat each other; rows that repeat an id do not."""
    text, other = ROWS[0][1] + " " + "x y z " * 70, " ".join(map(str, range(90)))
    df = brute.frame(spark, [(None, text)] * 3 + [(1, other), (1, other), (None, "short"), (None, "short")], extra=True)
    size = len(text.encode())
    got = [(r.n_bytes, r.n_removed, r._clean) for r in suffix_dedup.dedup_substrings(df).collect()]
    assert sorted(got) == sorted([(size, size, "")] * 3 + [(len(other), 0, other)] * 2 + [(5, 0, "short")] * 2)
    words, first = len(text.split()), brute.windows([(None, text)])[None]
    got = [(r.n_words, r.n_removed) for r in superkmers.dedup_windows(df).collect()]
    assert sorted(got) == sorted([first[:2], (words, words), (words, words), (90, 0), (90, 0), (1, 0), (1, 0)])


def test_ranked_strings_double():
    assert suffix_dedup.widths(200, 32, 16) == [128, 64, 16, 1]  # 73, 137, 185 and 200 bytes
    assert suffix_dedup.widths(24, 4, 3) == [12, 6, 3, 1]
    assert suffix_dedup.widths(50, 30, 16) == [16, 1]


def test_suffix_dedup_of_parts(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 90)))) for k in range(40)]
    for length in (12, 24):
        out = suffix_dedup.dedup_substrings(brute.frame(spark, rows), length=length, gram=4, block=3)
        assert {r._d: (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) for r in out.collect()} == brute.substrings(rows, length)


@pytest.mark.parametrize(("heavy", "extra"), [(5000, False), (2, True)])
def test_superkmers(spark, monkeypatch, heavy, extra):
    monkeypatch.setattr(superkmers.repeated_grams, "__defaults__", (heavy,))
    rows = [*ROWS, ROWS[3]]
    out = superkmers.dedup_windows(brute.frame(spark, rows, extra).repartition(3))
    got = [(None if r._d == -(2**63) else r._d, (r.n_words, r.n_removed, r.kept_sha256)) for r in out.collect()]
    assert len(got) == len(rows)
    assert dict(got) == brute.windows(rows)


def test_heavy_counts_every_run(spark):
    """A gram with many runs in one document is hot, as one with a run in many documents is."""
    rng = random.Random(6)
    text = " ".join("a b c d e f g h i j k l m n o p q r s t u v w x y z " + " ".join(rng.choice("efghijkl") + str(rng.randrange(99)) for _ in range(20)) for _ in range(400))
    docs = brute.frame(spark, [(1, text)])
    one = superkmers.repeated_grams(docs, 20, 4, True, heavy=30).where("_d = 1").first()
    runs = minimisers.minimiser_runs(*minimisers.symbols_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), True)[:2], 20, 4)[4]
    values, count = np.unique(runs.view(np.int64), return_counts=True)
    assert (count > 30).any()
    assert sorted(one.heavy) == values[count > 30].tolist()


def test_superkmers_of_few_words(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for k in range(30)]
    out = superkmers.dedup_windows(brute.frame(spark, rows), window=6, gram=2)
    assert {r._d: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()} == brute.windows(rows, 6)


@pytest.mark.parametrize(("n", "num", "chunk"), [(3, 90, 6_000_000), (5, 80, 300), (2, 60, 6_000_000)])
def test_jaccard(spark, n, num, chunk):
    out = jaccard.component_ids(brute.frame(spark, [*ROWS, ROWS[5]], extra=True).repartition(3), n=n, num=num, chunk_tokens=chunk)
    got = [(r.doc_id, (r.n_shingles, r.component_id)) for r in out.collect()]
    assert len(got) == len(ROWS) + 1
    assert dict(got) == brute.groups(ROWS, n, num)


def joined_by(rows):
    """The partition of nodes that rows (key, node) make."""
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for key, node in rows:
        up[find(("key", key))] = find(("node", node))
    groups = {}
    for _, node in rows:
        groups.setdefault(find(("node", node)), set()).add(node)
    return sorted(map(sorted, groups.values()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=40))
def test_combined_keys_join_the_same_nodes(rows):
    key, node = jaccard.combined(*(np.array(x, np.int64) for x in zip(*rows, strict=True)))
    got = list(zip(key.tolist(), node.tolist(), strict=True))
    assert joined_by(got) == joined_by(rows)
    assert all(sum(k == own for k, _ in got) <= 1 for own in range(13))


def similar(s, t, num, den):
    return den * len(s & t) >= num * len(s | t)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 60), st.integers(1, 8))
def test_trees_join_what_is_similar(seed, n, kinds):
    rng = random.Random(seed)
    bases = [rng.sample(range(300), rng.randrange(1, 25)) for _ in range(kinds)]
    sets = []
    for _ in range(n):
        own = set(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            own.add(rng.randrange(300))
            own.discard(rng.choice(sorted(own)))
        sets.append(own or {1})
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    cut = n // 2
    for sides in (((0, n),), ((0, cut), (cut, n))):
        trees = [jaccard.SignatureTree(arrays[a:b], list(range(a, b)), 4) for a, b in sides if b > a]
        forest = jaccard.Forest(n)
        found = jaccard.dual_traversal(trees[0], trees[-1], forest, 8, 10)
        if len(trees) == 2:
            for t in trees:
                found += jaccard.dual_traversal(t, t, forest, 8, 10)
        assert all(similar(sets[a], sets[b], 8, 10) for a, b in found)
        want = jaccard.Forest(n)
        for a in range(n):
            for b in range(a):
                if similar(sets[a], sets[b], 8, 10):
                    want.join(a, b)
        assert [forest.find(k) for k in range(n)] == [want.find(k) for k in range(n)]


def test_arrow_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(60).select(F.repeat(F.lit("x"), 300_000).alias("text"), F.lit("y").alias("a.b")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield common.pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    try:
        for limit, rows in ((64 << 20, 14), (600_000, 2)):
            spark.conf.set(name, str(limit))
            got = [r.n for r in common.in_arrow(docs.select("text"), sizes, "n long").collect()]
            assert sum(got) == 60 and max(got) <= rows
            assert int(spark.conf.get(name).rstrip("b")) == min(limit, common.BATCH_BYTES)
    finally:
        spark.conf.set(name, before)


def test_jaccard_of_short_sets(spark):
    """Few shingles, many of them common: most sets fall back to keys of all parts."""
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12)))) for k in range(150)]
    out = jaccard.component_ids(brute.frame(spark, rows), n=1, num=75)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute.groups(rows, 1, 75)


def test_one_document_of_each_group_stays(spark):
    df = brute.frame(spark, ROWS, extra=True)
    kept = jaccard.representatives(df)
    want = brute.groups(ROWS, 5, 80)
    least = {}
    for i, (size, root) in want.items():
        if size:
            least[root] = min(least.get(root, i), i, key=lambda x: -1 if x is None else x)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (size, root) in want.items() if not size or least[root] == i}


def test_one_row_of_each_group_stays(spark):
    """Copies without id and repeated rows too; rows without words stay."""
    rows = [(None, "a b c d e f g")] * 3 + [(1, "a b c d e f g"), (2, "h i j k l m")] + [(2, "h i j k l m")] + [(3, "h i j k l m"), (None, " \n\x0b"), (None, None), (4, ""), (4, "")]
    kept = jaccard.representatives(brute.frame(spark, rows, extra=True).repartition(3))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(None, "a b c d e f g"), (2, "h i j k l m"), *rows[-4:]], key=str)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


ITEMS = [(1, ROWS[2][1]), (2, "one"), (10, ROWS[2][1]), (3, None), (4, "--"), (None, "Na na NA na"), (5, " ".join((ROWS[7][1] or "").split()[3:18]))]


@pytest.mark.parametrize(("limit", "extra"), [(32 << 20, False), (300, True)])
def test_decontaminate(spark, limit, extra):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate(brute.frame(spark, [*ROWS, ROWS[2]], extra), items, max_benchmark_bytes=limit, shard_bytes=2000)
    got = [(r.doc_id, (r._n_words, r._n_hit, len(r._items), r._items_sha256)) for r in out.collect()]
    assert len(got) == len(ROWS) + 1
    assert dict(got) == brute.contamination(ROWS, ITEMS)


def test_benchmark_in_many_slices(spark):
    """Slices write their hits alone, and what they wrote is gone; the spans are those of one slice."""
    words = [f"w{k}" for k in range(400)]
    items = spark.createDataFrame([(k, " ".join(words[5 * k : 5 * k + 14])) for k in range(70)], "item_id long, text string")
    texts = [" ".join(words[7 * k : 7 * k + 40]) for k in range(40)] + ["no word of theirs " * 9000] * 5 + [None] * 9
    docs = spark.createDataFrame([(k % 50, t) for k, t in enumerate(texts)], "doc_id long, text string")
    columns = ("doc_id", "text", "_starts", "_ends", "_items", "_n_words", "_n_hit", "_clean")
    rows = lambda **o: sorted((tuple(r[c] for c in columns) for r in decontaminate(docs, items, **o).collect()), key=repr)
    folder = Path(shared_dir(spark))
    files = lambda: {p for p in folder.rglob("*.parquet")}
    before = files()
    got = rows(max_benchmark_bytes=150)
    left = files() - before
    assert got == rows()
    assert sum(r[6] for r in got) > 1000 and len(got) == len(texts)
    assert not [p for p in left if "slices-" in str(p)]
    assert sum(p.stat().st_size for p in left) < 40_000  # the spans; the texts are 800 KB


@pytest.mark.parametrize("least", [39, 200])
def test_rows_without_id_and_text_are_dealt(spark, least):
    """They are no key of their own, while copies long enough for a result keep one."""
    rows = spark.range(0, 4000, 1, 40).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 4 == 0, "x" * (least - 1)).when(F.col("id") % 4 == 1, "y" * least).when(F.col("id") % 4 == 2, "").alias("text"))
    got = {(r.text or "")[:1]: (r.keys, r.rows) for r in suffix_dedup.dealt(rows, least).groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count_distinct("_d", "_t", "_u").alias("keys"), F.count("*").alias("rows")).collect()}
    assert got == {"x": (40, 1000), "y": (1, 1000), "": (40, 2000)}


def test_decontaminated_cuts_the_spans(spark):
    items = spark.createDataFrame([(1, "B c")], "item_id long, text string")
    df = brute.frame(spark, [(1, "a, b; C d"), (2, "b-d"), (3, None)], extra=True)
    out = decontaminated(df, items)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a,  d", 5), 2: ("b-d", 3), 3: (None, None)}


def test_empty_tables(spark):
    none = brute.frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert suffix_dedup.dedup_substrings(none).count() == 0
    assert superkmers.dedup_windows(none).count() == 0
    assert jaccard.component_ids(none).count() == 0
    assert decontaminate(none, items).count() == 0
    assert decontaminate(brute.frame(spark, ROWS), items).agg(F.sum("_n_hit")).first()[0] == 0


def keys_of(sets, heavy=None, num=8, den=10):
    """The keys of each set."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    flags = np.zeros(len(flat), bool) if heavy is None else np.isin(flat, heavy)
    key, owner = jaccard.part_keys(flat, at, np.arange(len(sets)), flags, num, den)
    return [set(key[owner == k].tolist()) for k in range(len(sets))]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 900), st.floats(0, 1), st.sampled_from([(8, 10), (9, 10), (75, 100)]), st.sampled_from([0, 0.5, 0.95, 1]))
def test_similar_sets_share_a_key(seed, size, share, ratio, hidden):
    rng, (num, den) = np.random.default_rng(seed), ratio
    pool = rng.integers(0, 2**64, 2 * size, np.uint64)
    differ = size * (den - num) // num  # with the second set in the first, or each with some of its own
    while (size - (own := int(share * differ))) * den < num * (size + differ - own):
        differ -= 1
    a, b = pool[:size], np.r_[pool[own:size], pool[size : size + differ - own]]
    one, two = keys_of([a, b], pool[rng.random(len(pool)) < hidden], num, den)
    assert one & two


def test_sets_that_share_a_few_shingles_share_no_key():
    # random words make long texts meet in single shingles; linked by them, most of a large corpus
    # would be one candidate, whose sets are copied for every pair of chunks
    rng = np.random.default_rng(5)
    for size in (300, 520, 700):
        common = rng.integers(0, 2**64, 20, np.uint64)
        keys = keys_of([np.r_[common, rng.integers(0, 2**64, size - 20, np.uint64)] for _ in range(40)])
        met = sum(bool(keys[i] & keys[j]) for i in range(40) for j in range(i))
        assert met < 0.03 * 780
