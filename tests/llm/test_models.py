"""Classifiers, mixing, retrieval, archives and filters."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewell.llm import crf_quality, langid, mixing, topk, url_filter, warc
from tidewell.llm.queries import ORACLE, QUERIES
from tests.oracle import DATA, assert_same


# ---------------------------------------------------------------- language ID


def spoken(seed=0, n=60):
    rng = random.Random(seed)
    kinds = {"en": ["the", "and", "ing", "thr", "wh"], "fr": ["le", "eau", "oui", "ère", "que"], "ru": ["это", "ста", "при", "ова"]}
    rows = []
    for k in range(n):
        lang = rng.choice(sorted(kinds))
        rows.append((k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 30))), lang))
    return rows


def test_langid_learns_and_backs_off(spark):
    rows = spoken()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["langs"] == ["en", "fr", "ru"]
    odd = [(1, None), (2, ""), (3, "12 !?"), (4, "THETHETHR"), (5, "漢字"), (6, "ÈREQUEEAUÈRE 7"), (7, "это " * 20_000), (8, "x")]
    odd += [(100 + i, t) for i, t, _ in spoken(1)]
    got = {r.doc_id: (r._lang, r._score) for r in langid.identify(brute.frame(spark, odd, extra=True), model).collect()}
    assert [got[k] for k in (1, 2, 3)] == [("und", 0.0)] * 3
    assert (got[4][0], got[6][0], got[7][0]) == ("en", "fr", "ru")
    assert got[5][1] == pytest.approx(1 / 3)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert sum(got[100 + i][0] == lang for i, _, lang in spoken(1)) == 60


def plain_backoff(rows, texts):
    """Word-first backoff in plain Python: (language, share of its probability) of each text."""

    def words(text):
        return "".join(c if c.isalpha() else " " for c in text.lower()).split()

    def grams(word, n):
        padded = word if n == 1 else f"|{word}|"
        return [padded[k : k + n] for k in range(len(padded) - n + 1)]

    langs = sorted({lang for _, t, lang in rows if t and lang and words(t)})
    tables = [{} for _ in range(5)]
    for k, lang in enumerate(langs):
        own = [w for _, t, x in rows if x == lang for w in words(t or "")]
        for w in own:
            tables[0].setdefault(w, [0] * len(langs))[k] += 1
        for w in set(own):
            for n in range(1, 5):
                for g in grams(w, n):
                    tables[n].setdefault(g, [0] * len(langs))[k] += 1
    for table in tables:
        sums = [sum(c[k] for c in table.values()) + 0.2 * len(table) for k in range(len(langs))]
        for name, counts in table.items():
            p = [(c + 0.2) / s for c, s in zip(counts, sums, strict=True)]
            table[name] = [math.log(x / sum(p)) for x in p]
    out = []
    for text in texts:
        total = [0.0] * len(langs)
        for w in words(text or ""):
            scores = [[0.0] * len(langs)]
            for n in (0, 4, 3, 2, 1):
                found = [tables[n][g] for g in (grams(w, n) if n else [w]) if g in tables[n]]
                if found:
                    scores = found
                    break
            total = [a + sum(s[k] for s in scores) / len(scores) for k, a in enumerate(total)]
        best = max(total)
        out.append(("und", 0.0) if not words(text or "") else (langs[total.index(best)], 1 / sum(math.exp(x - best) for x in total)))
    return out


def test_langid_equals_plain_backoff(spark):
    rng = random.Random(12)
    rows = [*spoken(4, 40), (900, None, "en"), (901, "the THE", None), (902, "Straße İstanbul 𐐀𐐁", "de"), (903, "12", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    letters = "thewandiquéлтоßзxœ𐐁 '-3"
    texts = [None, "", "😀 7", *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(200)), *(t for _, t, _ in spoken(5, 20))]
    got = {r.doc_id: (r._lang, r._score) for r in langid.identify(brute.frame(spark, list(enumerate(texts))), model).collect()}
    for k, (lang, score) in enumerate(plain_backoff(rows, texts)):
        assert got[k][1] == pytest.approx(score, abs=1e-5), texts[k]
        assert got[k][0] == lang or score < 0.5 + 1e-5, texts[k]


def test_langid_of_a_small_language(spark):
    """A language of one row in a table of another keeps its words, and counts of shared n-grams."""
    rng = random.Random(3)
    big = [(k, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)), "aa") for k in range(80)]
    rows = [*big, (900, "zuzu wowo zuzu wowo abc", "zz"), (901, "12", "yy")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_entries=300)
    assert model["langs"] == ["aa", "zz"]
    got = {r.doc_id: r._lang for r in langid.identify(brute.frame(spark, [(1, "wowo"), (2, "zuzuzu"), (3, big[0][1])]), model).collect()}
    assert got == {1: "zz", 2: "zz", 3: "aa"}
    assert len(model["tables"][1].names) == 8 + 4
    sizes = [len(t.names) for t in model["tables"]]
    assert 300 <= sum(sizes) <= 400


def test_langid_of_very_many_languages(spark):
    """A dirty column: the model grows with its entries, not with their number times the languages."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some common words of all"), *[F.concat(F.lit("w"), F.translate(F.hex(F.xxhash64("id", F.lit(k))), "0123456789", "ghijklmnop")) for k in range(6)]).alias("text"))
    labelled = docs.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 1000).cast("string")))
    model = langid.fit(labelled, max_total=400_000)
    assert len(model["langs"]) == 1000
    size = sum(a.nbytes for t in model["tables"] for a in t)
    assert size < 40_000_000, size
    got = langid.identify(labelled.where("doc_id < 40"), model).collect()
    assert sum(r.lang == r["_lang"] for r in got) >= 38
    few = langid.fit(labelled, max_total=50_000)
    assert sum(len(t.lang) for t in few["tables"]) < sum(len(t.lang) for t in model["tables"])


def test_langid_of_signs_beyond_the_bmp(spark):
    """Emoji are no letters, U+10400 and U+20000 are."""
    model = langid.fit(spark.createDataFrame(spoken(), "doc_id long, text string, lang string"))
    odd = [(1, "\U0001f600 \U0001f601"), (2, "\U0001f600 oui \U0001f600"), (3, "\U00010400"), (4, "\U00020000")]
    got = {r.doc_id: (r._lang, r._score) for r in langid.identify(brute.frame(spark, odd), model).collect()}
    assert got[1] == ("und", 0.0) and got[2][0] == "fr"
    assert got[3][1] == got[4][1] == pytest.approx(1 / 3)


def test_langid_without_teachers(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(none)
    assert [tuple(r) for r in langid.identify(brute.frame(spark, [(1, "a b")]), model).select("_lang", "_score").collect()] == [("und", 0.0)]
    assert langid.identify(brute.frame(spark, []), model).count() == 0
    assert langid.identified(spark.createDataFrame(spoken(), "doc_id long, text string, lang string")).count() == 60


def test_langid_held_out_accuracy(spark):
    got = QUERIES["op4_langid"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert all(r.held_out == (brute.crc(r.doc_id, 4) == 2) for r in got.collect())


# ---------------------------------------------------------------- quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    unary, pair, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 3, 3, 4, 7])
    good, both = crf_quality.marginals(unary, first, pair)
    want, counts = np.zeros(7), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        n, total, own, seen = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            y = [(code >> k) & 1 for k in range(n)]
            w = math.exp(sum(unary[a + k] * y[k] for k in range(n)) + sum(pair[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            own += w * np.array(y)
            for k in range(n - 1):
                seen[y[k], y[k + 1]] += w
        if n:
            want[a:b] = own / total
            counts += seen / total
    assert np.allclose(good, want) and np.allclose(both, counts)


def plain_lines(text):
    """The features of each line that is not empty, and its length in bytes, in plain Python."""
    out, seen = [], set()
    for line in (x for x in text.encode().split(b"\n") if x):
        n = len(line)

        def share(test, line=line, n=n):
            return sum(test(b) for b in line) / n

        space, marks = b" \t\r\x0b\x0c", b"!,.?"
        lower, upper, digit = (lambda b: 97 <= b <= 122), (lambda b: 65 <= b <= 90), (lambda b: 48 <= b <= 57)
        other = lambda b: b < 128 and not (lower(b) or upper(b) or digit(b) or b in space or b in marks or b == 124)
        classes = [share(lower), share(upper), share(digit), share(lambda b: b in space), share(lambda b: b in marks), share(lambda b: b == 124), share(other), share(lambda b: b >= 128)]
        words = line.translate(bytes.maketrans(space, b" " * 5)).split(b" ")
        words = [w for w in words if w]
        k = max(1, len(words))
        signed = sum(w[-1] == 124 or other(w[-1]) for w in words)
        out.append(([*classes, len(set(words)) / k, min(n / k / 10, 3), math.log1p(k) / 5, sum(len(w) > 20 for w in words) / k, signed / k, float(line in seen), float(n < 30)], n))
        seen.add(line)
    return out


def test_quality_features_and_scores_equal_plain_ones(spark):
    rng = random.Random(5)
    texts = ["", "\n\n", "one", "a|b |c\n\n \n|", "Ünï 12 3.\nÜnï 12 3.\nx" + "y" * 25]
    texts += ["".join(rng.choice("ab C1.,|-é \t\n") for _ in range(rng.randrange(200))) for _ in range(30)]
    data, offsets = crf_quality.text_buffer(crf_quality.pa.array(texts))
    x, size, first = crf_quality.line_features(data, offsets)
    plain = [plain_lines(t) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    assert size.tolist() == [n for p in plain for _, n in p]
    assert np.allclose(x, [f for p in plain for f, _ in p])

    model = crf_quality.train(texts, [k % 2 for k in range(len(texts))], steps=15)
    got = {r.doc_id: r._score for r in crf_quality.score(brute.frame(spark, list(enumerate(texts))), model).collect()}
    for k, lines in enumerate(plain):
        if not lines:
            assert got[k] == pytest.approx(model["share"])
            continue
        f = [(np.array(v) - model["mean"]) / model["scale"] for v, _ in lines]
        zero, n = np.zeros_like(f[0]), len(f)
        score = [np.concatenate([f[i], 0.5 * (f[i - 1] if i else zero), 0.5 * (f[i + 1] if i + 1 < n else zero), [1.0]]) @ model["weights"] for i in range(n)]
        # sums over all labellings, one line after the other
        ahead = [[0.0, score[0]]]
        for i in range(1, n):
            ahead.append([np.logaddexp(ahead[-1][0] + model["pair"][0, y], ahead[-1][1] + model["pair"][1, y]) + y * score[i] for y in (0, 1)])
        back = [[0.0, 0.0]]
        for i in range(n - 1, 0, -1):
            back.append([np.logaddexp(model["pair"][y, 0] + back[-1][0], model["pair"][y, 1] + score[i] + back[-1][1]) for y in (0, 1)])
        good = [1 / (1 + math.exp(a[0] + b[0] - a[1] - b[1])) for a, b in zip(ahead, reversed(back), strict=True)]
        assert got[k] == pytest.approx(sum(g * s for g, (_, s) in zip(good, lines, strict=True)) / sum(s for _, s in lines))


def test_quality_sample_is_bounded(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("x" * 100), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(500, "y" * 5000), (501, None)], "doc_id long, text string"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    every = crf_quality.training_rows(docs, labels)
    assert every.count() == sum(brute.crc(k, 3) != 1 for k in [*range(400), 500])
    part = crf_quality.training_rows(docs, labels, max_bytes=12_000)
    got = part.agg(F.sum(F.length("text")), F.max(F.length("text"))).first()
    assert 6000 < got[0] <= 12_000
    assert 20 < crf_quality.training_rows(docs, labels, max_docs=60).count() < 110


def test_quality_of_odd_texts(spark):
    texts = ["Good words here.\nAnd more of them, as it goes."] * 20 + ["| a | b |\n!! XX $$$ %%%"] * 20
    model = crf_quality.train(texts, [1] * 20 + [0] * 20, steps=40)
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, texts[0]), (5, texts[-1]), (6, (texts[0] + "\n") * 3000), (7, "é")]
    got = {r.doc_id: r._score for r in crf_quality.score(brute.frame(spark, rows, extra=True), model).collect()}
    assert got[1] == got[2] == got[3] == 0.5
    assert got[4] > 0.9 and got[5] < 0.1 and got[6] > 0.9
    assert all(0 <= v <= 1 for v in got.values())
    for labels in ([], [1, 1, 1]):
        one = crf_quality.train(texts[: len(labels)], labels)
        assert 0 <= crf_quality.score(brute.frame(spark, rows), one).agg(F.min("_score")).first()[0] <= 1
    assert crf_quality.score(brute.frame(spark, []), model).count() == 0


def test_quality_held_out_accuracy(spark):
    got = QUERIES["op9_crf_quality"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


# ---------------------------------------------------------------- mixing


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(200):
        kind = "ab"[k % 3 == 0]
        rows.append((k, " ".join(rng.choice(["sun", "sea", "sky", "mix"] if kind == "a" else ["cog", "nut", "rod", "mix"]) for _ in range(rng.randrange(1, 40)))))
        if k % 2:
            labels.append((k, kind))
    rows += [(200, None), (201, ""), (202, "zzz"), (202, "zzz"), (None, "sun sea")]
    labels += [(None, "a"), (1, None), (3, "c")]
    docs, table = brute.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, domain string")
    got = mixing.mix_domains(docs, table, {"a": 0.2, "b": 0.8}).collect()
    assert len(got) == len(rows)
    assert all(r.rate >= 0 and abs(r.p_a + r.p_b - 1) < 1e-9 for r in got)
    totals = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in "ab"]
    tokens = sum(r.n_tokens for r in got)
    assert totals == pytest.approx([0.2 * tokens, 0.8 * tokens], rel=1e-4)
    by_id = {r.doc_id: r for r in got}
    assert by_id[200].rate == by_id[201].rate == 1.0 and by_id[200].n_tokens == 0
    assert by_id[3].n_tokens == len(rows[3][1].split())
    sure = [r for r in got if r.doc_id is not None and r.doc_id < 200 and r.n_tokens > 10]
    assert all((r.p_a > 0.5) == (r.doc_id % 3 != 0) for r in sure)


@pytest.mark.parametrize("weights", [[0.4, 0.35, 0.25], [0.9, 0.05, 0.05]])
def test_rates_are_those_of_plain_projected_steps(spark, weights):
    """The first targets are met; the second lie at the edge of what rates can reach."""
    x = np.random.default_rng(5).random((50, 3)) * 10
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x0 double, x1 double, x2 double")
    target, metric = np.array(weights) * x.sum(), np.linalg.pinv(x.T @ x)
    gradients = mixing.solve(df, weights)
    rate, heights = np.ones(50), []
    for g in gradients:
        heights.append((rate @ x - target) @ metric @ (rate @ x - target))
        rate = np.maximum(0, rate - x @ g)
    got = np.array([r[0] for r in df.select(mixing.rate_of(gradients)).collect()])
    assert np.allclose(np.sort(got), np.sort(rate))
    assert heights == sorted(heights, reverse=True)
    end = (rate @ x - target) @ metric @ (rate @ x - target)
    assert end < (1e-9 if weights[0] < 0.5 else 0.5) * heights[0]


def test_posteriors_equal_plain_naive_bayes(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([" ", "\t", "\r\n", "\x0b"]).join(rng.choice("ABCDEFGHIJ"[3 * (k % 3) :]) + rng.choice("xy") for _ in range(rng.randrange(30)))) for k in range(60)]
    labels = [(k, "abc"[k % 3]) for k in range(0, 60, 2)]
    docs, table = brute.frame(spark, [*rows, (60, None), (61, "zz  zz")]), spark.createDataFrame(labels, "doc_id long, domain string")
    got = {r.doc_id: r for r in mixing.mix_domains(docs, table, {"a": 0.3, "b": 0.3, "c": 0.4}, buckets=1 << 40).collect()}
    own = {d: [w for k, x in labels if x == d for w in rows[k][1].lower().split()] for d in "abc"}
    vocabulary = {w for ws in own.values() for w in ws}
    n = {d: sum(x == d for _, x in labels) for d in "abc"}
    for k, text in [*rows, (60, ""), (61, "zz  zz")]:
        words = text.lower().split()
        score = [math.log((n[d] + 1) / (30 + 3)) + sum(math.log((own[d].count(w) + 0.5) / (len(own[d]) + 0.5 * len(vocabulary))) for w in words if w in vocabulary) for d in "abc"]
        odds = [math.exp(s - max(score)) for s in score]
        assert got[k].n_tokens == len(words)
        assert [got[k].p_a, got[k].p_b, got[k].p_c] == pytest.approx([o / sum(odds) for o in odds], abs=1e-9)


@pytest.mark.parametrize("weights", [[0.2, 0.5, 0.3], [0.95, 0.03, 0.02], [1.0, 0.0, 0.0]])
def test_rates_are_as_near_as_an_independent_solver_comes(spark, weights):
    """Coordinate descent, one rate after the other, on the same least squares."""
    x = np.random.default_rng(11).random((40, 3)) ** 3 * 20
    steps = mixing.solve(spark.createDataFrame([tuple(map(float, r)) for r in x], "x0 double, x1 double, x2 double"), weights)
    target, metric = np.array(weights) * x.sum(), np.linalg.pinv(x.T @ x)
    rate, total = np.ones(len(x)), x.sum(0)
    for _ in range(4000):
        for i, row in enumerate(x):
            new = max(0.0, rate[i] - row @ metric @ (total - target) / (row @ metric @ row))
            total, rate[i] = total + (new - rate[i]) * row, new
    height = lambda v: (v - target) @ metric @ (v - target)
    begun = height(x.sum(0))
    assert height(steps.reached) <= height(total) + 0.02 * begun
    assert steps.distance == pytest.approx(np.abs(steps.reached - target).max() / target.sum())
    if height(total) < 1e-12 * begun:
        assert steps.distance < 1e-5


def test_registered_mixing_meets_its_targets(spark, caplog):
    got = QUERIES["op1_mixing"](spark, "/root/testdata/sf0.01")
    total = got.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS]).first()
    for d, share in mixing.TARGETS.items():
        assert total[d] == pytest.approx(share * total.n, rel=1e-3)


def test_mixing_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix_domains(brute.frame(spark, []), labels, {"a": 1.0}).count() == 0
    one = mixing.mix_domains(brute.frame(spark, [(1, "a b")]), labels, {"a": 0.5, "b": 0.5}).first()
    assert (one.p_a, one.p_b, one.rate) == (0.5, 0.5, 1.0)
    docs = brute.frame(spark, [(1, "a b"), (1, "a b"), (2, None)], extra=True)
    out = mixing.mixed(docs, spark.createDataFrame([], "doc_id long, domain string"))
    assert out.count() == 3 and set(docs.columns) < set(out.columns) and len(set(out.columns)) == len(out.columns)


# ---------------------------------------------------------------- top-k


def nearest(vectors, queries, k):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(usable):
        if q is None or not queries(q):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i) for n, (i, w) in enumerate(usable) if n != at)
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_topk(spark, spread):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        size = math.exp(rng.gauss(0, spread))
        rows.append((i, [size * rng.gauss(0, 1) for _ in range(8)]))
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, [0.0] * 8), (320, [0.0] * 8), (340, None), (341, [1.0, None]), (342, [float("nan")] * 8), (343, [float("inf")] * 8), (None, [1.0] * 8), (None, [9.0] * 8), (20, rows[20][1]), (40, rows[7][1]), (41, rows[8][1]), (41, rows[41][1]), (344, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = topk.top_k(df, k=7, chunk=40, block=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == nearest(rows, lambda q: q % 20 == 0, 7)
    # the same vectors asked from outside leave out the rows of their id
    few = df.where("vec_id in (3, 5, 20)")
    by_id = {q: [r.vec_id for r in got.orderBy("rank").collect() if r.query_id == q] for q in (3, 5)} if (got := topk.top_k(df, few, k=7, chunk=40, block=2)) else {}
    want = nearest([r for r in rows if r[0] is not None], lambda q: q in (3, 5), 8)
    for q, found in by_id.items():
        assert len(found) == 7 and q not in found and set(found[:3]) <= {w[2] for w in want if w[0] == q} | {None}


def test_topk_prunes_by_coordinates_exactly(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=6) * 100
    c = np.floor(np.vstack([centre + rng.normal(size=(60, 6)) * 3, rng.normal(size=(300, 6)) * 100])).astype(np.int64)
    ids, floors = np.arange(len(c)), np.array([np.sort(c[0] @ c[1:].T)[-5]], float)
    i, j, s = topk.best(np.array([0]), c[:1], floors, ids, ids, c, 5)
    want = sorted(((-int(c[0] @ c[k]), k) for k in range(1, len(c))))[:5]
    assert [(-int(x), int(y)) for x, y in zip(s, j, strict=True)] == want


def test_topk_of_few(spark):
    df = spark.createDataFrame([(20, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(20, 1, 1, 64 * 128)]
    assert topk.top_k(df.where("false")).count() == 0
    big = spark.createDataFrame([(0, [1e7] * 4), (1, [1e7] * 4)], "vec_id long, embedding array<double>")
    assert topk.top_k(big).first().score == 4 * (64 * 10**7) ** 2


# ---------------------------------------------------------------- archives


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN_ROWS", 8)
    monkeypatch.setattr(warc, "PLAN_ROWS", 16)
    rng = random.Random(1)
    rows = [(k, f"http://H{rng.randrange(5)}.example.com:80/p/{rng.randrange(9)}?q=é", "x" * rng.randrange(40)) for k in range(150)]
    rows += [(200, None, "lone"), (201, "http://[bad", None), (202, "", ""), (None, "http://a/b c\r\nd", "lone"), (None, "x", "only here"), (203, "y", "Ü" * 300_000), (7, rows[7][1], rows[7][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1))
    out = warc.round_trip(pages.repartition(6), archive_bytes=900)
    got = out.collect()
    least = {}
    for i, _, h in rows:
        b = (h or "").encode()
        least[b] = min(least.get(b, i), i, key=lambda x: (x is None, x))
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        own = least[b] == i
        want.append((i, len(b), warc.digest(b), "response" if own else "revisit", None if own else least[b]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    keys = [warc.sort_key(tuple(r)) for r in got]
    assert keys == sorted(keys)
    # merging in passes gives the same order
    folder = warc.scratch(spark, "passes")
    archives = warc.write_archives(pages, folder, archive_bytes=700)
    assert archives.count() > 30
    assert [warc.sort_key(tuple(r))[:3] for r in warc.read_archives(archives, folder, fan_in=4).collect()] == [k[:3] for k in keys]
    # record ids are unique, and a revisit's URL and date are those of its response
    fs, root = warc.opened(folder)
    ids, dated, referred = [], set(), set()
    for r in archives.collect():
        with fs.open_input_stream(r.file, compression=None) as stream:
            for _, _, raw in warc.members(stream):
                fields = dict(x.split(": ", 1) for x in raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
                ids.append(fields["WARC-Record-ID"])
                place = (fields.get("WARC-Target-URI"), fields["WARC-Date"], fields.get(warc.PAGE))
                if fields["WARC-Type"] == "response":
                    dated.add(place)
                else:
                    referred.add((fields.get("WARC-Refers-To-Target-URI"), fields["WARC-Refers-To-Date"], fields[warc.REFERS]))
    assert len(set(ids)) == len(ids) == len(rows)
    assert referred and referred <= dated


def test_a_pass_is_planned_in_parts(spark, monkeypatch):
    """Groups and ranges keep their bounds however many parts the keys are counted in."""
    runs = spark.createDataFrame([(f"run{k}",) for k in range(50)], "run string")
    key = lambda k: (f"u{k % 7}", k, 0, k, "f", k)
    rows = [(f"run{k % 50}", f"f{k % 50}", k // 50, 1, key(k), key(k)) for k in range(400)]
    index = spark.createDataFrame(rows, warc.INDEX)
    want = None
    for most in (1 << 16, 16):
        monkeypatch.setattr(warc, "PLAN_ROWS", most)
        groups = {r.run: r.group for r in warc.grouped(runs, 50, 4).collect()}
        sizes = [list(groups.values()).count(g) for g in sorted(set(groups.values()))]
        assert len(groups) == 50 and sizes == [4] * 12 + [2]
        work = warc.ranges(index, 64, 50, 400).orderBy("r").collect()
        got = [(r.r, r.low, r.high, sorted((b.file, b.k) for b in r.batches)) for r in work]
        assert want is None or got == want
        want = got
    assert sum(len(b) for *_, b in want) == 400 and len(want) == 7


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.round_trip(pages, min_revisit=3).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_loser_tree_merges():
    rng = random.Random(0)
    for k in range(0, 9):
        runs = [sorted(((chr(97 + rng.randrange(3)), rng.randrange(9), rng.choice([None, 1, 2]), "", None, 0, "", f"f{i}", j, 0) for j in range(rng.randrange(6))), key=warc.sort_key) for i in range(k)]
        got = list(warc.LoserTree([iter(r) for r in runs]))
        assert got == sorted((x for r in runs for x in r), key=warc.sort_key)


# ---------------------------------------------------------------- URL filters


ENTRIES = [
    ("host", "A.example.com", "add", 100), ("host", "a.example.com", "remove", 200), ("host", "a.example.com", "add", 300),
    ("domain", "example.com", "add", 150), ("domain", "example.com", "remove", 160), ("domain", "example.com", "remove", 160),
    ("prefix", "b.org/x/", "add", 50), ("host", "c.org", "add", 10), ("host", "c.org", "remove", 10),
    ("host", None, "add", 1), ("other", "b.org", "add", 1), ("host", "b.org", None, 1), ("host", "b.org", "add", None),
]


@pytest.mark.parametrize("limit", [50_000, 0])
def test_url_filter(spark, limit):
    captures = [
        (1, "http://a.example.com/", 99), (2, "https://u@A.example.com:8080", 100), (3, "http://a.example.com/", 199), (4, "http://a.example.com/", 200),
        (5, "http://a.example.com/", 155), (6, "http://z.a.example.com/q", 155), (7, "http://notexample.com", 155), (8, "http://b.org/x/y?z", 50), (9, "http://b.org/xy", 50),
        (10, "http://b.org/x/", 5000), (11, "http://c.org/", 10), (12, None, 100), (13, "no url", 100), (14, "http://a.example.com/", None), (None, "http://b.org/X/", 60), (1, "http://a.example.com/", 99), (8, "http://b.org/x/y?z", 50),
    ]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at long").withColumn("rule", F.lit(0)).withColumn("since", F.lit(0))
    e = spark.createDataFrame(ENTRIES, "kind string, key string, action string, ts long")
    out = url_filter.filter_urls(c, e, bucket=70, salts=3, max_broadcast=limit).collect()
    assert len(out) == len(captures)
    host, domain, prefix = "host:a.example.com", "domain:example.com", "prefix:b.org/x/"
    want = {2: [host], 3: [host], 5: [domain, host], 6: [domain], 8: [prefix], 10: [prefix], None: [prefix]}
    for r in out:
        assert r.rules == want.get(r.page_id, []) and r.n_rules == len(r.rules) and r.blocked == bool(r.rules), r
    assert url_filter.filter_urls(c, e.where("false"), max_broadcast=limit).where("blocked").count() == 0
    assert url_filter.filter_urls(c.where("false"), e, max_broadcast=limit).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLE[name])


def test_whole_tables_come_back(spark):
    for name, table, key in (("op1_mixing", "documents", "doc_id"), ("op8_warc", "pages", "page_id")):
        got = QUERIES[name](spark, DATA)
        assert got.select(key).exceptAll(spark.read.parquet(f"{DATA}/{table}.parquet").select(key)).count() == 0
        assert got.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
