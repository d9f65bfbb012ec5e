"""Columns of the input whose names are those an operator uses itself, in any case."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidewell.llm import crf_quality, decontaminate, jaccard, langid, mixing, suffix_dedup, superkmers, topk, url_filter, warc

TAKEN = (
    "_d _t _u _lang _score _starts _ends _items _n_words _n_hit _clean _items_sha256 _rest _row _keep _words _word _cell _worded _copies "
    "N_Words n_removed KEPT_SHA256 starts ends items grams heavy Node root parts rate n_tokens P_clean x0 w0 cell key gram first last spans quality"
).split()
ODD = ["a.b", "with space", "q`uote"]
ROWS = [r for r in brute.corpus(seed=3, n=30) if r[0] is None or r[0] != 36] + [(70, "12 %%")]


def crowded(spark):
    own = [F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for k, c in enumerate([*TAKEN, *ODD])]
    df = brute.frame(spark, ROWS).select("doc_id", *own, "text", F.lit("xx").alias("lang"), F.length("text").cast("long").alias("n_chars"))
    return df.repartition(3)


def carried(df, added=0):
    """Every carried value is that of its row."""
    assert len(df.columns) == len(TAKEN) + len(ODD) + 4 + added
    rows = df.collect()
    for r in rows:
        for k, c in enumerate([*TAKEN, *ODD]):
            at = df.columns.index(c)
            assert r[at] == f"{k}:{'none' if r[0] is None else r[0]}", c
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([(1, " ".join((ROWS[2][1] or "").split()[:14]))], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 30, 2)], "doc_id long, quality int, toxic int")
    return items, labels


def test_stages_carry_every_column(spark, tables):
    items, labels = tables
    docs = crowded(spark)
    plain = brute.frame(spark, ROWS).withColumn("lang", F.lit("xx"))
    for stage in (langid.identified, jaccard.representatives, suffix_dedup.deduplicated, lambda d: decontaminate.decontaminated(d, items)):
        got = stage(docs)
        assert got.columns == docs.columns
        assert sorted(((r[0], r["text"]) for r in carried(got)), key=repr) == sorted(((r.doc_id, r.text) for r in stage(plain).collect()), key=repr)
    got = mixing.mixed(docs, mixing.label_domains(labels))
    assert got.columns[: len(docs.columns)] == docs.columns
    assert len(carried(got, 5)) == len(ROWS)
    assert set(got.columns[len(docs.columns) :]) == {"_n_tokens", "_p_clean", "p_low", "p_toxic", "_rate"}


def test_operators_carry_every_column(spark, tables):
    items, _ = tables
    docs = crowded(spark)
    model = langid.fit(docs)
    assert len(carried(langid.identify(docs, model), 2)) == len(ROWS)
    assert langid.identify(docs, model).columns[-2:] == ["__lang", "__score"]
    quality = crf_quality.train(["Good words.", "| |"] * 5, [1, 0] * 5, steps=3)
    assert len(carried(crf_quality.score(docs, quality), 1)) == len(ROWS)
    out = decontaminate.decontaminate(docs, items)
    assert out.columns[len(docs.columns) :] == ["__starts", "__ends", "__items", "__n_words", "__n_hit", "__clean", "__items_sha256"]
    got = {r[0]: (r["__n_words"], r["__n_hit"]) for r in carried(out, 7)}
    want = brute.contamination(ROWS, [(1, items.first().text)])
    assert got == {k: v[:2] for k, v in want.items()}


def test_results_do_not_depend_on_other_columns(spark):
    docs = crowded(spark)
    got = {r._d: (r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_substrings(docs).collect()}
    assert got == {-(2**63) if k is None else k: v[:2] for k, v in brute.substrings(ROWS).items()}
    got = {r._d: (r.n_words, r.n_removed) for r in superkmers.dedup_windows(docs).collect()}
    assert got == {-(2**63) if k is None else k: v[:2] for k, v in brute.windows(ROWS).items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.component_ids(docs).collect()}
    assert got == brute.groups(ROWS, 5, 80)


def test_tables_of_other_kinds(spark):
    more = {c: F.lit("x") for c in ("row", "own", "v", "g", "p", "b", "floor", "len2", "rank", "score", "E")}
    vectors = spark.createDataFrame([(k, [float(k % 7), 1.0 / (k + 1)]) for k in range(50)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(vectors.withColumns(more)).collect())) == sorted(map(tuple, topk.top_k(vectors).collect()))
    more = {c: F.lit("x") for c in ("sha", "refers", "first", "ts", "n", "file", "k", "run", "head", "key")}
    pages = spark.createDataFrame([(k, f"http://a.example/{k % 5}", "x" * (k % 3)) for k in range(20)], "page_id long, url string, html string")
    plain = [tuple(r)[:7] for r in warc.round_trip(pages).collect()]
    assert [tuple(r)[:7] for r in warc.round_trip(pages.withColumns(more)).collect()] == plain
    captures = pages.select("page_id", "url", F.lit(5).alias("fetched_at"))
    entries = spark.createDataFrame([("host", "a.example", "add", 1)], "kind string, key string, action string, ts long")
    crowd = {c: F.lit("x") for c in ("rule", "since", "until", "bucket", "salt", "rules", "_h", "_c", "_n", "_m")}
    assert url_filter.filter_urls(captures.withColumns(crowd), entries.withColumns({c: F.lit(1) for c in ("rule", "on", "until")})).where("blocked").count() == 20


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_carries_every_column(spark, tables, tmp_path):
    import corpus_pipeline

    items, labels = tables
    crowded(spark).write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    carried(corpus_pipeline.run(spark, str(tmp_path)), 5)
