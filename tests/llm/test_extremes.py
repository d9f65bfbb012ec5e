"""Far dates, products beyond 64 bits and long labelled texts."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import crf_quality, topk, url_filter

FAR = 10**15


@pytest.mark.parametrize("captures_far", [False, True])
def test_url_filter_at_far_dates(spark, captures_far):
    draw = random.Random(4)
    day = 86_400
    hosts = [f"h{k}.example.org" for k in range(6)]
    entries = [("host", h, draw.choice(["add", "add", "remove"]), draw.choice([-FAR, 0, FAR, *range(0, 400 * day, 50 * day)])) for h in hosts for _ in range(4)]
    entries += [("domain", "example.org", "add", 100 * day), ("domain", "example.org", "remove", 130 * day), ("host", hosts[0], "add", None)]
    times = [None, 0, 1, *(draw.randrange(400 * day) for _ in range(60)), *([-FAR, FAR, FAR + 1] if captures_far else [])]
    captures = [(k, f"http://{draw.choice(hosts)}/a", t) for k, t in enumerate(times)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at long")
    e = spark.createDataFrame(entries, "kind string, key string, action string, ts long")
    plain = sorted(map(tuple, url_filter.filter_urls(c, e).collect()), key=repr)
    salted = sorted(map(tuple, url_filter.filter_urls(c, e, max_broadcast=0, salts=3).collect()), key=repr)
    assert salted == plain
    assert any(r[-1] for r in plain) and not all(r[-1] for r in plain)
    assert url_filter.filter_urls(c.where("false"), e, max_broadcast=0).collect() == []


def test_top_k_of_very_large_vectors(spark):
    rows = [(0, [2.0**25, 2.0**20]), (1, [2.0**24, 3.0]), (2, [2.0**23, -(2.0**23)]), (3, [-(2.0**24), 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    exact = {i: sum(int(64 * a) * int(64 * b) for a, b in zip(rows[0][1], v, strict=True)) for i, v in rows[1:]}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == sorted(exact.items(), key=lambda x: -x[1])[:2]
    with pytest.raises(Exception, match="64-bit score"):
        topk.top_k(spark.createDataFrame([(0, [2.0**27]), (1, [2.0**28])], "vec_id long, embedding array<double>")).collect()


def test_long_labelled_texts_teach(spark):
    rows = [(k, "good line of text\n" * (40_000 if k == 7 else 5)) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    may = {k for k in range(40) if spark.range(1).select(F.crc32(F.lit(str(k))) % 3).first()[0] != 1}
    got = crf_quality.training_rows(docs, labels, max_bytes=1_000_000)
    assert got.count() == len(may)
    assert 7 not in may or got.agg(F.max(F.length("text"))).first()[0] == 720_000
    few = crf_quality.training_rows(docs, labels, max_bytes=1000).collect()
    assert 0 < len(few) < len(may) and sum(len(r.text) for r in few) <= 1000
