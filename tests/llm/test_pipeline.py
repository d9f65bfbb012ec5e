"""The pipeline's stages, each on its own input, against plain Python."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")

ROWS = [r for r in brute.corpus(seed=5, n=50) if r[0] is None or r[0] != 56] + [(90, "12 %% !!"), (91, brute.corpus(seed=5, n=50)[1][1])]
ROWS.append(ROWS[4])  # a repeated row
ITEMS = [(k, " ".join(brute.ALNUM.findall((ROWS[k][1] or "").translate(brute.LOW))[:12])) for k in range(0, 20, 3)] + [(99, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "xx", f"s{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, k % 2, 0) for k, (i, _) in enumerate(ROWS[:30])], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def cut_characters(rows, length=200):
    texts = {(i, t): (t or "").encode() for i, t in rows}
    count = {}
    for b in texts.values():
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] = count.get(b[p : p + length], 0) + 1
    out = []
    for (i, t), b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        if not any(gone):
            out.append((i, t))
            continue
        text, at = "", 0
        for c in t:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                text += c
            at += size
        out.append((i, text))
    return out


def cut_words(rows, items):
    out = []
    held = set()
    for _, text in items:
        w = brute.ALNUM.findall((text or "").translate(brute.LOW))
        held |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9) if w else 0)}
    for i, t in rows:
        words = list(brute.ALNUM.finditer((t or "").translate(brute.LOW)))
        spans = [(words[p].start(), words[p + len(h) - 1].end()) for h in held for p in range(len(words) - len(h) + 1) if tuple(x.group() for x in words[p : p + len(h)]) == h]
        gone = {k for a, b in spans for k in range(a, b)}
        out.append((i, "".join(c for k, c in enumerate(t) if k not in gone) if gone else t))
    return out


def key(r):
    return (-1 if r[0] is None else r[0], r[1] or "")


def test_stages(spark, folder, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=key)
        seen.append(name)
        if name == "language_id":
            want = [r for r in before if any(c.isalpha() for c in r[1] or "")]
            assert len(want) < len(before)
        elif name == "jaccard_join":
            groups, least = brute.groups(before, 5, 80), {}
            for i, (_, root) in groups.items():
                least[root] = min(least.get(root, i), i, key=lambda x: -1 if x is None else x)
            want = [*{r: None for r in before if least[groups[r[0]][1]] == r[0]}]
            assert len(want) < len(before)
        elif name == "suffix_dedup":
            want = cut_characters(before)
            assert sorted(want, key=key) != sorted(before, key=key)
        elif name == "decontamination":
            want = cut_words(before, ITEMS)
            assert sorted(want, key=key) != sorted(before, key=key)
        else:
            want = before
        assert after == sorted(want, key=key), name
        assert docs.columns[: len(columns)] == columns
        if name not in ("language_id", "jaccard_join", "mixing"):
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert seen == ["language_id", "jaccard_join", "suffix_dedup", "decontamination", "mixing"]
    assert set(docs.columns) - set(columns) == {"n_tokens", "rate", "p_clean", "p_low", "p_toxic"}
    assert docs.where("rate < 0 or rate is null").count() == 0


def test_run_equals_the_stages(spark, folder, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert out.columns == docs.columns

    def rows(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)

    assert rows(out) == rows(docs)
    assert len(rows(out)) > 10


def test_empty_table(spark, tmp_path, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0
