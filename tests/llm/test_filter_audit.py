"""The filter audit against plain Python, order by order."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tidewell.llm import filter_audit, queries

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(rows, labels):
    """{(part, order, step): counts}, a document at a time."""
    low = -(2**63)
    key = lambda i: low if i is None else i
    failed = []
    for i, text, part in rows:
        t, out = text or "", set()
        w = words_of(t)
        out |= {"A"} if len(w) < 200 else set()
        out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        out |= {"D"} if any(c in t for c in "#$%&*|") else set()
        out |= {"E"} if any((x[1] or "") == t and key(x[0]) < key(i) for x in rows) else set()
        failed.append((part or "", out, any(j == i and q == 1 for j, q, _ in labels if j is not None), any(j == i and t1 == 1 for j, _, t1 in labels if j is not None)))
    found = {}
    for part in {p for p, *_ in failed}:
        docs = [f[1:] for f in failed if f[0] == part]
        for order in permutations("ABCDE"):
            left = docs
            for step, own in enumerate(order, 1):
                gone = [d for d in left if own in d[0]]
                earlier = sum(own in d[0] and bool(d[0] & set(order[: step - 1])) for d in docs)
                left = [d for d in left if own not in d[0]]
                found[part, "".join(order), step] = [len(left), len(gone), earlier, sum(d[0] == {own} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
    for part in {p for p, *_ in failed}:
        for own in "ABCDE":
            at = [k for k in found if k[0] == part and k[1][k[2] - 1] == own]
            total = sum(found[k][1] for k in at)
            for k in at:
                found[k] = (*found[k], total)
    return found


LONG = " ".join(f"w{k}" for k in range(250))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "de"), (3, LONG + " $", "en"), (4, "UP " * 300, "en"), (5, "a b " * 200, "de"), (6, "a b " * 200, None), (6, "a b " * 200, None),
    (7, None, "de"), (8, "", "de"), (None, "", ""), (None, LONG, "en"), (None, LONG, "en"), (9, "é" * 50 + "A" * 2, "fr"), (10, "tab\tfeed\x0cend", "fr"), (11, "x | y", "fr"), (12, "w " * 400 + "# " + "Z" * 60, "fr"), (13, "no break space", "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 0, 1), (5, 1, 1), (None, 1, 1), (6, None, 1), (99, 1, 1), (7, 1, None)]


def frames(spark, rows=ROWS, labels=LABELS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def counts(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_plain_python(spark):
    docs, labels = frames(spark)
    df = filter_audit.audit(docs.repartition(3), labels)
    got = counts(df)
    assert got == brute(ROWS, LABELS)
    assert df.count() == len(got) == 120 * 5 * len({p or "" for *_, p in ROWS})
    assert dict(df.dtypes) == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint")


def test_audit_of_equal_rows_and_long_texts(spark):
    rows = [(k % 3, "same text", "en") for k in range(30)] + [(50 + k, ("word%d " % k) * 400_000, "en") for k in range(2)]
    got = counts(filter_audit.audit(*frames(spark, rows)))
    assert got["en", "EABCD", 1][:2] == (12, 20)  # the ten rows of the smallest id and the two long texts stay
    assert got == brute(rows, LABELS)


def test_audit_carries_on_with_clashing_names_and_no_rows(spark):
    docs, labels = frames(spark)
    names = ["n", "mask", "id", "t", "u", "salt", "part", "quality", "toxic", "least", "first", "passed", "bit", "gone", "fails", "a.b"]
    crowded = docs.select("*", *[F.lit("x").alias(c) for c in names])
    told = labels.select("*", *[F.lit("x").alias(c) for c in ("id", "salt", "text", "a.b")])
    assert counts(filter_audit.audit(crowded, told)) == brute(ROWS, LABELS)
    assert filter_audit.audit(docs.where("false"), labels).count() == 0
    assert counts(filter_audit.audit(docs, labels.where("false"))) == brute(ROWS, [])


def test_other_filters_and_refusals(spark):
    docs, labels = frames(spark, [(1, "ab", "x"), (2, "abc", "x"), (3, "ab", "y")])
    got = counts(filter_audit.audit(docs, labels, filters=lambda t: {"S": F.length(t) < 3}))
    assert got["x", "SE", 1] == (1, 1, 0, 1, 1, 0, 2)
    assert got["y", "SE", 2][:4] == (0, 0, 1, 0)
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, filters=lambda t: {"E": t.isNull()})
    with pytest.raises(ValueError):
        filter_audit.interactions(filter_audit.mask_cells(docs, labels), "AA")


def test_query_equals_sql(spark):
    assert_same(spark, queries.QUERIES["op12_filter_audit"], queries.ORACLE["op12_filter_audit"])
