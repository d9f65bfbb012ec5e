"""Whitening against a dense eigendecomposition, sums against whole numbers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidewell.llm import queries, whiten


def brute(rows, k=4, scale=256):
    """[(vec_id, component, n, deviation, |whitened|, explained)], from the whole covariance."""
    good = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(v) for _, v in good), default=0)
    good = [(i, tuple(v + [0] * (d - len(v)))) for i, v in good]
    fit = sorted({v for _, v in good})
    n = len(fit)
    if not n or not d:
        return []
    sums = [sum(v[j] for v in fit) for j in range(d)]
    mean = np.array([s / n for s in sums])
    x = np.array(fit, float) - mean
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u, trace = e[::-1], u[:, ::-1], e.sum()
    out = []
    for i, v in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        for j in range(min(k, d)):
            live = e[j] > 1e-12 * trace
            out.append((i, j + 1, n, deviation, abs((np.array(v) - mean) @ u[:, j]) / math.sqrt(e[j]) if live else None, e[j] / trace if live else 0.0))
    return sorted(out, key=repr)


def same(df, rows, k=4):
    got = sorted(((r.vec_id, r.component, r.n, int(r.deviation), None if r.whitened is None else abs(r.whitened), r.explained, r.identity_error) for r in df.collect()), key=repr)
    want = brute(rows, k)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda t: repr(t[:4])), sorted(want, key=lambda t: repr(t[:4])), strict=True):
        assert g[:4] == w[:4]
        assert g[4:6] == pytest.approx(w[4:6], rel=1e-7, abs=1e-7) if w[4] is not None else g[4:6] == (None, 0.0)
        assert g[6] < 1e-9
    assert len({g[6] for g in got}) <= 1
    return got


def vectors(seed, n, d):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d)) * np.linspace(3, 1, d) + draw.standard_normal(d) * 5
    return [(k, [float(c) for c in row]) for k, row in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def single(rows):
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]


def test_whitening_equals_a_dense_decomposition(spark):
    rows = vectors(1, 300, 20)
    rows += [(k + 1000, v) for k, v in rows[:100]] + [rows[5], (None, rows[7][1])]  # copies, a repeated row, no id
    rows += [(2000, None), (2001, [1.0, None] * 10), (2002, [float("nan")] * 20), (2003, [1.0] * 19 + [float("-inf")])]
    got = same(whiten.whiten(frame(spark, rows).repartition(5)), single(rows))
    assert {g[2] for g in got} == {300}


@pytest.mark.parametrize(
    "rows",
    [
        [(1, [0.5, 1.5, 2.0])],
        [(1, [0.5, 1.5]), (2, [0.5, 1.5])],
        [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [2.0, 0.0, 1.0, 4.0, 9.0]), (3, [0.0, 0.0, 0.0, 1.0, 1.0])],  # fewer vectors than components
        [(k, [float(k), float(k * k % 7)]) for k in range(20)],  # fewer dimensions than components
        [(1, [3.0]), (2, [3.5, 1.0]), (3, []), (4, [0.0, 0.0, 7.0])],  # short ones are followed by zeros
    ],
)
def test_small_and_ragged_tables(spark, rows):
    same(whiten.whiten(frame(spark, rows)), rows)


def test_no_rows_clashing_names_and_limits(spark):
    rows = vectors(2, 40, 6)
    df = frame(spark, rows)
    assert whiten.whiten(df.where("false")).collect() == []
    assert whiten.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    crowded = df.select("*", *[F.lit("y").alias(c) for c in ("x", "X0", "n", "component", "deviation", "k", "v", "s", "q", "a.b")])
    same(whiten.whiten(crowded), single(rows))
    with pytest.raises(ValueError):
        whiten.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [0.0, 1.0])]))


def test_large_numbers_are_exact(spark):
    rows = [(k, [2.0**31 + 256 * k, -(2.0**31) + 512.0 * (k % 5), 1.0 * k]) for k in range(50)]
    got = {r.vec_id: int(r.deviation) for r in whiten.whiten(frame(spark, rows)).collect()}
    assert got == {i: dev for i, _, _, dev, *_ in brute(single(rows))}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 12), st.integers(0, 99))
def test_lobpcg_finds_the_largest(d, k, guards, seed):
    draw = np.random.default_rng(seed)
    m = draw.standard_normal((d, max(1, d - seed % 3)))
    v = m @ m.T
    found = whiten.lobpcg(lambda b: v @ b, d, k, guards)
    want = np.linalg.eigvalsh(v)[::-1][: min(k, d)]
    assert np.allclose(found.values, want, atol=1e-10 * want[0])
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(want)), atol=1e-10)
    assert (np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0) <= 1e-11 * want[0]).all()


def test_iteration_that_does_not_end_fails():
    with pytest.raises(RuntimeError):
        whiten.lobpcg(lambda b: np.diag(np.linspace(1, 2, 60)) @ b, 60, 4, 0, max_steps=2)


def test_the_covariance_is_taken_in_blocks(spark):
    fit = whiten.fit_list(frame(spark, vectors(3, 200, 9)).select(whiten.numbers(F.col("embedding")).alias("x")))
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((9, 4)))[0]
    x = np.array([r.x for r in fit.vectors.collect()], float)
    want = np.cov(x.T, bias=True)
    assert np.allclose(whiten.product(fit, basis), want @ basis, rtol=1e-12, atol=1e-9)
    assert fit.trace == pytest.approx(np.trace(want), rel=1e-12)


def test_the_query_over_the_whole_table(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    df = queries.QUERIES["op11_whitening"](spark, DATA)
    assert dict(df.dtypes)["deviation"] == "bigint"
    same(df, rows)
