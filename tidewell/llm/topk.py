"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by vector length in at most `GROUPS` levels, cut at quantiles; a level is
split by a hash into chunks of about `CHUNK` vectors, so equal lengths never make one large
chunk.  Queries go in blocks.

1. Every query meets one chunk of the longest vectors; its k-th score there is a floor.
2. Levels follow from long to short, four at first, then three times as many as all before, and
   the floors rise between rounds.  A chunk is sent to a query's block only if |query| * (longest of the
   level) reaches the floor.  In the task the local cosine threshold, floor / (|query| *
   longest), chooses the pruning: if it is high, coordinate pruning (a candidate's share on the
   query's strongest coordinates must lie in the interval the threshold allows), else length
   pruning (only the candidates long enough, a prefix in length order).
3. The survivors' integer products are computed exactly, and those that reach the floor are
   merged; ties go to the smaller id.

Components are floor(64 * x).  Bounds carry a slack against rounding, products do not: they
are computed in doubles while all sums stay below 2**53, in whole numbers beyond; one that no
64-bit score can hold raises an error rather than a wrong rank.

Cases: vectors that are null or hold null or non-finite components take no part; every other row
is a candidate, rows without id too (they come last in ties) and rows that repeat an id, with
the same vector or another; a query leaves out its own row only, and a query whose id is
repeated is answered for each of its rows; shorter vectors are continued with zeros; fewer than
k candidates are all returned; an empty table gives an empty result; other columns are not read,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

K, SCALE, EVERY = 20, 64, 20
CHUNK, BLOCK, GROUPS = 4096, 1024, 1024
LAST_ID = 2**63 - 1
#: Local cosine thresholds from which single coordinates prune more than lengths do.
COORDINATE_FROM = 0.8


def scaled(vectors: DataFrame) -> DataFrame:
    """`row`, `vec_id`, `v` (integer components) and `len2` (squared length) of the usable rows."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.col("e").isNotNull() & ~F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    v = x.where(usable).select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    return v.withColumn("row", F.monotonically_increasing_id()).withColumn("len2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    size = np.diff(at)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = flat[at[0] : at[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and not -(2**63) <= exact.min() <= exact.max() < 2**63:
        raise OverflowError("an inner product that no 64-bit score can hold")
    return exact.astype(np.int64)


def best(q_own, q, floors, c_own, c_ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's best k candidates that reach its floor.
    A candidate with the query's `own` value is its own row."""
    order = np.argsort(-(c.astype(float) ** 2).sum(1), kind="stable")
    c_own, c_ids, c = c_own[order], c_ids[order], c[order]
    c_len = np.sqrt((c.astype(float) ** 2).sum(1))
    q_len = np.sqrt((q.astype(float) ** 2).sum(1))
    slack = 1 - 1e-9
    longest = c_len[0] if len(c_len) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len * longest > 0, floors / (q_len * longest), np.where(floors > 0, np.inf, -np.inf))
        need = np.where(q_len > 0, floors / q_len, np.where(floors > 0, np.inf, -np.inf)) * slack
    # length pruning: candidates are in length order, so a query needs a prefix
    prefix = np.searchsorted(-c_len, -need, "right")
    prefix[need <= 0] = len(c)
    out: list[tuple] = []

    def keep(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        use = np.flatnonzero((scores >= floors[i]) & (c_own[rows] != q_own[i]))
        if len(use) > k:
            least = np.partition(scores[use], len(use) - k)[len(use) - k]
            use = use[scores[use] >= least]
        use = use[np.lexsort((c_ids[rows[use]], -scores[use]))[:k]]
        out.append((np.full(len(use), i), order[rows[use]], scores[use]))

    strict = local >= COORDINATE_FROM
    if strict.any():
        unit = c / np.maximum(c_len, 1e-300)[:, None]
        for i in np.flatnonzero(strict & (prefix > 0)):
            t = min(1.0, local[i] * slack)
            u = q[i] / q_len[i]
            on = np.arange(prefix[i])
            for f in np.argsort(-np.abs(u))[:2]:
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f]))) + 1e-7
                # beyond the cosine interval of the threshold no unit vector on this side reaches it
                low = -1.0 if -u[f] >= t else u[f] * t - spread
                high = 1.0 if u[f] >= t else u[f] * t + spread
                on = on[(unit[on, f] >= low) & (unit[on, f] <= high)]
            if len(on):
                keep(i, on, products(q[i : i + 1], c[on])[0])
    plain = np.flatnonzero(~strict & (prefix > 0))
    plain = plain[np.argsort(-prefix[plain], kind="stable")]
    for at in range(0, len(plain), 256):
        own = plain[at : at + 256]
        rows = np.arange(prefix[own[0]])
        for i, scores in zip(own, products(q[own], c[rows]), strict=True):
            keep(i, rows[: prefix[i]], scores[: prefix[i]])
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _retrieve(k: int):
    def run(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        width = 1
        for t in (queries, candidates):
            if t.num_rows:
                width = max(width, int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)))
        q, c = (matrix(t.column("v"), width) if t.num_rows else np.zeros((0, width), np.int64) for t in (queries, candidates))
        ids = candidates.column("vec_id").combine_chunks()
        i, j, s = best(queries.column("own").to_numpy(), q, queries.column("floor").to_numpy().astype(float), candidates.column("own").to_numpy(), ids.fill_null(LAST_ID).to_numpy(), c, k)
        return pa.table({"row": queries.column("row").take(pa.array(i)), "query_id": queries.column("vec_id").take(pa.array(i)), "vec_id": ids.take(pa.array(j)), "score": pa.array(s, pa.int64())})

    return run


FOUND = "row long, query_id long, vec_id long, score long"


def best_first(found: DataFrame) -> Column:
    return F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = K, chunk: int = CHUNK, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the best `k` rows of `vectors` for each query.

    queries: rows of `vec_id` and `embedding`, which leave out the rows of their id; by default
    the rows whose id is divisible by 20, which leave out themselves.
    """
    spark = vectors.sparkSession
    all_ = checkpointed(scaled(vectors))
    if queries is None:
        all_ = all_.withColumn("own", F.col("row"))
        asked = all_.where(F.col("vec_id") % EVERY == 0)
    else:
        all_ = all_.withColumn("own", F.coalesce("vec_id", F.lit(LAST_ID)))
        asked = checkpointed(scaled(queries)).withColumn("own", F.coalesce("vec_id", F.lit(LAST_ID - 1)))
    total, n_queries = all_.count(), asked.count()
    if not total or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = max(1, min(groups, total // chunk))
    bounds = sorted(set(all_.select(F.percentile_approx("len2", [g / groups for g in range(1, groups)], 10_000)).first()[0])) if groups > 1 else []
    level = F.size(F.filter(F.lit(bounds), lambda b: F.col("len2") < b)) if bounds else F.lit(0)
    graded = all_.withColumn("g", level)
    # a row for each level, the longest first: its number, its chunks, its longest vector
    levels = [(r.g, max(1, -(-r.n // chunk)), r.m) for r in graded.groupBy("g").agg(F.count("*").alias("n"), F.sqrt(F.max("len2")).alias("m")).orderBy("g").collect()]
    table = F.broadcast(spark.createDataFrame(levels, "g int, n int, m double"))
    placed = graded.join(table, "g").withColumn("p", F.pmod(F.xxhash64("row"), F.col("n")).cast("int")).select("row", "own", "vec_id", "v", "g", "p")
    blocks = max(1, -(-n_queries // block))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int"))

    def met(q: DataFrame, c: DataFrame) -> DataFrame:
        # both sides come from one table: their columns are named anew
        q, c = (x.select(*[F.col(n).alias(n) for n in names]) for x, names in ((q, ("row", "own", "vec_id", "v", "floor", "g", "p", "b")), (c, ("own", "vec_id", "v", "g", "p", "b"))))
        pair = q.groupBy("g", "p", "b").cogroup(c.groupBy("g", "p", "b"))
        return pair.applyInArrow(_retrieve(k), FOUND)

    lowest, first = F.lit(float("-inf")), levels[0][0]
    longest = placed.where((F.col("g") == first) & (F.col("p") == 0))
    seeds = asked.withColumns({"floor": lowest, "g": F.lit(first), "p": F.lit(0)})
    now = checkpointed(met(seeds, longest.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))))
    at = 0
    while at < len(levels):
        part = levels[at : at + max(4, 3 * at)]
        at += len(part)
        own = [x[0] for x in part]
        floor = now.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(lowest).alias("floor"))
        wide = asked.join(floor, "row", "left").withColumn("floor", F.coalesce("floor", lowest))
        array = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(n).alias("n"), F.lit(float(m)).alias("m")) for g, n, m in part])
        # a chunk goes to the blocks that still have a query for it
        reached = F.filter(array, lambda x: (F.col("floor") <= 0) | (F.sqrt("len2") * x["m"] * (1 + 1e-9) >= F.col("floor")))
        wide = wide.select("row", "own", "vec_id", "v", "floor", "b", F.explode(reached).alias("x")).select("row", "own", "vec_id", "v", "floor", "b", F.col("x.g").alias("g"), F.explode(F.sequence(F.lit(0), F.col("x.n") - 1)).alias("p"))
        wide = wide.where((F.col("g") != first) | (F.col("p") != 0))
        wanted = wide.select(*[F.col(n).alias(n) for n in ("g", "p", "b")]).distinct()
        there = placed.where(F.col("g").isin(own)).join(wanted, ["g", "p"])
        merged = now.union(met(wide, there))
        now = checkpointed(merged.withColumn("rank", best_first(merged)).where(F.col("rank") <= k).drop("rank"))
    return now.withColumn("rank", best_first(now)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
