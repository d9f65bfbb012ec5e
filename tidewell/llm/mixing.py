"""Mixing to target weights with soft membership, in DataFrame operations only.

Domains come from a labelled table.  A multinomial naive Bayes classifier, fitted on at most
`max_docs` labelled documents, predicts for every document its posterior share of each domain.
Words are counted by a hash in `buckets` cells: all words count, and the table of cells that is
broadcast has that many rows at most.  With x[i, k] = tokens of
document i times its share of domain k, nonnegative rates r are sought whose expected totals
E[k] = sum of r[i] * x[i, k] match the targets T[k] = weight[k] * budget in the least squares
sense.  Rates start at 1 and take projected gradient steps r <- max(0, r - x . g) with
g = M (E - T).  With M the inverse of the second moments of x over all documents a step of 1
never goes uphill in (E - T) . M (E - T).  A bolder M, over the documents whose rate is above
0, would meet the targets if no further rate fell to 0; such a step is kept if it gains a
tenth at least, and no longer tried after two that do not.

A step needs the K totals alone: a rate is a formula over x and the gradients so far, so an
iteration is one aggregation over the small table of x, and no rates are stored or collected.
Steps end when the targets are met, when a step gains less than a millionth (nonnegative rates
come no nearer), or after `max_steps`; targets that are not met are warned of, with the distance.

Cases: null and empty texts have no tokens and keep rate 1; documents without known words
have the prior as posterior; rows with null or unknown labels teach nothing; without labels
all domains are equally likely; repeated rows each have their rate, and count each; an empty
table gives an empty result; no tie is broken, as all is sums; a very long text is split to words in the
memory of one task; other columns are carried under their names, those made here get underscores
before them where they would clash.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, checkpointed, doc_key, fresh, quoted

MAX_DOCS, BUCKETS = 10_000, 1 << 17
SMOOTH = 0.5
MAX_STEPS, TOLERANCE = 60, 1e-6

log = logging.getLogger(__name__)


def tokens_of(text: Column) -> Column:
    """Lower-cased words between white space (blank, tab to carriage return); some may be empty."""
    text = F.lower(text)
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, " ")


def cell_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets))


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], max_docs: int = MAX_DOCS, buckets: int = BUCKETS) -> tuple[DataFrame, list[float]]:
    """(`cell` and a log weight `w0`, `w1`, ... for each domain, log priors).

    labels: `doc_id`, `domain`.  Of several domains of one id the smallest name counts.
    """
    k = len(domains)
    own = labels.select(F.col("doc_id").cast("long").alias("_l"), F.col("domain").cast("string").alias("_k"))
    own = own.where(F.col("_l").isNotNull() & F.col("_k").isin(domains)).groupBy("_l").agg(F.min("_k").alias("_k"))
    total = own.count()
    if total > max_docs:
        own = own.where(F.pmod(F.xxhash64("_l"), F.lit(1 << 30)) < int((1 << 30) * max_docs / total))
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("_l"))
    words = taught.select("_k", F.explode(tokens_of(F.col("text"))).alias("word")).where("word <> ''").select("_k", cell_of(F.col("word"), buckets).alias("cell"))
    of = [F.sum(F.when(F.col("_k") == d, 1).otherwise(0)).alias(f"c{j}") for j, d in enumerate(domains)]
    counts = checkpointed(words.groupBy("cell").agg(*of))
    sums = counts.agg(F.count("*").alias("v"), *[F.sum(f"c{j}").alias(f"s{j}") for j in range(k)]).first()
    rate = [F.log((F.col(f"c{j}") + SMOOTH) / F.lit(float((sums[f"s{j}"] or 0) + SMOOTH * max(1, sums["v"])))) for j in range(k)]
    mean = sum(rate[1:], rate[0]) / k
    model = counts.select("cell", *[(rate[j] - mean).alias(f"w{j}") for j in range(k)])
    seen = {r["_k"]: r["n"] for r in own.groupBy("_k").agg(F.count("*").alias("n")).collect()}
    prior = [float(np.log((seen.get(d, 0) + 1) / (sum(seen.values()) + k))) for d in domains]
    return model, prior


def memberships(docs: DataFrame, model: DataFrame, prior: list[float], buckets: int = BUCKETS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key, `_keep` (the `keep` columns in a struct, if any), `n_tokens` and `x0`, `x1`, ...
    (expected tokens by domain)."""
    k = len(prior)
    kept = [F.struct(*[F.col(quoted(c)).alias(c) for c in keep]).alias("_keep")] if keep else []
    own = [*KEY, *(["_keep"] if keep else [])]
    rows = docs.select(*doc_key(), *kept, F.monotonically_increasing_id().alias("_row"), tokens_of(F.col("text").cast("string")).alias("_words"))
    rows = rows.select(*own, "_row", F.explode_outer("_words").alias("_word")).withColumn("_cell", cell_of(F.col("_word"), buckets))
    met = rows.join(F.broadcast(model), F.col("_cell") == F.col("cell"), "left")
    # all that is kept is in the key: sums alone are aggregated by hash, without a sort
    spoken = F.col("_word") != ""
    out = met.groupBy("_row", *own).agg(
        F.count(F.when(spoken, 1)).alias("n_tokens"),
        *[(F.coalesce(F.sum(F.when(spoken, F.col(f"w{j}"))), F.lit(0.0)) + F.lit(prior[j])).alias(f"s{j}") for j in range(k)],
    )
    best = F.greatest(*[F.col(f"s{j}") for j in range(k)]) if k > 1 else F.col("s0")
    odds = [F.exp(F.col(f"s{j}") - best) for j in range(k)]
    whole = sum(odds[1:], odds[0])
    return out.select(*own, "n_tokens", *[(F.col("n_tokens") * odds[j] / whole).alias(f"x{j}") for j in range(k)])


def rate_of(gradients: list[np.ndarray]) -> Column:
    """The rate after these steps, from 1."""
    rate = F.lit(1.0)
    for g in gradients:
        step = sum((F.col(f"x{j}") * F.lit(float(v)) for j, v in enumerate(g)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - step)
    return rate


class Steps(list):
    """The gradients of the projected steps, with the totals they reach and those that were wanted."""

    def __init__(self, gradients=(), reached=(), wanted=()) -> None:
        super().__init__(gradients)
        self.reached, self.wanted = np.array(reached, float), np.array(wanted, float)

    @property
    def distance(self) -> float:
        """The largest miss of a target, as a share of all tokens wanted."""
        return float(np.abs(self.reached - self.wanted).max(initial=0) / max(self.wanted.sum(), 1.0))


def solve(x: DataFrame, weights: list[float], budget: float | None = None, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Steps:
    """The projected steps.  budget: tokens wanted in all, by default those there are."""
    k = len(weights)
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def totals(gradients: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray] | None:
        """Expected totals, and the second moments of x over the rates above 0."""
        rated = x.select(*[f"x{j}" for j in range(k)], rate_of(gradients).alias("_rate"))
        on = F.when(F.col("_rate") > 0, 1.0).otherwise(0.0)
        row = rated.agg(*[F.sum(F.col(f"x{j}") * F.col("_rate")) for j in range(k)], *[F.sum(F.col(f"x{a}") * F.col(f"x{b}") * on) for a, b in pairs]).first()
        if row[0] is None:
            return None
        moments = np.zeros((k, k))
        for (a, b), v in zip(pairs, row[k:], strict=True):
            moments[a, b] = moments[b, a] = float(v)
        return np.array([float(v) for v in row[:k]]), moments

    begun = totals([])
    if begun is None:
        return Steps()
    now, everywhere = begun
    share = np.array(weights, float) / max(sum(weights), 1e-300)
    target = share * (now.sum() if budget is None else budget)
    gradients: list[np.ndarray] = []
    ridge = lambda m: np.linalg.pinv(m + np.eye(k) * (1e-12 * np.trace(m) + 1e-300))
    safe, moments, failed = ridge(everywhere), everywhere, 0
    height = lambda v: float((v - target) @ safe @ (v - target))
    for _ in range(max_steps):
        if np.abs(now - target).max() <= tolerance * max(target.sum(), 1.0):
            break
        if failed < 2 and len(gradients):
            bold = [*gradients, ridge(moments) @ (now - target)]
            there = totals(bold)
            if height(there[0]) <= 0.9 * height(now):
                gradients, (now, moments) = bold, there
                continue
            failed += 1
        before = height(now)
        gradients.append(safe @ (now - target))
        now, moments = totals(gradients)
        if height(now) > (1 - 1e-6) * before:  # as near as nonnegative rates come
            break
    steps = Steps(gradients, now, target)
    if steps.distance > tolerance:
        log.warning("mixing: after %d steps a target is missed by %.3g of all tokens", len(steps), steps.distance)
    return steps


def mix_domains(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, keep: tuple[str, ...] = ("doc_id",), max_docs: int = MAX_DOCS, buckets: int = BUCKETS) -> DataFrame:
    """The key, the `keep` columns, `n_tokens`, `p_<domain>` (posteriors) and `rate` of every
    document; where `keep` has such a name, the new column gets underscores in front."""
    domains = sorted(weights)
    model, prior = fit(docs, labels, domains, max_docs, buckets)
    x = checkpointed(memberships(docs, model, prior, buckets, keep))
    gradients = solve(x, [weights[d] for d in domains], budget)
    share = [F.when(F.col("n_tokens") > 0, F.col(f"x{j}") / F.col("n_tokens")).otherwise(F.lit(float(np.exp(prior[j]) / np.exp(prior).sum()))) for j in range(len(domains))]
    name = lambda c: fresh(list(keep), c)
    return x.select(
        *[F.col(c).alias(name(c)) for c in KEY],
        *[F.col("_keep").getField(c).alias(c) for c in keep],
        F.col("n_tokens").alias(name("n_tokens")),
        *[share[j].alias(name(f"p_{d}")) for j, d in enumerate(domains)],
        rate_of(gradients).alias(name("rate")),
    )


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the quality labels: `low`, `toxic` (of good quality) or `clean`."""
    kind = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", kind.alias("domain"))


#: Target weights of the domains for the registered query and the pipeline.
TARGETS = {"clean": 0.9, "low": 0.05, "toxic": 0.05}


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """`docs` with `n_tokens`, the posteriors and `rate` beside its own columns; where `docs` has such
    a name, the new column gets underscores in front."""
    found = mix_domains(docs, labels, weights or TARGETS, keep=())
    new = [c for c in found.columns if c not in KEY]
    # written, so that a key of very many rows can be split where it is joined
    found = checkpointed(found.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in new]))
    rows = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("_row"), *doc_key())
    return rows.join(found, KEY, "left").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], *[F.col(c).alias(fresh(docs.columns, c)) for c in new])
