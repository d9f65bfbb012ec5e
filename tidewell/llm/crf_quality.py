"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is good or bad.  Its features are shares of character classes, word lengths,
repetition inside the line and of earlier lines, and the same of the line before and after.
Neighbouring labels are tied by a 2 x 2 transition table.  Training maximises the labels'
conditional likelihood (the lines of a labelled document carry its label) on about `max_docs`
labelled rows and `max_bytes` of text at most, chosen by a hash of the id; both bounds are
parameters, and no text is left out for its length (but one longer than all of `max_bytes`).  Scoring runs the
forward-backward recursions over every line of the whole text and takes the mean marginal
of `good`, weighted by the lines' lengths.

Cases: null and empty texts (and texts of line breaks alone) score the share of good
documents in training; with no labelled row, or labels of one kind only, the weights stay
near zero and the score near that share; null labels teach nothing; repeated rows are scored alike; very
long texts are scored whole, line by line; an empty table gives an empty result; a score of exactly 0.5
counts as good; other columns are carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, fresh, in_arrow, in_parts, not_space, released, text_buffer, word_names, word_spans

MAX_DOCS, MAX_BYTES = 6_000, 32 << 20
STEPS = 120
#: Character classes; shares of each are features: lower, upper, digit, space, end marks,
#: pipes, other signs, bytes beyond ASCII.
CLASSES = 8


def byte_classes() -> np.ndarray:
    table = np.full(256, 6, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[[33, 44, 46, 63]] = 4
    table[124] = 5
    table[128:] = 7
    return table


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, length of each line, first line of each document); blank lines are left out."""
    is_break = np.ones(256, bool)
    is_break[10] = False
    starts, ends, first = word_spans(data, offsets, is_break)
    n = len(starts)
    size = (ends - starts).astype(float)
    table = byte_classes()[data] if len(data) else data
    out = np.zeros((n, CLASSES + 7))
    for k in range(CLASSES):
        sums = np.concatenate([[0], np.cumsum(table == k, dtype=np.int32)])
        out[:, k] = (sums[ends] - sums[starts]) / np.maximum(size, 1)
    bounds = np.r_[starts, len(data)]
    w0, w1, at = word_spans(data, bounds, not_space())
    line = np.repeat(np.arange(n), np.diff(at)[:n])
    w0, w1 = w0[at[0] :], w1[at[0] :]
    names = word_names(data, w0, w1)
    words = np.maximum(np.bincount(line, minlength=n), 1)
    order = np.lexsort((names, line))
    a, b = line[order], names[order]
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    out[:, CLASSES] = np.bincount(a[fresh], minlength=n) / words
    out[:, CLASSES + 1] = np.minimum((size / words) / 10, 3)
    out[:, CLASSES + 2] = np.log1p(words) / 5
    long = (w1 - w0) > 20
    out[:, CLASSES + 3] = np.bincount(line[long], minlength=n) / words
    signed = (table[np.minimum(w1 - 1, len(data) - 1)] >= 5) & (table[np.minimum(w1 - 1, len(data) - 1)] < 7) if len(w1) else np.zeros(0, bool)
    out[:, CLASSES + 4] = np.bincount(line[signed], minlength=n) / words
    # an earlier line of the document is the same
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = word_names(data, starts, ends)
    order = np.lexsort((np.arange(n), whole, doc))
    again = np.zeros(n, bool)
    again[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]])
    out[:, CLASSES + 5] = again
    out[:, CLASSES + 6] = size < 30
    return out, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (zero at the ends), and a constant."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        begin, stop = first[:-1][np.diff(first) > 0], first[1:][np.diff(first) > 0] - 1
        before[begin], after[stop] = 0, 0
    return np.hstack([x, 0.5 * before, 0.5 * after, np.ones((len(x), 1))])


def marginals(unary: np.ndarray, first: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected transition counts, all documents side by side.

    unary: score of good against bad by line.  pair: log weights of (before, now).
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size.max(initial=0))
    live = [int(np.searchsorted(-size, -k, "left")) for k in range(longest)]
    score = np.zeros((len(unary), 2))
    score[:, 1] = unary
    weight = np.exp(pair)
    forward, backward = np.zeros((len(unary), 2)), np.ones((len(unary), 2))
    factor = np.exp(score - score.max(1, keepdims=True))
    for k in range(longest):
        rows = begin[: live[k]] + k
        now = factor[rows] if k == 0 else (forward[rows - 1] @ weight) * factor[rows]
        forward[rows] = now / now.sum(1, keepdims=True)
    both = np.zeros((2, 2))
    for k in range(longest - 2, -1, -1):
        rows = begin[: live[k + 1]] + k
        ahead = factor[rows + 1] * backward[rows + 1]
        now = ahead @ weight.T
        joint = forward[rows][:, :, None] * weight[None] * ahead[:, None, :]
        both += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        backward[rows] = now / now.sum(1, keepdims=True)
    post = forward * backward
    return post[:, 1] / np.maximum(post.sum(1), 1e-300), both


def document_scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x, size, first = line_features(data, offsets)
    x = with_neighbours((x - model["mean"]) / model["scale"], first)
    good, _ = marginals(x @ model["weights"], first, model["pair"])
    sums = np.concatenate([[0], np.cumsum(good * size)])
    length = np.concatenate([[0], np.cumsum(size)])
    total = length[first[1:]] - length[first[:-1]]
    out = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(total, 1)
    return np.clip(np.where(total > 0, out, model["share"]), 0.0, 1.0)


def train(texts, labels: list[int], steps: int = STEPS) -> dict:
    """Weights by Adam ascent of the lines' mean conditional log-likelihood.  texts: an Arrow
    column, or a list of texts."""
    data, offsets = text_buffer(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    parts, sizes = [], [0]
    for a, b in chunks(offsets):
        x, _, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(x)
        sizes += np.diff(first).tolist()
    x = np.concatenate(parts) if parts else np.zeros((0, CLASSES + 7))
    first = np.cumsum(sizes)
    y = np.array(labels, float)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = with_neighbours((x - mean) / scale, first)
    lines = np.diff(first)
    line_y = np.repeat(y, lines)
    weights, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    share = float(y.mean()) if len(y) else 0.5
    seen = np.zeros((2, 2))
    for k, v in ((0, 1 - y), (1, y)):
        seen[k, k] = (v * np.maximum(lines - 1, 0)).sum()
    total = max(1, len(x))
    m = [np.zeros_like(weights), np.zeros_like(pair)]
    v = [np.zeros_like(weights), np.zeros_like(pair)]
    both_kinds = len(y) and 0 < share < 1
    for step in range(1, steps + 1 if both_kinds else 1):
        good, both = marginals(x @ weights, first, pair)
        grads = [x.T @ (line_y - good) / total - 1e-3 * weights, (seen - both) / total - 1e-2 * pair]
        for k, (w, g) in enumerate(zip((weights, pair), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w += 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    if not both_kinds:
        weights[-1] = np.log((share + 0.05) / (1.05 - share))
    return {"mean": mean, "scale": scale, "weights": weights, "pair": pair, "share": min(max(share, 0.0), 1.0)}


#: Lots that labelled texts are drawn by; a lot is taken whole or not at all.
LOTS = 1 << 14


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`text` and `quality` of labelled documents that may teach (crc32 of the id leaves another
    remainder than 1): about `max_docs` labels, which bounds what is broadcast, and of their rows
    (an id may be repeated) as many as `max_bytes` of text hold, both chosen by a hash, whatever
    their length; only a text that is longer than that bound by itself cannot teach.  Of several
    labels of an id the lowest counts."""
    own = labels.select(F.col("doc_id").cast("long").alias("_l"), F.col("quality").cast("int").alias("quality"))
    own = own.where("_l is not null and quality in (0, 1)").where(F.crc32(F.col("_l").cast("string")) % 3 != 1).groupBy("_l").agg(F.min("quality").alias("quality"))
    total = own.count()
    if total > max_docs:
        own = own.where(F.pmod(F.xxhash64("_l"), F.lit(1 << 30)) < int((1 << 30) * max_docs / total))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = texts.join(F.broadcast(own), F.col("doc_id") == F.col("_l")).withColumn("_k", F.pmod(F.xxhash64("_l", "text"), F.lit(LOTS)))
    held = found.groupBy("_k").agg(F.sum(F.octet_length("text").cast("long")).alias("size")).collect()  # LOTS small rows at most
    taken, size = [], 0
    for k, more in sorted((r["_k"], r["size"]) for r in held):
        if size + more <= max_bytes:
            taken.append(k)
            size += more
    if len(taken) < len(held):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in taken], "_k long")), "_k", "left_semi")
    return found.select("text", "quality")


def fit(labelled: DataFrame, steps: int = STEPS) -> dict:
    """The model from rows of `text` and `quality` (0 or 1), which the caller has bounded."""
    got = labelled.orderBy(F.xxhash64("text"), "quality").toArrow()
    model = train(got.column("text"), got.column("quality").to_pylist(), steps)
    del got
    released()
    return model


def _scored(model_b, name: str):
    def run(batches):
        model = model_b.value
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            out = [document_scores(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of `docs` (it needs `text`) and `_score`, the document's quality (with more
    underscores in front if `docs` has such a column)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh(docs.columns, "_score")
    return in_arrow(docs, in_parts(_scored(held, name)), T.StructType(docs.schema.fields + [T.StructField(name, T.DoubleType())]))
