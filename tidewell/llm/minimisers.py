"""Minimiser runs: the shared first step of both exact-substring operators.

Every window of `length` symbols (bytes or words) is stood for by its smallest-named gram,
the leftmost on ties.  The choice depends on the window's content alone, so equal windows
choose equal grams at equal offsets.  Consecutive windows that choose the same gram form a
run.  A window can only be repeated if its gram is, so counting grams (a hundredth of the
positions) leaves few runs to look at closely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, byte_symbols, checkpointed, chunks, in_arrow, in_parts, keyed, mix, not_space, ragged, running, sliding_min, span, text_buffer, word_names, word_spans

#: Grams seen more often than this take the path that never gathers a gram's runs in one task.
HEAVY = 5000


def minimiser_runs(symbols: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, gram position, gram name) of every run.

    offsets: where documents begin in `symbols`.  Positions count from the first symbol.
    """
    per_doc = np.maximum(offsets[1:] - offsets[:-1] - length + 1, 0)
    if not per_doc.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    sums = running(symbols)
    at = np.arange(len(symbols) - gram + 1)
    names = mix(span(sums, at, at + gram))
    order = (names >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    least = sliding_min(order, length - gram + 1)
    windows = ragged(offsets[:-1], per_doc)
    place = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.r_[True, place[1:] != place[:-1]]
    ends = np.cumsum(per_doc)
    new[ends[(ends < len(windows)) & (per_doc > 0)]] = True
    begin = np.flatnonzero(new)
    stop = np.r_[begin[1:], len(windows)] - 1
    doc = np.searchsorted(ends, begin, "right")
    return doc, windows[begin], windows[stop], place[begin], names[place[begin]]


def symbols_of(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where documents begin in them, and the byte span of each symbol."""
    if not words:
        return byte_symbols()[data], offsets, np.arange(len(data)), np.arange(1, len(data) + 1)
    starts, ends, first = word_spans(data, offsets, not_space())
    return word_names(data, starts, ends), first, starts, ends


def _gram_rows(length: int, gram: int, words: bool):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            d, t, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in KEY)
            for a, b in chunks(offsets):
                symbols, first, _, _ = symbols_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                doc, _, _, _, name = minimiser_runs(symbols, first, length, gram)
                if not len(doc):
                    continue
                order = np.lexsort((name, doc))
                doc, name = doc[order], name[order]
                head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])])
                count = np.diff(np.r_[head, len(doc)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(d[a + doc[head]]), pa.array(t[a + doc[head]]), pa.array(u[a + doc[head]]), pa.array(name[head].view(np.int64)), pa.array(count)], names=[*KEY, "gram", "n"])

    return run


def repeated_grams(docs: DataFrame, length: int, gram: int, words: bool, heavy: int = HEAVY) -> DataFrame:
    """`_d`, `_t`, `_u`, `grams` and `heavy`: the names of each document's grams that stand in more
    than one run of the corpus, those over `heavy` runs apart."""
    rows = in_arrow(keyed(docs), in_parts(_gram_rows(length, gram, words)), "_d long, _t long, _u long, gram long, n int")
    # written, so that the join can be split at a gram of very many documents, or broadcast if small
    often = checkpointed(rows.groupBy("gram").agg(F.sum("n").alias("all")).where("all > 1").select("gram", (F.col("all") > heavy).alias("hot")))
    found = rows.select(*KEY, "gram").join(often, "gram")
    # sets, as copies without id share a key: a document's grams, however often its rows come
    return found.groupBy(*KEY).agg(
        F.collect_set(F.when(~F.col("hot"), F.col("gram"))).alias("grams"),
        F.collect_set(F.when(F.col("hot"), F.col("gram"))).alias("heavy"),
    )


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def member(names: np.ndarray, doc: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether names[i] is among values[at[doc[i]] : at[doc[i] + 1]] (64-bit names)."""
    if not len(values) or not len(names):
        return np.zeros(len(names), bool)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64)
    with np.errstate(over="ignore"):
        have = np.sort(mix(values.view(np.uint64)) + mix(owner + np.uint64(1)))
        ask = mix(names) + mix(doc.astype(np.uint64) + np.uint64(1))
    place = np.minimum(np.searchsorted(have, ask), len(have) - 1)
    return have[place] == ask
