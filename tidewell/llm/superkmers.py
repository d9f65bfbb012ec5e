"""Substring dedup on words by super-k-mer partitioning.

A window is 20 consecutive words.  Windows that share a minimiser (the smallest-named
4-word gram in them) and follow each other travel as one packed string, their super-k-mer,
to the bucket of that minimiser.  A bucket's task sorts its super-k-mers by content and
position: equal ones fall together, so all but the first lose all their windows; the
windows of those that differ are sorted in turn, and every window but the first of its
content is marked.  Only minimisers that the corpus holds more than once travel at all.

A minimiser with more than `HEAVY` runs would make a hot bucket, so its windows are dealt
one by one, each to the bucket of its own content.  A sorted stream compares neighbours
there, and no group is gathered.  Copies within one batch are sent once.

Cases: null and empty texts and texts of fewer words keep everything; a window may repeat
in its own document; rows that repeat a doc_id with its text are one document and each get
the result; rows without doc_id are documents of their own and come before all others; an empty table gives an empty result; a very
long text is cut to packets in the memory of one task; other columns, whatever their names, are
carried in `_rest`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, chunks, copy_number, covered, in_arrow, in_parts, not_space, ragged, text_buffer, word_spans
from .minimisers import list_values, member, minimiser_runs, repeated_grams, symbols_of
from .suffix_dedup import _keys, dealt, extended, names128

WINDOW, GRAM = 20, 4
#: b1, b2: the bucket.  packed: the words of windows first..last, null if the bucket is one window's
#: or the row is only a mark.  first..last: window numbers (by first word).
ROWS = "b1 long, b2 long, _d long, _t long, _u long, first int, last int, packed string, mark boolean"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _packets(window: int, gram: int):
    """Super-k-mers of repeated minimisers, copies within the batch marked at once."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            d, t, u = _keys(batch)
            light, hot = (list_values(batch.column(c)) for c in ("grams", "heavy"))
            found, packed = [], []
            for a, b in chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                symbols, begin, starts, ends = symbols_of(part, off, True)
                doc, s1, s2, _, name = minimiser_runs(symbols, begin, window, gram)
                is_hot = member(name, a + doc, *hot)
                use = np.flatnonzero(is_hot | member(name, a + doc, *light))
                if not len(use):
                    continue
                doc, s1, s2, name, is_hot = doc[use], s1[use], s2[use], name[use], is_hot[use]
                # a run of a hot minimiser becomes as many runs of one window
                width = np.where(is_hot, s2 - s1 + 1, 1)
                pick = np.repeat(np.arange(len(doc)), width)
                low = ragged(s1, width)
                high = np.where(is_hot[pick], low, s2[pick])
                # spaces differ between equal word sequences: names come from the words, one space between
                flat, at = joined(part, starts, ends, low, high + window)
                rank = names128(flat, at[:-1], at[1:])
                root = np.stack([name[pick].view(np.int64), np.zeros(len(pick), np.int64)], 1)
                first = begin[doc[pick]]
                found.append((np.where(is_hot[pick][:, None], rank, root), rank, a + doc[pick], low - first, high - first, is_hot[pick]))
                packed.append((flat, at))
            if not found:
                continue
            root, rank, doc, low, high, is_hot = (np.concatenate(x) for x in zip(*found, strict=True))
            source = np.concatenate([np.full(len(f[2]), k) for k, f in enumerate(found)])
            within = np.concatenate([np.arange(len(f[2])) for f in found])
            order = np.lexsort((low, u[doc], t[doc], d[doc], rank[:, 1], rank[:, 0]))
            root, rank, doc, low, high, is_hot, source, within = (x[order] for x in (root, rank, doc, low, high, is_hot, source, within))
            same = np.r_[False, (rank[1:] == rank[:-1]).all(1)]
            here = np.r_[False, (d[doc[1:]] == d[doc[:-1]]) & (t[doc[1:]] == t[doc[:-1]]) & (u[doc[1:]] == u[doc[:-1]]) & (low[1:] == low[:-1])] & same
            # a repeated row's windows are its own: marked only if another position comes before
            leader = np.maximum.accumulate(np.where(~same, np.arange(len(same)), 0))
            mark = same & ~((d[doc] == d[doc[leader]]) & (t[doc] == t[doc[leader]]) & (u[doc] == u[doc[leader]]) & (low == low[leader]))
            # marked windows only pass through: spans of a document that touch become one
            k = np.flatnonzero(mark & ~here)
            shift = doc[k] << 32
            low_m, high_m = covered(shift + low[k], shift + high[k] + 1)
            own = low_m >> 32
            keep = np.flatnonzero(~here & ~mark)
            strings = [None if h else packed[s][0][packed[s][1][w] : packed[s][1][w + 1]].tobytes().decode() for h, s, w in zip(is_hot[keep].tolist(), source[keep].tolist(), within[keep].tolist(), strict=True)]
            doc = np.r_[doc[keep], own]
            columns = (
                np.r_[root[keep, 0], d[own] * 2654435761],
                np.r_[root[keep, 1], np.zeros(len(own), np.int64)],
                d[doc],
                t[doc],
                u[doc],
                np.r_[low[keep], low_m & 0xFFFFFFFF].astype(np.int32),
                np.r_[high[keep], (high_m & 0xFFFFFFFF) - 1].astype(np.int32),
            )
            is_mark = np.r_[np.zeros(len(keep), bool), np.ones(len(own), bool)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(strings + [None] * len(own), pa.string()), pa.array(is_mark)], names=NAMES)

    return run


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, each followed by one space, and where each of them stops."""
    size = ends - starts + 1
    flat = data[np.minimum(ragged(starts, size), len(data) - 1)]
    stop = np.cumsum(size)
    flat[stop - 1] = 0x20
    return flat, stop


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words low[i]..high[i] - 1, each followed by a space, for every i; one buffer with offsets."""
    word = ragged(low, high - low)
    flat, stop = spaced(data, starts[word], ends[word])
    return flat, np.r_[0, stop[np.cumsum(high - low) - 1]] if len(low) else np.zeros(1, np.int64)


def _bucket(window: int):
    """Sorts each bucket's windows; yields the windows that also start earlier."""

    def marks(rows: list[tuple]) -> tuple[list, ...]:
        """rows: (d, t, u, first, last, packed) of one bucket, sorted by content; returns spans to remove."""
        out: tuple[list, ...] = ([], [], [], [], [])

        def add(*span):
            for x, y in zip(out, span, strict=True):
                x.append(y)

        distinct, lead = [], None
        for r in rows:
            if lead is not None and r[5] == lead[5]:
                if r[:4] != lead[:4]:
                    add(*r[:5])
            else:
                lead = r
                distinct.append(r)
        # windows of one super-k-mer differ: each holds the minimiser at another offset
        if len(distinct) > 1:
            seen: dict[str, tuple] = {}
            # positions in order: the first window of each content stays
            for d, t, u, first, last, packed in sorted(distinct, key=lambda r: r[:4]):
                words = packed.split(" ")
                for p in range(last - first + 1):
                    at = (d, t, u, first + p)
                    if seen.setdefault(" ".join(words[p : p + window]), at) != at:
                        add(d, t, u, first + p, first + p)
        return out

    def run(batches):
        held: list[tuple] = []
        bucket: tuple | None = None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(NAMES))]
            ready: tuple[list, ...] = ([], [], [], [], [])

            def take(found):
                for x, y in zip(ready, found, strict=True):  # noqa: B023
                    x.extend(y)

            for b1, b2, d, t, u, first, last, packed, mark in zip(*columns, strict=True):
                if mark:
                    take(([d], [t], [u], [first], [last]))
                    continue
                if (b1, b2) != bucket:
                    if held:
                        take(marks(held))
                    bucket, held = (b1, b2), []
                if packed is None and held:  # a bucket of one window: only its first row is kept
                    if held[0][:4] != (d, t, u, first):
                        take(([d], [t], [u], [first], [last]))
                    continue
                held.append((d, t, u, first, last, packed))
            if ready[0]:
                yield result(ready)
        if held:
            out = marks(held)
            if out[0]:
                yield result(out)

    def result(found):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=[*KEY, "first", "last"])

    return run


def _kept(window: int):
    """Removes the words of marked windows."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            spans = batch.column("spans")
            if isinstance(spans, pa.ChunkedArray):
                spans = spans.combine_chunks()
            at = spans.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            flat = spans.flatten()
            copy = batch.column("_copies").to_numpy(zero_copy_only=False)
            first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            out: list[list] = [[], [], [], [], [], []]
            for a, b in chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, begin = word_spans(part, offsets[a : b + 1] - offsets[a], not_space())
                for k in range(a, b):
                    s, e = starts[begin[k - a] : begin[k - a + 1]], ends[begin[k - a] : begin[k - a + 1]]
                    x, y = covered(first[at[k] : at[k + 1]], last[at[k] : at[k + 1]] + window)
                    if copy[k] > 1 and len(s) >= window:  # all its windows stand in the first copy
                        x, y = np.array([0]), np.array([len(s)])
                    keep = np.ones(len(s), bool)
                    keep[ragged(x, y - x)] = False
                    kept = spaced(part, s[keep], e[keep])[0].tobytes()[:-1]
                    for column, value in zip(out, (len(s), int(len(s) - keep.sum()), hashlib.sha256(kept).hexdigest(), x.tolist(), y.tolist(), kept.decode()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            names = ("n_words", "n_removed", "kept_sha256", "starts", "ends", "_kept")
            more = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "spans", "_copies")}
            yield pa.RecordBatch.from_pydict(more | {n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=True)})

    return run


def dedup_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`_d`, `_t`, `_u` (the document's key), `_rest` (other columns, if any), `n_words`, `n_removed`, `kept_sha256`,
    `starts` and `ends` (removed word runs) and `_kept` (kept words, one space between)."""
    base = dealt(docs, 2 * window - 1)  # so many bytes have `window` words at least
    need = repeated_grams(docs, window, gram, words=True)
    rows = in_arrow(base.join(need, KEY).select(*base.columns, "grams", "heavy"), in_parts(_packets(window, gram)), ROWS)
    buckets = rows.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "mark", "packed", *KEY, "first")
    marked = in_arrow(buckets, _bucket(window), "_d long, _t long, _u long, first int, last int")
    spans = marked.groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    found = base.join(spans, KEY, "left").select(*base.columns, "spans", copy_number())
    return in_arrow(found, in_parts(_kept(window)), extended(base, "n_words long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>, _kept string"))
