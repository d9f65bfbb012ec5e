"""Suffix-array dedup of byte strings by distributed prefix doubling over sampled suffixes.

Sorting every suffix of a corpus moves many times its text.  Here only the suffixes at
minimiser positions are ranked (about one byte in eighty), which loses nothing: every
200-byte window holds such a position, chosen by its content, so two equal windows hold it
at the same offset.  Around each such position the ranked string doubles from round to round,
to 64 and 128 bytes at least, until it is the 200 of a window:

1. the 32-byte gram at the position; unique grams leave, they cannot be repeated;
2. the text of the whole run of windows around it; runs that stand elsewhere are past the
   threshold and done;
3. 128 windows, which share 73 bytes around the position, are a block, then 64 windows, which
   share 137, then 16, which share 185.  Spark sorts pairs (rank of the text all windows of the
   block share, rank of the text they cover together) with the position.  A position whose
   second rank is repeated is past the threshold and done, one whose first rank is unique
   leaves, the rest is ranked anew (with one of those that are done, to compare with);
4. single windows: the 200 bytes themselves.

A rank is a 128-bit name of the string, so ranking needs no count of smaller strings.  The
positions of one rank are never gathered: a sorted stream compares neighbours.  Grams with
more than `HEAVY` runs skip the ranks that would bring them to one task, and are dealt by
the name of the longer string.

Cases: null text is empty; texts under the length have no windows; a document may repeat
its own strings; rows that repeat a doc_id with its text are one document (a position is
not its own repetition) and each get the result; rows without doc_id are documents of
their own, so copies among them are repetitions; no tie is broken, as all equal strings go; a very
long text is ranked whole, in the memory of one task; an empty table gives an empty result;
other columns, whatever their names, are carried in `_rest`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, chunks, copies, covered, doc_key, from_rest, in_arrow, in_parts, ragged, rest_of, text_buffer
from .minimisers import list_values, member, minimiser_runs, repeated_grams, symbols_of

LENGTH, GRAM, BLOCK = 200, 32, 16
ROWS = "k1 long, k2 long, u1 long, u2 long, _d long, _t long, _u long, place int, low int, high int, state int"
ITEMS = "_d long, _t long, _u long, place int, low int, high int, state int"
#: States of a row: settled span [low, high); to be compared; compared without a prunable first rank.
DONE, OPEN, HOT = 0, 1, 2


def names128(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray | None = None) -> np.ndarray:
    """128-bit names of byte strings, two signed longs each."""
    view, name = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    if seeds is None:
        raw = b"".join([name(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    else:
        raw = b"".join([name(view[s:e], k) for s, e, k in zip(starts.tolist(), ends.tolist(), seeds.tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _rows(first, second, d, t, u, place, low, high, state) -> pa.RecordBatch:
    columns = [first[:, 0], first[:, 1], second[:, 0], second[:, 1], d, t, u, place.astype(np.int32), low.astype(np.int32), high.astype(np.int32), state.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in ROWS.split(", ")])


def _settled(d, t, u, low, high) -> pa.RecordBatch:
    """Rows of settled spans; their ranks only spread them over the tasks."""
    zero = np.zeros(len(low), np.int64)
    none = np.stack([zero, zero], 1)
    return _rows(np.stack([d * 2654435761, zero], 1), none, d, t, u, zero, low, high, zero + DONE)


def _keys(batch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in KEY)


def _run_rows(length: int, gram: int):
    """Ranks of whole runs.  Runs equal to another of the same batch are settled at once and
    one of them is sent on, so copies shrink before the shuffle."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            d, t, u = _keys(batch)
            light, hot = (list_values(batch.column(c)) for c in ("grams", "heavy"))
            found = []
            for a, b in chunks(offsets):
                part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                symbols, first, _, _ = symbols_of(part, off, False)
                doc, s1, s2, at, name = minimiser_runs(symbols, first, length, gram)
                is_hot = member(name, a + doc, *hot)
                use = np.flatnonzero(is_hot | member(name, a + doc, *light))
                if not len(use):
                    continue
                doc, s1, s2, at = doc[use], s1[use], s2[use], at[use]
                rank, base = names128(part, s1, s2 + length), off[doc]
                root = np.stack([name[use].view(np.int64), np.zeros(len(use), np.int64)], 1)
                found.append((np.where(is_hot[use][:, None], rank, root), rank, a + doc, at - base, s1 - base, s2 - base, np.where(is_hot[use], HOT, OPEN)))
            if not found:
                continue
            root, rank, doc, at, s1, s2, state = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((s1, u[doc], t[doc], d[doc], rank[:, 1], rank[:, 0]))
            root, rank, doc, at, s1, s2, state = (x[order] for x in (root, rank, doc, at, s1, s2, state))
            same = (rank[1:] == rank[:-1]).all(1)
            again = same & (d[doc[1:]] == d[doc[:-1]]) & (t[doc[1:]] == t[doc[:-1]]) & (u[doc[1:]] == u[doc[:-1]]) & (s1[1:] == s1[:-1])
            keep = np.r_[True, ~again]
            root, rank, doc, at, s1, s2, state = (x[keep] for x in (root, rank, doc, at, s1, s2, state))
            same = (rank[1:] == rank[:-1]).all(1)
            head, tail = np.r_[True, ~same], np.r_[~same, True]
            lone = head & tail
            # of equal runs two go on, so that each meets another wherever the rest may be
            send = lone | head | np.r_[False, head[:-1] & same]
            rest = ~send
            yield _rows(root[send], rank[send], d[doc[send]], t[doc[send]], u[doc[send]], at[send], s1[send], s2[send], state[send])
            if rest.any():
                shift = doc[rest] << 32
                lo, hi = covered(shift + s1[rest], shift + s2[rest] + length)
                own = lo >> 32
                yield _settled(d[own], t[own], u[own], lo & 0xFFFFFFFF, hi & 0xFFFFFFFF)

    return run


def _item_arrays(batch) -> tuple[np.ndarray, ...]:
    items = batch.column("items")
    if isinstance(items, pa.ChunkedArray):
        items = items.combine_chunks()
    at = items.offsets.to_numpy().astype(np.int64)
    flat = items.flatten()
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return (owner, *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)))


def _block_rows(length: int, gram: int, block: int):
    """Ranks of blocks of windows for the runs still open; block 1 means single windows."""
    reach = length - gram

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            d, t, u = _keys(batch)
            doc, place, low, high, state = _item_arrays(batch)
            size, base = offsets[doc + 1] - offsets[doc], offsets[doc]
            done = state == DONE
            if done.any():
                shift = doc[done] << 32
                lo, hi = covered(shift + low[done], shift + high[done])
                own = lo >> 32
                yield _settled(d[own], t[own], u[own], lo & 0xFFFFFFFF, hi & 0xFFFFFFFF)
            todo = ~done
            if not todo.any():
                continue
            doc, place, low, high, state, size, base = (x[todo] for x in (doc, place, low, high, state, size, base))
            # windows as distances from the gram back to the window's start
            near, far = (place - high) // block, (place - low) // block
            each = ragged(near, far - near + 1)
            pick = np.repeat(np.arange(len(doc)), far - near + 1)
            d1, d2 = each * block, np.minimum(each * block + block - 1, reach)
            at, begin, stop = place[pick], place[pick] - d2, place[pick] - d1 + length
            inside = (begin >= 0) & (stop <= size[pick])
            root = base[pick]
            if block == 1:
                second = first = names128(data, root + begin, root + stop)
            else:
                first = names128(data, root + at - d1, root + at - d2 + length, each)
                wide = names128(data, root + np.maximum(begin, 0), root + np.minimum(stop, size[pick]), each)
                # a block that would cross the document's end equals no other
                own = doc[pick]
                second = np.stack([np.where(inside, wide[:, 0], (d[own] * 2654435761 + t[own]) ^ u[own]), np.where(inside, wide[:, 1], ~(at * 65536 + each))], 1)
                hot = state[pick] == HOT
                first = np.where(hot[:, None], second, first)
            yield _rows(first, second, d[doc[pick]], t[doc[pick]], u[doc[pick]], at, np.maximum(begin, low[pick]) if block > 1 else begin, np.minimum(at - d1, high[pick]), state[pick])

    return run


def _compare(length: int, last: bool):
    """Streams sorted rows.  A row whose second rank stands at another position is settled.
    If its first rank also has other second ranks, one or two rows of each second rank stay
    open, settled or not, as the others may share a shorter string with them; the rest leave."""

    def judged(table: pa.Table, part: slice) -> pa.RecordBatch | None:
        a = {n: table.column(n).to_numpy() for n in table.schema.names}
        n = len(a["k1"])

        def equal(*names):
            out = np.ones(n - 1, bool)
            for x in names:
                out &= a[x][1:] == a[x][:-1]
            return out

        same_first = equal("k1", "k2")
        same_second = same_first & equal("u1", "u2")
        back, ahead = np.r_[False, same_second], np.r_[same_second, False]
        other = (np.r_[False, same_first] & ~back) | (np.r_[same_first, False] & ~ahead)
        done = a["state"] == DONE
        settled = done | back | ahead
        stays = ~done & (other | ((a["state"] == HOT) & ~back)) & (not last)
        chosen = np.zeros(n, bool)
        chosen[part] = True
        settled &= chosen
        stays &= chosen
        pick = np.r_[np.flatnonzero(settled), np.flatnonzero(stays)]
        if not len(pick):
            return None
        state = np.r_[np.full(settled.sum(), DONE), a["state"][stays]].astype(np.int32)
        high = a["high"][pick] + np.where(np.r_[~done[settled], np.zeros(stays.sum(), bool)], length, 0)
        columns = [*(a[c][pick] for c in KEY), a["place"][pick], a["low"][pick], high.astype(np.int32), state]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*KEY, "place", "low", "high", "state"])

    def unique(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return table
        same = np.ones(table.num_rows - 1, bool)
        for name in ("k1", "k2", "u1", "u2", *KEY, "place", "low", "high", "state"):
            x = table.column(name).to_numpy()
            same &= x[1:] == x[:-1]
        return table.filter(pa.array(np.r_[True, ~same])) if same.any() else table

    def run(batches):
        held: pa.Table | None = None  # the rows not judged yet, after one row of context
        context = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = unique(table if held is None else pa.concat_tables([held, table]).combine_chunks())
            if held.num_rows > context + 1:
                out = judged(held, slice(context, held.num_rows - 1))
                if out is not None:
                    yield out
                held, context = held.slice(held.num_rows - 2).combine_chunks(), 1
        if held is not None and held.num_rows > context:
            out = judged(held, slice(context, held.num_rows))
            if out is not None:
                yield out

    return run


def ranked(rows: DataFrame, length: int, last: bool = False) -> DataFrame:
    """One round: rows sorted by rank pair and position, then compared with their neighbours."""
    dealt = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "u1", "u2", *KEY, "place", "low", "high")
    return in_arrow(dealt, _compare(length, last), ITEMS)


def by_document(items: DataFrame) -> DataFrame:
    return items.groupBy(*KEY).agg(F.collect_list(F.struct("place", "low", "high", "state")).alias("items"))


def dealt(docs: DataFrame, least: int) -> DataFrame:
    """Documents by key, with the other columns in `_rest`; one exchange that all rounds read.

    Rows without id whose text is null or under `least` bytes, too short for any result, would be
    one key and one task, so their `_u` is the number of the partition they are read in.  That is
    the same whenever the partition is read again, so a repeated task deals them alike.
    """
    d, t, u = doc_key()
    text = F.col("text").cast("string")
    loose = F.col("doc_id").cast("long").isNull() & (F.coalesce(F.octet_length(text), F.lit(0)) < least)
    u = F.when(loose, F.xxhash64(F.spark_partition_id())).otherwise(u).alias("_u")
    t = F.when(loose, F.lit(0).cast("long")).otherwise(t).alias("_t")
    return docs.select(d, t, u, text.alias("text"), *rest_of(docs, "doc_id", "text")).repartition(*KEY)


def extended(base: DataFrame, more: str) -> T.StructType:
    """The fields of `base` but its text, and those of a DDL text."""
    return T.StructType([f for f in base.schema.fields if f.name != "text"] + T.StructType.fromDDL(more).fields)


def widths(length: int, gram: int, block: int) -> list[int]:
    """Windows of a block in each round: the most that share twice the gram, four times and so on, at
    last `block` windows and single ones.  Blocks are cut in halves, so a window is in one block
    of each round and its position never meets itself."""
    out, shared = [], 2 * gram
    while (most := length - shared + 1) >= 2 * block:
        out.append(block << ((most // block).bit_length() - 1))
        shared *= 2
    return [*out, block, 1]


def repeated_spans(docs: DataFrame, base: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """`_d`, `_t`, `_u`, `items`: byte spans (low, high) of each document that other positions repeat."""
    columns = base.columns  # all of them, so that every round reads the same exchange
    need = repeated_grams(docs, length, gram, words=False)
    rows = in_arrow(base.join(need, KEY).select(*columns, "grams", "heavy"), in_parts(_run_rows(length, gram)), ROWS)
    for width in widths(length, gram, block):
        items = by_document(ranked(rows, length))
        rows = in_arrow(base.join(items, KEY).select(*columns, "items"), in_parts(_block_rows(length, gram, width)), ROWS)
    return by_document(ranked(rows, length, last=True))


def _cut(length: int):
    """Removes settled spans; `_clean` only loses whole characters."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            texts = batch.column("text")
            doc, _, low, high, _ = _item_arrays(batch)
            copy = batch.column("_copies").to_numpy(zero_copy_only=False)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            out: list[list] = [[], [], [], [], [], []]
            for k in range(batch.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                s, e = covered(low[cut[k] : cut[k + 1]], high[cut[k] : cut[k + 1]])
                if copy[k] > 1 and len(raw) >= length:  # every string of it stands in its copies
                    s, e = np.array([0]), np.array([len(raw)])
                if len(s):
                    keep = np.ones(len(raw) + 1, np.int8)
                    keep[ragged(s, e - s)] = 0
                    kept = raw[keep[:-1] == 1].tobytes()
                    lead = (raw & 0xC0) != 0x80
                    # a character goes only if all its bytes go
                    gone = np.maximum.reduceat(keep[:-1], np.flatnonzero(lead)) == 0
                    clean = raw[~np.repeat(gone, np.diff(np.r_[np.flatnonzero(lead), len(raw)]))].tobytes().decode()
                else:
                    kept, clean = raw.tobytes(), texts[k].as_py()
                out[0].append(len(raw))
                out[1].append(len(raw) - len(kept))
                out[2].append(hashlib.sha256(kept).hexdigest())
                out[3].append(s.tolist())
                out[4].append(e.tolist())
                out[5].append(clean)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
            names = ("n_bytes", "n_removed", "kept_sha256", "starts", "ends", "_clean")
            more = {c: batch.column(c) for c in batch.schema.names if c not in ("text", "items", "_copies")}
            yield pa.RecordBatch.from_pydict(more | {n: pa.array(v, k) for n, v, k in zip(names, out, kinds, strict=True)})

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """`_d`, `_t`, `_u` (the document's key), `_rest` (other columns, if any), `n_bytes`, `n_removed`,
    `kept_sha256`, `starts` and `ends` (maximal removed byte runs) and `_clean` (text without
    the characters that lie in them wholly) of every document."""
    base = dealt(docs, length)
    spans = repeated_spans(docs, base, length, gram, block)
    found = base.join(spans, KEY, "left").select(*base.columns, "items", copies())
    return in_arrow(found, in_parts(_cut(length)), extended(base, "n_bytes long, n_removed long, kept_sha256 string, starts array<long>, ends array<long>, _clean string"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the same columns, repeated strings cut from `text` and `n_chars` counted anew."""
    out = dedup_substrings(docs, **options)
    changed = F.col("n_removed") > 0
    new = {"doc_id": F.when(F.col("_d") != F.lit(-(2**63)), F.col("_d")), "text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_clean").cast("long")).otherwise(F.col("_rest").getField("n_chars"))
    return out.select(*(new[c].alias(c) if c in new else from_rest(c) for c in docs.columns))
