"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of whole documents inside a task.  Its words become symbols: words that
no test phrase holds are one separator, since no phrase can cross them.  Suffixes of that
sequence are sorted, the Burrows-Wheeler transform is kept in a wavelet matrix, and every
test phrase (ten consecutive item words; an item of fewer words is one phrase) is looked up
by backward search.  Occurrences are located by walking to the nearest sampled suffix, and
the word spans found are merged.  Nothing is shuffled; a document never leaves its task.

Phrases travel to the tasks by broadcast only while the benchmark's text is at most
`max_benchmark_bytes`; a larger benchmark is cut into slices below that bound.  Each slice reads
the texts and writes the spans it found alone, by the text's 128-bit name; the spans of all
slices are put together, the slices' tables go, and one join brings them back to the documents.
The corpus itself is never written; where the spans are too many to be broadcast it passes one
exchange, whatever the number of slices.

Cases: null or empty texts have no words and no hits; items without words match nothing;
repeated items count once by item_id; a null item_id is named `null`; an empty benchmark
marks nothing; an empty table gives an empty result; repeated rows each get their result; ties: of
equal phrases of several items every item is named; a very long text is searched whole, as a
shard of its own; other columns are carried, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.store import drop, scratch

from .common import checkpointed, chunks, covered, fresh, from_rest, in_arrow, in_parts, lower_ascii, ragged, released, rest_of, text_buffer, word_names, word_spans

WINDOW = 10
SHARD_BYTES = 1 << 20
SAMPLE_EVERY = 8
MAX_BENCHMARK_BYTES = 32 << 20


def word_bytes() -> np.ndarray:
    """Flags of bytes in words: digits, a-z after lower-casing, and all beyond ASCII."""
    flags = np.zeros(256, bool)
    flags[0x30:0x3A] = flags[0x61:0x7B] = flags[0x80:] = True
    return flags


def phrases(items: pa.Table, window: int = WINDOW) -> dict:
    """The distinct phrases of rows (item id, text, both strings): where each begins in the items'
    words and its length, the vocabulary's names, and who holds each."""
    data, offsets = text_buffer(items.column(1))
    names, words, flags, table = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], word_bytes(), lower_ascii()
    for a, b in chunks(offsets):
        part = table[data[offsets[a] : offsets[b]]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a], flags)
        names.append(word_names(part, starts, ends))
        words.append(np.diff(first))
    names = np.concatenate(names)
    vocab = np.unique(names)
    tokens, size = (np.searchsorted(vocab, names) + 1).astype(np.int32), np.concatenate(words)
    del names, data
    called = ["null" if x is None else x for x in items.column(0).to_pylist()]
    labels = sorted(set(called))
    number = {x: k for k, x in enumerate(labels)}
    count = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
    start = ragged(np.cumsum(size) - size, count).astype(np.int32)
    length = np.repeat(np.minimum(size, window), count).astype(np.int32)
    item = np.repeat(np.array([number[x] for x in called], np.int32), count)
    last = len(tokens) - 1
    name = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            name *= np.uint64(0x9FB21C651E98DF25)
            name ^= np.where(length > k, tokens[np.minimum(start + k, last)], 0).astype(np.uint64)
            name ^= name >> np.uint64(29)
    # by name, then by item: of each phrase and item one row stays
    order = np.argsort(name, kind="stable")
    start, length, item, name = start[order], length[order], item[order], name[order]
    del order
    head = changes(tokens, start, length, window)
    if (head[1:] & (name[1:] == name[:-1])).any():  # different phrases of one name: sort by the words themselves
        order = np.lexsort([item, *(np.where(length > k, tokens[np.minimum(start + k, last)], 0) for k in range(window)), length])
        start, length, item = start[order], length[order], item[order]
        head = changes(tokens, start, length, window)
    del name
    phrase = (np.cumsum(head) - 1).astype(np.int32)
    own = np.r_[True, (phrase[1:] != phrase[:-1]) | (item[1:] != item[:-1])] if len(phrase) else head
    return {
        "vocab": vocab,
        "tokens": tokens,
        "start": start[head].astype(np.int64),
        "length": length[head].astype(np.int64),
        "holder_at": np.r_[0, np.cumsum(np.bincount(phrase[own], minlength=int(head.sum())))],
        "holders": item[own].astype(np.int64),
        "labels": labels,
    }


def changes(tokens: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> np.ndarray:
    """Which phrases differ from the one before."""
    if not len(start):
        return np.zeros(0, bool)
    other = length[1:] != length[:-1]
    for k in range(window):
        word = tokens[np.minimum(start + k, len(tokens) - 1)]
        other |= (word[1:] != word[:-1]) & (length[1:] > k)
    return np.r_[True, other]


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector with running counts for each bit."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before at[i]."""
        low, high = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """FM-index of a sequence of symbols; 0 ends every run and is never searched for."""

    def __init__(self, symbols: np.ndarray, sample_every: int = SAMPLE_EVERY) -> None:
        n, ends = len(symbols), np.flatnonzero(symbols == 0)
        # every separator is a symbol of its own, so ranks get unique within the longest run
        rank = symbols + len(ends)
        rank[ends] = np.arange(len(ends))
        offset = 1
        while True:
            beyond = np.full(n, -1, np.int64)
            if offset < n:
                beyond[:-offset] = rank[offset:]
            order = np.lexsort((beyond, rank))
            new = np.empty(n, np.int64)
            a, b = rank[order], beyond[order]
            new[order] = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            rank = new
            if n == 0 or new[order[-1]] == n - 1:
                break
            offset *= 2
        self.suffix = order
        self.bwt = symbols[order - 1]
        top = int(symbols.max(initial=0))
        counts = np.bincount(symbols, minlength=top + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletMatrix(self.bwt, top)
        # suffixes at every eighth position and at the start of each run are sampled
        taken = (order % sample_every == 0) | (self.bwt == 0)
        self.taken = taken
        self.sampled = order[taken]
        self.sample_rank = np.concatenate([[0], np.cumsum(taken)])
        del self.suffix

    def search(self, tokens: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of the phrases tokens[start : start + length], found back to front."""
        low, high = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        top = len(self.before) - 2
        # the rows of the last symbol are known without a rank
        last = tokens[start + length - 1]
        on = np.flatnonzero(last < top)
        low[on], high[on] = self.before[last[on]], self.before[last[on] + 1]
        on = on[high[on] > low[on]]
        for step in range(1, int(length.max(initial=0))):
            on = on[step < length[on]]
            if not len(on):
                break
            s = tokens[start[on] + length[on] - 1 - step].astype(np.int64)
            known = s < top
            s = np.where(known, s, 0)
            low[on] = np.where(known, self.before[s] + self.tree.rank(s, low[on]), 0)
            high[on] = np.where(known, self.before[s] + self.tree.rank(s, high[on]), 0)
            on = on[high[on] > low[on]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows, by steps to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.taken[rows])
        while len(walking):
            symbol = self.bwt[rows[walking]]
            rows[walking] = self.before[symbol] + self.tree.rank(symbol, rows[walking])
            steps[walking] += 1
            walking = walking[~self.taken[rows[walking]]]
        return self.sampled[self.sample_rank[rows]] + steps


def occurrences(names: np.ndarray, first: np.ndarray, found: dict) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, word index) of every occurrence in the shard.  first: word index by document."""
    none = np.zeros(0, np.int64)
    if not len(names) or not len(found["start"]):
        return none, none
    vocab = found["vocab"]
    at = np.minimum(np.searchsorted(vocab, names), len(vocab) - 1)
    symbol = np.where(vocab[at] == names, at + 1, 0)
    inside = symbol > 0
    begins = np.zeros(len(names) + 1, bool)
    begins[first] = True
    run = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | begins[1 : len(names)]])
    stop = np.flatnonzero(inside & np.r_[~inside[1:] | begins[1 : len(names)], True]) + 1
    long = stop - run >= found["length"].min()
    run, stop = run[long], stop[long]
    if not len(run):
        return none, none
    # each run followed by one separator
    place = ragged(run, stop - run + 1)
    last = np.cumsum(stop - run + 1) - 1
    symbols = symbol[np.minimum(place, len(symbol) - 1)]
    symbols[last] = 0
    index = FMIndex(symbols)
    low, high = index.search(found["tokens"], found["start"], found["length"])
    hit = np.flatnonzero(high > low)
    rows = ragged(low[hit], high[hit] - low[hit])
    return np.repeat(hit, high[hit] - low[hit]), place[index.locate(rows)]


def _searched(found_b, shard_bytes: int):
    """A mapInArrow function: adds one slice's word spans and items to each document."""

    def run(batches):
        found, table, flags = found_b.value, lower_ascii(), word_bytes()
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            data = table[data] if len(data) else data
            out: list[list] = [[], [], []]
            for a, b in chunks(offsets, shard_bytes):
                off = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                starts, ends, first = word_spans(part, off, flags)
                phrase, word = occurrences(word_names(part, starts, ends), first, found)
                doc = np.searchsorted(first, word, "right") - 1
                # documents without words share a start with the next: the last one holds the word
                s, e = starts[word], ends[word + found["length"][phrase] - 1] if len(word) else word
                count = found["holder_at"][phrase + 1] - found["holder_at"][phrase]
                owner = np.repeat(doc, count)
                item = found["holders"][ragged(found["holder_at"][phrase], count)] if len(phrase) else phrase
                pair = np.unique(np.stack([owner, item], 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
                order = np.argsort(doc, kind="stable")
                cut, cut_i = np.searchsorted(doc[order], np.arange(b - a + 1)), np.searchsorted(pair[:, 0], np.arange(b - a + 1))
                for k in range(b - a):
                    own = order[cut[k] : cut[k + 1]]
                    x, y = covered(s[own] - off[k], e[own] - off[k])
                    out[0].append(x.tolist())
                    out[1].append(y.tolist())
                    out[2].append([found["labels"][j] for j in pair[cut_i[k] : cut_i[k + 1], 1]])
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns |= {c: pa.array(v, k) for c, v, k in zip(("_starts", "_ends", "_items"), out, kinds, strict=True)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _hit_texts(batches):
    """Of what a slice found: the names of the texts that are hit, their spans and items."""
    for batch in batches:
        hit = pa.compute.greater(pa.compute.list_value_length(batch.column("_items")), 0)
        yield batch.filter(hit).select(FOUND)


def _finished(batches):
    """Counts words and merges spans; `_clean` is the text without its hit spans."""
    table, flags = lower_ascii(), word_bytes()
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        texts = batch.column("text").to_pylist()
        words, hits, clean = [], [], []
        begin, stop = [], []
        for x, y in zip(batch.column("_starts").to_pylist(), batch.column("_ends").to_pylist(), strict=True):
            x, y = covered(np.array(x or [], np.int64), np.array(y or [], np.int64))  # those of several slices may overlap
            begin.append(x.tolist())
            stop.append(y.tolist())
        for a, b in chunks(offsets):
            off = offsets[a : b + 1] - offsets[a]
            starts, ends, first = word_spans(table[data[offsets[a] : offsets[b]]], off, flags)
            words.extend((first[1:] - first[:-1]).tolist())
            for k in range(a, b):
                if not begin[k]:
                    hits.append(0)
                    clean.append(texts[k])
                    continue
                own = starts[first[k - a] : first[k - a + 1]] - off[k - a]
                hits.append(int(sum(np.searchsorted(own, stop[k]) - np.searchsorted(own, begin[k]))))
                raw, kept, at = data[offsets[k] : offsets[k + 1]].tobytes(), [], 0
                for s, e in zip(begin[k], stop[k], strict=True):
                    kept.append(raw[at:s])
                    at = e
                clean.append(b"".join([*kept, raw[at:]]).decode())
        items = [sorted(set(x or [])) for x in batch.column("_items").to_pylist()]
        columns = {c: batch.column(c) for c in batch.schema.names}
        columns |= {
            "_starts": pa.array(begin, pa.list_(pa.int64())),
            "_ends": pa.array(stop, pa.list_(pa.int64())),
            "_items": pa.array(items, pa.list_(pa.string())),
            "_n_words": pa.array(words, pa.int64()),
            "_n_hit": pa.array(hits, pa.int64()),
            "_clean": pa.array(clean, pa.string()),
            "_items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        }
        yield pa.RecordBatch.from_pydict(columns)


SPANS = "_starts array<long>, _ends array<long>, _items array<string>"
COUNTS = "_n_words long, _n_hit long, _clean string, _items_sha256 string"
FOUND = ["_t", "_u", "_starts", "_ends", "_items"]
NEW = ("_starts", "_ends", "_items", "_n_words", "_n_hit", "_clean", "_items_sha256")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_benchmark_bytes: int = MAX_BENCHMARK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`text`, `_rest` (the other columns of `docs`, if any) and the columns NEW of every document."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-total // max_benchmark_bytes))
    df = docs.select(F.col("text").cast("string").alias("text"), *rest_of(docs, "text"))
    counted = T.StructType.fromDDL(COUNTS).fields

    def held(part: DataFrame):
        made = spark.sparkContext.broadcast(phrases(part.toArrow(), window))
        released()
        return made

    if slices == 1:
        search = _searched(held(items), shard_bytes)
        # the search and the merging share one Python worker
        return in_arrow(df, in_parts(lambda batches: _finished(search(batches))), T.StructType(df.schema.fields + T.StructType.fromDDL(SPANS).fields + counted))
    name = [F.xxhash64("text").alias("_t"), F.xxhash64(F.lit(1), F.col("text")).alias("_u")]
    own = scratch(spark, "slices")
    texts, parts = df.where("text is not null").select(*name, "text"), []
    for k in range(slices):
        made = held(items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k))
        search = _searched(made, shard_bytes)
        hit = in_arrow(texts, in_parts(lambda batches, search=search: _hit_texts(search(batches))), f"_t long, _u long, {SPANS}")
        # copies of a text are hit alike
        parts.append(checkpointed(hit.groupBy("_t", "_u").agg(F.first(F.struct(*FOUND[2:])).alias("f")), own))
        made.destroy()
    lists = reduce(DataFrame.union, parts).groupBy("_t", "_u").agg(F.collect_list("f").alias("f"))
    found = checkpointed(lists.select("_t", "_u", *[F.flatten(F.col("f").getField(c)).alias(c) for c in FOUND[2:]]))
    drop(spark, own)
    met = df.select("*", *name).join(found, ["_t", "_u"], "left").select(*df.columns, *FOUND[2:])
    return in_arrow(met, in_parts(_finished), T.StructType(met.schema.fields + counted))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All columns of `docs` (it needs `text`) and, for each document: `_starts`, `_ends`
    (byte spans to remove, merged and sorted), `_items` (ids of the items found), `_n_words`,
    `_n_hit` (words inside spans), `_items_sha256`, `_clean` (text without the spans).  Where
    `docs` has a column of such a name, the new one gets more underscores in front."""
    found = hits(docs, benchmark, **options)
    return found.select(*(F.col("text") if c == "text" else from_rest(c) for c in docs.columns), *(F.col(c).alias(fresh(docs.columns, c)) for c in NEW))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` with the same columns, the hit spans cut from `text` and `n_chars` counted anew."""
    out = hits(docs, benchmark, **options)
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_n_hit") > 0, F.length("_clean").cast("long")).otherwise(F.col("_rest").getField("n_chars"))
    return out.select(*(new[c].alias(c) if c in new else from_rest(c) for c in docs.columns))
