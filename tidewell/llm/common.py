"""Shared pieces: document keys, checkpoints and vectorised text scanning.

Text scanning works on the Arrow string buffers themselves: a chunk of documents is one
`uint8` array plus offsets, words and byte strings are named by 64-bit polynomial
fingerprints taken from a running sum, so no Python loop runs over words or bytes.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.store import stored

NULL_ID = -(2**63)
KEY = ["_d", "_t", "_u"]
CHUNK_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


# ---------------------------------------------------------------- Spark side


def checkpointed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """`df` written to the shared folder as a table and read back; cuts the lineage.

    A table, not `DataFrame.checkpoint`: that keeps its plan's size estimate, which a join
    multiplies, so in a loop it grows to numbers of millions of digits and fills the driver.
    """
    return stored(df, folder)


def doc_key() -> list[Column]:
    """`_d`, `_t`, `_u`: what tells documents apart; `_t` and `_u` name the text by 128 bits.

    A null doc_id counts as the smallest id.  Rows with equal doc_id and equal text are one
    document (each row gets its result); rows with equal doc_id and other text are others.
    Rows without doc_id share a key if their text is equal, but are documents of their own:
    `copy_number` and `copies` tell an operator that compares documents how many there are.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_d"),
        F.xxhash64(F.col("text")).alias("_t"),
        F.xxhash64(F.lit(1), F.col("text")).alias("_u"),
    ]


def copies() -> Column:
    """How many documents without id have the row's text; 1 for rows with an id."""
    return F.when(F.col("_d") == NULL_ID, F.count(F.lit(1)).over(Window.partitionBy(*KEY))).otherwise(F.lit(1)).alias("_copies")


def copy_number() -> Column:
    """1, 2, ... for the documents without id that have the same text; 1 for rows with an id."""
    so_far = Window.partitionBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.col("_d") == NULL_ID, F.count(F.lit(1)).over(so_far)).otherwise(F.lit(1)).alias("_copies")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(columns: list[str], name: str) -> str:
    """`name`, or the first of `_name`, `__name`, ... that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def rest_of(docs: DataFrame, *own: str) -> list[Column]:
    """The columns other than `own` in one struct `_rest` (none if there are no others), where no
    name of theirs can meet one of an operator's."""
    rest = [c for c in docs.columns if c not in own]
    return [F.struct(*[F.col(quoted(c)).alias(c) for c in rest]).alias("_rest")] if rest else []


def from_rest(name: str) -> Column:
    return F.col("_rest").getField(name).alias(name)


def keyed(docs: DataFrame) -> DataFrame:
    """The key and `text` of every row, whatever other columns there are."""
    return docs.select(*doc_key(), F.col("text").cast("string").alias("text"))


def id_column() -> Column:
    return F.when(F.col("_d") != F.lit(NULL_ID), F.col("_d")).alias("doc_id")


# ---------------------------------------------------------------- fingerprints


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (multiply, xor-shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15 | 1


class _Cache(dict):
    """A dictionary that is empty again in the worker it is sent to."""

    def __reduce__(self):
        return (_Cache, ())


_POWERS: dict[str, np.ndarray] = _Cache()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
                line = np.full(size, base, np.uint64)
                line[0] = 1
                _POWERS[name] = np.cumprod(line, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def running(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums of 64-bit symbols; `span` turns two of them into a name."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * powers(len(symbols))[0][: len(symbols)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of symbols[start:end]; equal strings get equal names wherever they stand."""
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * powers(len(sums))[1][start]


def byte_symbols() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# ---------------------------------------------------------------- Arrow text


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(raw) else raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most `limit` bytes, or of one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def released() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside others."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def in_arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """`df.mapInArrow` with bounded memory: the session's Arrow batches hold at most `BATCH_BYTES`
    (or one row; a lower bound of the session stays), and a task gives back what it held."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int((conf.get(name) or "0").rstrip("bB") or 0) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from function(batches)
        finally:
            released()

    if all(re.fullmatch(r"\w+", c) for c in df.columns):
        return df.mapInArrow(run, schema)
    # Spark looks columns up by name there, and takes dots and quotes in it for syntax
    safe = {c: fresh(df.columns, f"_odd{k}") for k, c in enumerate(df.columns) if not re.fullmatch(r"\w+", c)}
    inner = T.StructType([T.StructField(safe.get(f.name, f.name), f.dataType) for f in schema.fields])
    return df.toDF(*(safe.get(c, c) for c in df.columns)).mapInArrow(run, inner).toDF(*schema.fieldNames())


def in_parts(function: Callable, limit: int | None = None) -> Callable:
    """A mapInArrow function that gets batches of at most `limit` bytes of `text` (or one row): a
    batch's bound counts all its columns, and its last row may be long."""

    def run(batches):
        def parts():
            for batch in batches:
                for a, b in chunks(text_buffer(batch.column("text"))[1], limit or BATCH_BYTES):
                    yield batch.slice(a, b - a)

        yield from function(parts())

    return run


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of the first word of each document.

    is_word: 256 flags.  A word never crosses a document's end.
    """
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        before |= edge[:-1]
        after |= edge[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = running(byte_symbols()[data])
    with np.errstate(over="ignore"):
        return mix(span(sums, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def not_space() -> np.ndarray:
    flags = np.ones(256, bool)
    flags[list(SPACE)] = False
    return flags


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values (len(x) - width + 1 of them)."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return (np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]) if rest else out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), for every i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal, sorted, disjoint runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[first], np.r_[ends[first[1:] - 1], ends[-1]]
