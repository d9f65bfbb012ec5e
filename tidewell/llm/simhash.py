"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, components of close pairs.

A fingerprint has 64 bits; bit b is set if it is set in the hashes (XXH64, seed 42) of more than
half of a text's shingles, repeats counted.  Fingerprints that differ in at most `distance` bits are
linked.  From here on equal fingerprints are one row, so copies cost nothing more.

Blocks.  The 64 bits are cut into `parts` parts.  Of two close fingerprints at most `distance`
parts differ, so they agree on all of some parts - distance parts, and each such choice is a block:
fingerprints meet by a join on it and their Hamming distance is verified in the join.  With five
parts and two bits that are ten blocks of 38 or 39 bits.  A block of more than `most` fingerprints
(near copies by the thousand differ in a few bits) is not joined pair by pair: its fingerprints
are written out with up to half the distance of their bits flipped, and close ones are those that
meet in a variant.  A variant is met by 65 fingerprints at most (distance 2), so the work stays in
proportion to the fingerprints; both ways are exact, and no pair is left out.

Distribution.  Texts are scanned where they are read; a document then is its id and eight bytes.
All groups are combined before they are shuffled; a block holds at most 2**26 fingerprints, a
variant 65.  A fingerprint that a third of all documents share (empty texts) is one row until the
last join, which Spark splits.  Intermediate tables are in the shared folder.

Cases.  A null, empty or blank text has no shingle: fingerprint zero, linked like any other.  A text
of fewer words than a shingle is one shingle.  Very long texts are hashed in slabs of shingles, in
the memory of one task; a lone very long word too.  A null doc_id is kept and gives no id to its
component: `component_id` is the smallest id of those that have one, null if none has.  Repeated
rows each get their row.  Ties (a bit set in exactly half of the hashes) are 0.  An empty table
gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources.store import scratch, stored

from .common import chunks, in_arrow, in_parts, lower_ascii, not_space, ragged, text_buffer, word_spans
from .components import components

SEED = 42
#: Shingles hashed at once.
SLAB = 1 << 16
PARTS = 5
#: Fingerprints of a block that are compared pair by pair.
MOST = 64
MAX_DISTANCE = 4


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space after each, and their new starts and ends."""
    sizes = ends - starts + 1
    new_ends = np.cumsum(sizes) - 1
    out = np.append(data, np.uint8(0x20))[ragged(starts, sizes)]
    out[new_ends] = 0x20
    return out, new_ends - sizes + 1, new_ends


def shingles(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all shingles, and how many each document has.  first: index of each
    document's first word, and the number of words at the end."""
    words = np.diff(first)
    counts = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    at = ragged(first[:-1], counts)
    last = np.minimum(at + n, np.repeat(first[1:], counts)) - 1
    return starts[at], ends[last], counts


def fingerprints(data: np.ndarray, offsets: np.ndarray, n: int = 3) -> np.ndarray:
    """The fingerprint of each document of a chunk of text, as a signed number."""
    import xxhash

    data = lower_ascii()[data]
    starts, ends, first = word_spans(data, offsets, not_space())
    text, starts, ends = joined_words(data, starts, ends)
    starts, ends, counts = shingles(starts, ends, first, n)
    owner = np.repeat(np.arange(len(counts)), counts)
    text, digest = text.tobytes(), xxhash.xxh64_intdigest
    ones = np.zeros((len(counts), 64), np.int64)
    for a in range(0, len(starts), SLAB):
        span = zip(starts[a : a + SLAB].tolist(), ends[a : a + SLAB].tolist(), strict=True)
        hashes = np.fromiter((digest(text[i:j], SEED) for i, j in span), "<u8", len(starts[a : a + SLAB]))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[a : a + SLAB]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ones[own[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    set_ = 2 * ones > counts[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<i8").ravel().astype(np.int64)


def fingerprinted(docs: DataFrame, n: int = 3) -> DataFrame:
    """`doc_id` and `fp`, the fingerprint as a signed long, of every row of `docs`."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            found = [fingerprints(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n) for a, b in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = texts.select("doc_id", F.lit(0).cast("long").alias("fp")).schema
    return in_arrow(texts, in_parts(run), schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(distance: int, parts: int) -> list[int]:
    """Masks of the bits that a pair must agree on, one of which every close pair does."""
    edges = [64 * k // parts for k in range(parts + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(part, parts - distance)]


def close(distance: int):
    return (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def met_in_variants(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all close pairs of distinct `fp`, by variants of half the distance."""
    radius = -(-distance // 2)
    flips = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    near = prints.select("fp", F.explode(F.array(*[F.lit(signed(x)) for x in flips])).alias("flip"))
    near = near.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    if distance % 2 == 0:  # all that meet in a variant are close to each other: the least stands for them
        least = near.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
        return least.where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return near.withColumnRenamed("fp", "a").join(near.withColumnRenamed("fp", "b"), "variant").where(close(distance)).select("a", "b")


def near_links(prints: DataFrame, distance: int = 2, parts: int = PARTS, most: int = MOST, folder: str | None = None) -> DataFrame:
    """Links (a, b), a < b, that connect all pairs of distinct `fp` that differ in at most `distance` bits."""
    if not 0 <= distance <= MAX_DISTANCE or not distance < parts <= 64:
        raise ValueError("a distance of 0 to 4, and more parts than that")
    masks = [F.struct(F.lit(k).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(blocks(distance, parts))]
    keys = prints.select("fp", F.inline(F.array(*masks)))
    sizes = keys.groupBy("block", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(keys.join(sizes, ["block", "key"]), folder)
    few = shared.where(F.col("size") <= most).drop("size")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["block", "key"]).where(close(distance)).select("a", "b")
    many = stored(shared.where(F.col("size") > most).select("fp").distinct(), folder)
    return pairs.union(met_in_variants(many, distance)).distinct()


def simhash_components(docs: DataFrame, n: int = 3, distance: int = 2, parts: int = PARTS, most: int = MOST) -> DataFrame:
    """`doc_id`, `fp` and `component_id`, the smallest doc_id that links reach, of every row of `docs`."""
    spark = docs.sparkSession
    folder = scratch(spark, "simhash")
    own = stored(fingerprinted(docs, n), folder)
    prints = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), folder)
    links = stored(near_links(prints.select("fp"), distance, parts, most, folder), folder)
    roots = prints.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = stored(roots, folder)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stored(roots.join(least, "root").select("fp", "component_id"), folder)
    return own.join(by_print, "fp").select("doc_id", "fp", "component_id")


def component_ids(docs: DataFrame, **options) -> DataFrame:
    """As `simhash_components`, with the fingerprint as 16 hexadecimal digits."""
    found = simhash_components(docs, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
