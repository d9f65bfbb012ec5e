"""N-gram Jaccard join with signature trees.

Documents with the same shingle set are one class from the start; classes are joined.

Bringing candidates together, exactly: two sets with similarity t or more differ in few
shingles, at most H for a range of sizes.  A set's shingles are dealt to m > H parts by
their hash, so such sets agree on a whole part that is not empty, and the fingerprint of
each part is a key (a set writes keys for one or two ranges of sizes).  Of its parts a set
writes as many as shingles may differ and one more, those of most shingles first: of what two
similar sets share the first in that order is among them in both, and a part of one shingle,
which sets share by chance, is hardly ever written.  Shingles that a
sample shows in many sets (`max_heavy` at most) are left out of the keys, since both sets
leave out the same; a set that then has too few parts left also writes keys of all its
shingles, and if its parts are too few even so, keys of the empty parts as well.  Sets that
share a key are linked to the first of them; the components of those links are candidates.

Joining: the sets of a candidate component meet in one task.  A signature tree holds, for
every node, the OR of its sets' token bitmaps and its range of sizes.  Two nodes are
traversed together and dropped as soon as the largest possible overlap is too small, or when
all their sets are already in one component; what is left at the leaves is counted exactly.
A node is traversed with itself before its pairs, so a group of near copies becomes one
component from the leaves up, and all but one pair of its nodes are dropped unseen.

A component of more than `chunk_tokens` shingles is cut by a hash into chunks, so no task
gathers it whole.  First each chunk meets itself and the first chunk; that alone joins a group
of near copies.  The sets that are then outside the largest component found, if any, are cut
into chunks in turn, and each of these meets every chunk of the whole.  Links of all tasks
are closed to components.

Cases: a text of fewer words than a shingle is one shingle, the whole sequence; null and
empty texts have none and link with nothing; repeated rows are one document; equal texts are
linked; a null doc_id never names a component that has an id; an empty table gives an empty
result; a similarity of exactly the threshold links; a very long text's set is held whole by a
task; other columns are carried, whatever their names.  Sets and shingles are named by 64-bit
fingerprints.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, checkpointed, chunks, doc_key, in_arrow, in_parts, keyed, lower_ascii, mix, not_space, quoted, ragged, released, running, span, text_buffer, word_names, word_spans
from .components import Forest, components
from .suffix_dedup import _keys

SAMPLE, HEAVY_IN_SAMPLE, MAX_HEAVY = 32, 2, 1 << 20
CHUNK_TOKENS = 2_000_000
LEAF, FANOUT = 16, 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle names of each document, flat, and their offsets."""
    starts, ends, first = word_spans(data, offsets, not_space())
    sums = running(word_names(data, starts, ends))
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    at = ragged(first[:-1], count)
    size = np.repeat(np.minimum(words, n), count)
    with np.errstate(over="ignore"):
        names = mix(span(sums, at, at + size) + size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((names, doc))
    doc, names = doc[order], names[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (names[1:] != names[:-1])] if len(doc) else np.zeros(0, bool)
    return names[fresh], np.searchsorted(doc[fresh], np.arange(len(count) + 1))


def set_names(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One name for each set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0x8EBC6AF09C88C6E3)), dtype=np.uint64)])
        return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x589965CC75374CC3))


def size_ranges(num: int, den: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, H, parts) of each range of sizes.

    A pair belongs to the range of its smaller set.  With the smaller at most u and similarity
    num/den or more the sets differ in at most u * (den - num) / num shingles.
    """
    low, lows, most, parts = 1, [], [], []
    while low <= longest:
        high = max(low + 1, -(-low * den * den // (num * num)))
        h = (high - 1) * (den - num) // num
        m = h + 1
        while h and m < 2 * h + 4 and m * (1 - math.exp(-low / m)) < h + 1 + math.sqrt(m * math.exp(-low / m)):
            m += max(1, m // 50)
        m = max(m, 7 * (h + 1) // 5)  # so that the parts of one shingle, and none, are the rest
        lows.append(low)
        most.append(h)
        parts.append(m)
        low = high
    return np.array(lows), np.array(most), np.array(parts)


def part_keys(flat: np.ndarray, at: np.ndarray, use: np.ndarray, heavy: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set number) rows for the sets `use`.  heavy: flags of `flat`."""
    size = np.diff(at)[use]
    lows, most, parts = size_ranges(num, den, int(size.max(initial=1)))
    own = np.searchsorted(lows, size, "right") - 1
    below = np.searchsorted(lows, -(-num * size // den), "right") - 1
    second = below != own
    which = np.r_[np.arange(len(use)), np.flatnonzero(second)]
    scheme = np.r_[own, below[second]]
    m, h = parts[scheme], np.minimum(most[scheme], size[which] * (den - num) // num)
    base = np.concatenate([[0], np.cumsum(m)])
    out_key, out_set = [], []
    todo = np.ones(len(which), bool)
    part_set = np.repeat(np.arange(len(which)), m)
    part_no = np.arange(base[-1]) - base[part_set]
    for spaces, light in ((1, True), (2, False)):
        row = np.flatnonzero(todo)
        if not len(row):
            break
        begin, count = at[use[which[row]]], size[which[row]]
        token_at = ragged(begin, count)
        owner = np.repeat(row, count)
        if light:
            keep = ~heavy[token_at]
            token_at, owner = token_at[keep], owner[keep]
        token = flat[token_at]
        with np.errstate(over="ignore"):
            dealt = mix(token * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
            slot = base[owner] + (dealt % m[owner].astype(np.uint64)).astype(np.int64)
            acc = np.zeros(base[-1], np.uint64)
            np.add.at(acc, slot, dealt ^ (token >> np.uint64(7)))
            held = np.bincount(slot, minlength=base[-1])
            key = mix(acc + mix(((scheme[part_set].astype(np.uint64) << np.uint64(32)) | part_no.astype(np.uint64)) + np.uint64(spaces << 60)) + held.astype(np.uint64))
        some = np.add.reduceat((held > 0).astype(np.int64), base[:-1])
        few = todo & (some <= h)
        write = _largest(part_set, held, key, (held > 0) & todo[part_set], h)
        if not light:
            write |= few[part_set]
        out_key.append(key[write])
        out_set.append(use[which[part_set[write]]])
        todo = few
    return np.concatenate(out_key), np.concatenate(out_set)


def _largest(part_set: np.ndarray, held: np.ndarray, key: np.ndarray, of: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Flags the h + 1 parts of most shingles of each set, ties by key, among the parts `of`."""
    at = np.flatnonzero(of)
    at = at[np.lexsort((key[at], -held[at], part_set[at]))]
    count = np.bincount(part_set[at], minlength=len(h))
    place = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros(len(of), bool)
    out[at[place <= h[part_set[at]]]] = True
    return out


def _sets_of(batch, n: int):
    """(first document, names, offsets) of each chunk of a batch."""
    data, offsets = text_buffer(batch.column("text"))
    table = lower_ascii()
    for a, b in chunks(offsets):
        yield a, *shingle_sets(table[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], n)


def _classes(n: int):
    def run(batches):
        for batch in batches:
            d, t, u = _keys(batch)
            for a, flat, at in _sets_of(batch, n):
                size, names = np.diff(at), set_names(flat, at)
                end = a + len(size)
                yield pa.RecordBatch.from_arrays([pa.array(d[a:end]), pa.array(t[a:end]), pa.array(u[a:end]), pa.array(names.view(np.int64), mask=size == 0), pa.array(size.astype(np.int64))], names=[*KEY, "node", "n"])

    return run


def _sampled(n: int):
    """Shingles of the sets whose name is in the sample."""

    def run(batches):
        for batch in batches:
            for _, flat, at in _sets_of(batch, n):
                chosen = np.flatnonzero((set_names(flat, at) % np.uint64(SAMPLE) == 0) & (np.diff(at) > 0))
                names = set_names(flat, at)[chosen]
                chosen = chosen[np.unique(names, return_index=True)[1]]
                values, count = np.unique(flat[ragged(at[chosen], np.diff(at)[chosen])], return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(count.astype(np.int64))], names=["token", "c"])

    return run


def _key_rows(n: int, num: int, den: int, heavy_b):
    def run(batches):
        table = heavy_b.value
        bits = np.zeros(1 << 22, bool)
        bits[(table & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        known: set[int] = set()  # names of the sets this task has written; as many as its input holds
        for batch in batches:
            for _, flat, at in _sets_of(batch, n):
                size, names = np.diff(at), set_names(flat, at)
                _, first = np.unique(names, return_index=True)
                use = np.array([k for k in first.tolist() if size[k] and int(names[k]) not in known], np.int64)
                if not len(use):
                    continue
                known.update(names[use].tolist())
                heavy = bits[(flat & np.uint64((1 << 22) - 1)).astype(np.int64)]
                maybe = np.flatnonzero(heavy)
                if len(maybe):
                    place = np.minimum(np.searchsorted(table, flat[maybe]), len(table) - 1)
                    heavy[maybe] = table[place] == flat[maybe]
                key, owner = part_keys(flat, at, use, heavy, num, den)
                key, node = combined(key.view(np.int64), names[owner].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    return run


def combined(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, node) that join the same nodes and hold every key once: the nodes of a key are
    represented by the first, and the groups this makes get a key of their own.  So a key that
    very many sets share costs the shuffle one row a chunk, and near copies one row each."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    head = np.r_[True, key[1:] != key[:-1]]
    lead = node[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
    on = lead != node
    if not on.any():
        return key[head], node[head]
    ids, root = closed(lead[on], node[on])
    own = (mix(root.view(np.uint64) ^ np.uint64(0xA24BAED4963EE407)) ^ mix(ids.max(initial=0).view(np.uint64) + np.uint64(len(ids)))).view(np.int64)
    return np.r_[key[head], own], np.r_[node[head], ids]


def closed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a - b, and the smallest node of each one's component."""
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    ids, flat = np.unique(pairs, return_inverse=True)
    forest = Forest(len(ids))
    for x, y in flat.reshape(-1, 2).tolist():
        forest.join(x, y)
    return ids, ids[np.array([forest.find(k) for k in range(len(ids))])]


def _first_links(batches):
    """Rows sorted by key: each set is linked to the first of its key; within a batch the links
    are closed, so what goes on is one link for each set and component."""
    key = leader = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column("key").to_numpy(), batch.column("node").to_numpy()
        head = np.flatnonzero(np.r_[keys[0] != key if key is not None else True, keys[1:] != keys[:-1]])
        lead = np.empty(len(keys), np.int64)
        if not len(head) or head[0]:
            lead[: head[0] if len(head) else len(keys)] = leader
        lead[head[0] if len(head) else len(keys) :] = np.repeat(nodes[head], np.diff(np.r_[head, len(keys)]))
        key, leader = keys[-1], lead[-1]
        on = lead != nodes
        if not on.any():
            continue
        ids, root = closed(lead[on], nodes[on])
        own = root != ids
        yield pa.RecordBatch.from_arrays([pa.array(root[own]), pa.array(ids[own])], names=["a", "b"])


class SignatureTree:
    """Levels of nodes over sets; level 0 are the sets in an order that keeps alike ones near."""

    def __init__(self, sets: list[np.ndarray], members: list[int], words: int) -> None:
        order = sorted(range(len(sets)), key=lambda k: (int(sets[k].min()), len(sets[k])))
        self.sets, self.members = [sets[k] for k in order], [members[k] for k in order]
        n = len(sets)
        size = np.array([len(s) for s in self.sets], np.int64)
        bits = np.zeros((n, words), np.uint64)
        flat = np.concatenate(self.sets)
        spot = (mix(flat) % np.uint64(words * 64)).astype(np.int64)
        np.bitwise_or.at(bits.reshape(-1), np.repeat(np.arange(n), size) * words + spot // 64, np.uint64(1) << (spot % 64).astype(np.uint64))
        spare = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        #: (OR of bitmaps, smallest size, largest size, most shingles that share a bit) by level
        self.levels = [(bits, size, size, spare)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sp = self.levels[-1]
            cut = np.arange(0, len(b), width)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(sp, cut)))
            width = FANOUT
        #: Nodes whose sets were seen to be in one component (they stay so).
        self.joined: list[set[int]] = [set() for _ in self.levels]

    def first(self, level: int, k: int) -> int:
        """The member that stands first below a node."""
        return self.members[k * (LEAF * FANOUT ** (level - 1) if level else 1)]

    def is_joined(self, level: int, k: int, forest: Forest) -> bool:
        """Whether all sets below a node are in one component."""
        if not level or k in self.joined[level]:
            return True
        root = forest.find(self.first(level, k))
        for c in self.children(level, k):
            if not self.is_joined(level - 1, c, forest) or forest.find(self.first(level - 1, c)) != root:
                return False
        self.joined[level].add(k)
        return True

    def children(self, level: int, k: int) -> range:
        width = LEAF if level == 1 else FANOUT
        return range(k * width, min((k + 1) * width, len(self.levels[level - 1][0])))


def may_link(a: tuple, rows_a: np.ndarray, b: tuple, rows_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of nodes can hold a link, by sizes and by the largest possible overlap."""
    low, high = np.maximum(a[1][rows_a][:, None], b[1][rows_b][None]), np.minimum(a[2][rows_a][:, None], b[2][rows_b][None])
    shared = np.bitwise_count(a[0][rows_a][:, None] & b[0][rows_b][None]).sum(2).astype(np.int64)
    over = np.minimum(high, shared + np.minimum(a[3][rows_a][:, None], b[3][rows_b][None]))
    return (num * low <= den * high) & (over * (num + den) >= num * (a[1][rows_a][:, None] + b[1][rows_b][None]))


def dual_traversal(a: SignatureTree, b: SignatureTree, forest: Forest, num: int, den: int) -> list[tuple[int, int]]:
    """Links found between the trees (or within one), without those that components imply."""
    found, same = [], a is b
    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    stack = [(top_a, 0, top_b, 0)]
    while stack:
        la, ka, lb, kb = stack.pop()
        if a.is_joined(la, ka, forest) and b.is_joined(lb, kb, forest) and forest.find(a.first(la, ka)) == forest.find(b.first(lb, kb)):
            continue
        inner = []
        rows_a = np.array(a.children(la, ka)) if la else np.array([ka])
        rows_b = np.array(b.children(lb, kb)) if lb else np.array([kb])
        next_a, next_b = max(la - 1, 0), max(lb - 1, 0)
        okay = may_link(a.levels[next_a], rows_a, b.levels[next_b], rows_b, num, den)
        for i, j in zip(*np.nonzero(okay), strict=True):
            x, y = int(rows_a[i]), int(rows_b[j])
            if same and next_a == next_b and x > y:
                continue
            if next_a or next_b:
                (inner if same and next_a == next_b and x == y else stack).append((next_a, x, next_b, y))
                continue
            if same and x == y:
                continue
            p, q = a.members[x], b.members[y]
            if forest.find(p) == forest.find(q):
                continue
            s, t = a.sets[x], b.sets[y]
            both = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
            if den * both >= num * (len(s) + len(t) - both):
                forest.join(p, q)
                found.append((p, q))
        stack += inner
    return found


def _joined(num: int, den: int):
    """Streams (root, i, j) groups of sets; yields the links of each.  Sets of side 1 meet each
    other, unless they are known to have done so, and those of side 0; a group with side 0 alone
    meets itself.  Sets with the same `known` component count as joined."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        nodes = sorted({r[3] for r in rows})
        number = {x: k for k, x in enumerate(nodes)}
        sides: list[dict[int, np.ndarray]] = [{}, {}]
        forest, first, inside = Forest(len(nodes)), {}, True
        for _, _, _, node, side, known, packed in rows:
            sides[side][node] = np.frombuffer(packed, np.uint64)
            if known is not None:
                inside = False
                forest.join(first.setdefault(known, number[node]), number[node])
        longest = max(len(s) for side in sides for s in side.values())
        words = min(128, 1 << max(2, (4 * longest // 64).bit_length()))
        trees = [SignatureTree(list(s.values()), [number[x] for x in s], words) for s in sides if s]
        found = []
        if inside:
            found += dual_traversal(trees[-1], trees[-1], forest, num, den)
        if len(trees) == 2:
            found += dual_traversal(trees[0], trees[1], forest, num, den)
        return [(nodes[x], nodes[y]) for x, y in found]

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if held and row[:3] != held[0][:3]:
                    out += links(held)
                    held = []
                if not held or row[3:5] != held[-1][3:5]:  # copies of a text come once
                    held.append(row)
            if out:
                yield pairs(out)
        if held and (out := links(held)):
            yield pairs(out)

    def pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def _packed_sets(n: int):
    def run(batches):
        for batch in batches:
            root, node, parts, known = (batch.column(c) for c in ("root", "node", "parts", "known"))
            for a, flat, at in _sets_of(batch, n):
                # rows without id repeat a key: of copies in a chunk one goes on
                _, one = np.unique(node.to_numpy()[a : a + len(at) - 1], return_index=True)
                own = [flat[at[k] : at[k + 1]].tobytes() for k in one.tolist()]
                pick = pa.array(a + one)
                yield pa.RecordBatch.from_arrays([root.take(pick), node.take(pick), parts.take(pick), known.take(pick), pa.array(own, pa.binary())], names=["root", "node", "parts", "known", "packed"])

    return run


PACKED = "root long, node long, parts int, known long, packed binary"
MET = ("root", "i", "j", "node", "side", "known", "packed")


def _links(sets: DataFrame, num: int, den: int) -> DataFrame:
    met = sets.select(*MET).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node", "side")
    return checkpointed(in_arrow(met, _joined(num, den), "a long, b long"))


def verified(texts: DataFrame, home: DataFrame, n: int, num: int, den: int, chunk_tokens: int) -> DataFrame:
    """Links (a, b) between sets, enough to join all that are linked.  home: the candidates, with
    `root`, `node`, the key of a document that has the set, and `n`."""

    def packed(chosen: DataFrame) -> DataFrame:
        rows = texts.join(chosen.select("root", "node", "known", *KEY, "parts"), KEY)
        return in_arrow(rows.select("root", "node", "parts", "known", "text"), in_parts(_packed_sets(n)), PACKED)

    def spot(parts: str, salt: int = 0):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts)).cast("int")

    parts = checkpointed(home.groupBy("root").agg(F.ceil(F.sum("n") / chunk_tokens).cast("int").alias("parts")))
    chosen = home.join(parts, "root").withColumn("known", F.lit(None).cast("long"))
    sets = packed(chosen).withColumn("at", spot("parts"))
    others = F.when(F.col("at") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("at"))
    links = _links(sets.withColumn("j", F.explode(others)).withColumns({"i": F.lit(0), "side": (F.col("at") > 0).cast("int")}), num, den)
    cut = parts.where("parts > 1")
    if cut.isEmpty():
        return links
    # what the largest component found in a candidate of several chunks leaves out meets all of it
    found = components(links)
    now = home.join(cut, "root").join(found.withColumnRenamed("root", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    now = checkpointed(now.select("root", "node", *KEY, "n", "parts", "known"))
    largest = now.groupBy("root", "known").agg(F.count("*").alias("c")).groupBy("root").agg(F.max_by("known", F.struct("c", "known")).alias("most"))
    left = now.join(largest, "root").where("known <> most").groupBy("root").agg(F.ceil(F.sum("n") / chunk_tokens).cast("int").alias("more"), F.first("most").alias("most"))
    left = checkpointed(left)
    if left.isEmpty():
        return links
    again = packed(now.join(left, "root")).join(left, "root").withColumns({"at": spot("parts"), "far": spot("more", 1)})
    here = again.withColumns({"side": F.lit(0), "i": F.col("at"), "j": F.explode(F.sequence(F.lit(0), F.col("more") - 1))})
    there = again.where("known <> most").withColumns({"side": F.lit(1), "j": F.col("far"), "i": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    return links.union(_links(here.select(*MET).union(there.select(*MET)), num, den))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, chunk_tokens: int = CHUNK_TOKENS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """`_d`, `_t`, `_u`, `n` (shingles), `node` (set name, null if empty) and `root` (component) of every document.

    Two documents are linked if den * |intersection| >= num * |union| of their n-word shingles.
    """
    spark = docs.sparkSession
    texts = keyed(docs)
    classes = checkpointed(in_arrow(texts, in_parts(_classes(n)), "_d long, _t long, _u long, node long, n long"))
    sampled = in_arrow(texts, in_parts(_sampled(n)), "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= HEAVY_IN_SAMPLE)
    heavy = sampled.orderBy(F.desc("c"), "token").limit(max_heavy).select("token").toArrow().column(0).to_numpy().view(np.uint64)
    heavy_b = spark.sparkContext.broadcast(np.sort(heavy) if len(heavy) else np.zeros(1, np.uint64))
    del heavy
    released()
    keys = in_arrow(texts, in_parts(_key_rows(n, num, den, heavy_b)), "key long, node long")
    links = in_arrow(keys.repartition("key").sortWithinPartitions("key", "node"), _first_links, "a long, b long")
    near = components(links)
    one = classes.where("node is not null").groupBy("node").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("n").alias("n"))
    home = checkpointed(near.join(one, "node").select("root", "node", "rep._d", "rep._t", "rep._u", "n"))
    found = components(verified(texts, home, n, num, den, chunk_tokens))
    heavy_b.destroy()
    return classes.join(found, "node", "left").select(*KEY, "n", "node", F.coalesce("root", "node").alias("root"))


def component_ids(docs: DataFrame, **options) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` of every row of `docs`."""
    found = jaccard_components(docs, **options)
    id_ = F.when(F.col("_d") != F.lit(-(2**63)), F.col("_d"))
    # written, so that a component of very many rows can be split where it is joined
    least = checkpointed(found.where("root is not null").groupBy("root").agg(F.min(id_).alias("least")))
    return found.join(least, "root", "left").select(id_.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("root").isNotNull(), F.col("least")).otherwise(id_).alias("component_id"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without those that another document of their component stands for:
    one row with the smallest doc_id stays, also of repeated rows and of copies without id."""
    found = jaccard_components(docs, **options)
    least = found.where("root is not null").groupBy("root").agg(F.min(F.struct(*KEY)).alias("keep"))
    # rows without words are in no component and stay; rows of one key differ in other columns alone
    worded = F.coalesce(F.col("text").cast("string").rlike("[^ \\x09-\\x0d]"), F.lit(False)).alias("_worded")
    rows = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("_row"), *doc_key(), worded)
    # of rows with one key the least stays; they meet where they are read, before any shuffle
    lone = rows.where("_worded").groupBy(*KEY).agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    chosen = lone.join(least.select("keep.*"), KEY)
    return chosen.select("_row").union(rows.where("not _worded").select("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
