"""Plain Python versions of the operators, and rows that exercise them."""

import hashlib
import random
import re
import zlib

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(doc_id, m):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % m


def corpus(seed=1, n=60):
    """(doc_id, text): random prose with copies, near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(2, 9))) for _ in range(400)]

    def prose(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passages = [" ".join(prose(45)) for _ in range(4)]
    rows, made = [], []
    for k in range(n):
        roll = rng.random()
        if made and roll < 0.15:
            text = rng.choice(made)
        elif made and roll < 0.35:
            words = rng.choice(made).split(" ")
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(prose(rng.randrange(1, 160)))
            if rng.random() < 0.4:
                text += "\n" + rng.choice(passages) + "\t" + " ".join(prose(rng.randrange(20)))
        made.append(text)
        rows.append((k, text))
    again = "Na " * 150
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, again), (n + 5, again.upper()), (None, rows[0][1]), (n + 6, " ".join(prose(9000)))]
    return rows


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        from pyspark.sql import functions as F

        df = df.select("doc_id", F.lit("x").alias("starts"), "text", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_words"), F.lit(2).alias("items"), F.lit(3).alias("grams"), F.length("text").cast("long").alias("n_chars"))
    return df


def substrings(rows, length=200):
    """doc_id -> (n_bytes, n_removed, spans, kept)."""
    texts = {(i, t): (t or "").encode() for i, t in rows}
    count = {}
    for key, b in texts.items():
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] = count.get(b[p : p + length], 0) + 1
    out = {}
    for (i, _), b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), len(b) - len(kept), spans, sha(kept))
    return out


def windows(rows, k=20):
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0])):
        w = SPACED.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if key in seen:
                gone[p : p + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, n):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))) if w else frozenset()


def groups(rows, n, num):
    """doc_id -> (size of its set, smallest id of its component)."""
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets, key=lambda i: (i is None, i))
    for a in range(len(ids)):
        for b in range(a):
            s, t = sets[ids[a]], sets[ids[b]]
            if s and t and 100 * len(s & t) >= num * len(s | t):
                x, y = sorted((find(ids[a]), find(ids[b])), key=lambda i: (i is None, i))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def contamination(rows, items, window=10):
    held = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        for p in range(max(1, len(w) - window + 1) if w else 0):
            held.setdefault(tuple(w[p : p + window]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in held}
    out = {}
    for i, text in rows:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = [False] * len(w), set()
        for size in sizes:
            for p in range(len(w) - size + 1):
                if names := held.get(tuple(w[p : p + size])):
                    found |= names
                    hit[p : p + size] = [True] * size
        out[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))))
    return out
