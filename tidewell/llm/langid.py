"""Language identification: word-first backoff.

Training counts, per language, words and the character n-grams (1 to 4, word edges count as
a character) of the distinct words.  A known word scores by its log frequency in each language;
a word never seen falls back to its 4-grams, then 3-grams, 2-grams and single characters,
until one length holds an n-gram that is known, and scores by their mean.  Scores are
normalised over the languages and summed over all words of the text.

The model is fitted on at most about `max_docs` labelled rows, chosen by a hash.  Every language
chooses about its `max_entries` most frequent words and n-grams, but no more than an equal share of
`max_total`, so a large one takes no place from a small one, and what one language chose is
counted in all that have it.  All three are parameters.  The model is sparse: a language has an entry
for a name only if it was counted there, and one number for all other names, so many languages
(a dirty column) cost what they hold, not their square.

Cases: null text and text without letters give `und` with score 0; a text whose characters
are all unknown gets equal shares; rows with null lang teach nothing; without any training
row all is `und`; ties go to the language whose name comes first; repeated rows are scored alike; very
long texts are scored whole, in the memory of one task; other columns are carried, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, chunks, fresh, in_arrow, in_parts, mix, quoted, ragged, released, running, span, text_buffer

LONGEST = 4
SMOOTH = 0.2
MAX_DOCS = 20_000
MAX_ENTRIES = 300_000
MAX_TOTAL = 4_000_000
#: Totals (document, language) that a task holds at once.
TOTALS = 4_000_000
UNKNOWN = "und"


def letters() -> np.ndarray:
    """Flags of letters by code point, up to 65535."""
    return np.fromiter((chr(k).isalpha() for k in range(65536)), bool, 65536)


class Words:
    """Lower-cased words of a chunk of texts, named by fingerprints."""

    def __init__(self, texts: list[str], is_letter: np.ndarray, lowered: bool = False) -> None:
        low = texts if lowered else [t.lower() for t in texts]
        self.whole = "\n" + "\n".join(low) + "\n"
        code = np.frombuffer(self.whole.encode("utf-32-le", "replace"), np.uint32)
        inside = is_letter[np.minimum(code, 65535)]
        beyond = np.flatnonzero(code > 65535)
        if len(beyond):
            values, back = np.unique(code[beyond], return_inverse=True)
            inside[beyond] = np.array([chr(k).isalpha() for k in values.tolist()])[back]
        edge = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        first = np.cumsum([1, *(len(t) + 1 for t in low)])
        self.doc = np.searchsorted(first, self.starts, "right") - 1
        self.sums = running(np.where(inside, mix(code.astype(np.uint64) + np.uint64(2)), np.uint64(0x51ED270B7A1F3C05)))
        self.names = self.named(self.starts, self.ends)

    def named(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(span(self.sums, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def strings(self, words: np.ndarray) -> list[str]:
        return [self.whole[s:e] for s, e in zip(self.starts[words].tolist(), self.ends[words].tolist(), strict=True)]

    def grams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of `words`, name) of each character n-gram; from two characters on a word has
        an edge on either side."""
        edge = int(n > 1)
        begin = self.starts[words] - edge
        count = np.maximum(self.ends[words] - self.starts[words] + 2 * edge + 1 - n, 0)
        at = ragged(begin, count)
        return np.repeat(np.arange(len(words)), count), self.named(at, at + n)


def _counted(batches):
    """(language, word, count) of each chunk."""
    is_letter = letters()
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        _, offsets = text_buffer(batch.column("text"))
        known = sorted(set(langs))
        number = np.array([known.index(x) for x in langs])
        for a, b in chunks(offsets):
            words = Words([t or "" for t in texts[a:b]], is_letter)
            lang = number[a + words.doc]
            for k, name in enumerate(known):
                own = np.flatnonzero(lang == k)
                _, at, count = np.unique(words.names[own], return_index=True, return_counts=True)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(words.strings(own[at]), pa.string()), pa.array(count.astype(np.int64))], names=["lang", "word", "c"])


def _grams(batches):
    """(language, length of the n-gram or 0 for words, name, count) of distinct words with counts."""
    is_letter = letters()
    for batch in batches:
        langs, count = np.array(batch.column("lang").to_pylist(), object), batch.column("c").to_numpy()
        words = Words(batch.column("word").to_pylist(), is_letter, lowered=True)
        for name in sorted(set(langs.tolist())):
            own = np.flatnonzero(langs == name)
            parts = [(0, words.names[own], count[own])]
            for n in range(1, LONGEST + 1):
                _, grams = words.grams(own, n)
                parts.append((n, *np.unique(grams, return_counts=True)))
            for n, v, c in parts:
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(np.full(len(v), n, np.int32)), pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "n", "name", "c"])


def cut(sizes, most: int) -> tuple[int, int, int]:
    """(count, length, share of 2**30) of the last (count, length) rows that fit in `most`: large
    counts first, words before n-grams and short ones before long.  sizes: how many there are."""
    left = most
    for c, n, rows in sizes.sort_values(["c", "n"], ascending=[False, True])[["c", "n", "rows"]].itertuples(index=False):
        if rows > left:
            return int(c), int(n), (1 << 30) * left // int(rows)
        left -= rows
    return 0, 0, 0


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL) -> dict:
    """The model from rows of `text` and `lang`: at most about `max_docs` of them."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    total = rows.count()
    if total > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * max_docs / total))
    words = in_arrow(rows, in_parts(_counted), "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    counted = in_arrow(words, _grams, "lang string, n int, name long, c long").groupBy("n", "name", "lang").agg(F.sum("c").alias("c"))
    counted = checkpointed(counted)
    sizes = counted.groupBy("lang", "c", "n").agg(F.count("*").alias("rows")).toArrow().to_pandas()
    langs = sorted(sizes["lang"].unique())
    if not langs:
        return {"langs": [], "tables": []}
    most = min(max_entries, max(1, max_total // len(langs)))
    cuts = labelled.sparkSession.createDataFrame([(x, k, *cut(sizes[sizes["lang"] == x], most)) for k, x in enumerate(langs)], "lang string, k int, least long, longest int, share long")
    # of the rows at the cut a share goes on, chosen by a hash, so that no task sorts a language
    level = (F.col("c") == F.col("least")) & (F.col("n") == F.col("longest"))
    above = (F.col("c") > F.col("least")) | ((F.col("c") == F.col("least")) & (F.col("n") < F.col("longest")))
    chosen = above | (level & (F.pmod(F.xxhash64("name"), F.lit(1 << 30)) < F.col("share")))
    by_name = counted.join(F.broadcast(cuts), "lang").groupBy("n", "name").agg(F.max(chosen).alias("chosen"), F.collect_list(F.struct("k", "c")).alias("all"))
    by_name = by_name.where("chosen").select("n", "name", F.inline("all"))
    kept = {c: x.to_numpy() for c, x in zip(("n", "name", "k", "c"), by_name.toArrow().combine_chunks().columns, strict=True)}
    model: dict = {"langs": langs, "tables": []}
    for n in range(LONGEST + 1):
        part = kept["n"] == n
        model["tables"].append(Table.of(kept["name"][part].view(np.uint64), kept["k"][part], kept["c"][part], len(langs)))
    del kept
    released()
    return model


class Table(NamedTuple):
    """Names of one length with their scores: a language's score for a name is `base[language]`, and
    `more` above it where the name was counted.  Scores are log frequencies; what is the same for all
    languages changes no choice and is left out."""

    names: np.ndarray  # sorted
    at: np.ndarray  # where each name's entries begin, and their number
    lang: np.ndarray
    more: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, lang: np.ndarray, count: np.ndarray, n_langs: int) -> Table:
        order = np.argsort(names, kind="stable")
        found, first = np.unique(names[order], return_index=True)
        sums = np.bincount(lang, weights=count, minlength=n_langs)
        base = np.log(SMOOTH / (sums + SMOOTH * max(len(found), 1)))
        return cls(found, np.append(first, len(names)), lang[order].astype(np.int32), np.log(count[order] / SMOOTH + 1).astype(np.float32), base)

    def rows(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each name is known, and its place."""
        if not len(self.names):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return self.names[at] == names, at

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many entries each of the names has, and where they are."""
        size = self.at[at + 1] - self.at[at]
        return size, ragged(self.at[at], size)


class WordScores(NamedTuple):
    """The chosen words' scores by word or by backoff: the table each was found in (-1: none), and
    its entries from `start`, `size` of them."""

    table: np.ndarray
    start: np.ndarray
    size: np.ndarray
    lang: np.ndarray
    more: np.ndarray


def word_scores(model: dict, words: Words, chosen: np.ndarray) -> WordScores:
    table = np.full(len(chosen), -1)
    parts: list[tuple] = []

    def found(n: int, word: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
        own = model["tables"][n]
        size, where = own.entries(at)
        parts.append((np.repeat(word, size), own.lang[where], own.more[where] * np.repeat(weight, size)))
        table[word] = n

    known, at = model["tables"][0].rows(words.names[chosen])
    found(0, np.flatnonzero(known), at[known], np.ones(int(known.sum())))
    left = np.flatnonzero(~known)
    for n in range(LONGEST, 0, -1):
        if not len(left):
            break
        which, grams = words.grams(chosen[left], n)
        seen, at = model["tables"][n].rows(grams)
        which, at = which[seen], at[seen]
        count = np.bincount(which, minlength=len(left))
        found(n, left[which], at, 1 / count[which])  # the mean over the known n-grams
        left = left[count == 0]
    word, lang, more = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(word, kind="stable")
    size = np.bincount(word, minlength=len(chosen))
    return WordScores(table, np.cumsum(size) - size, size, lang[order], more[order])


def document_totals(model: dict, doc: np.ndarray, word: np.ndarray, scores: WordScores, n_docs: int) -> np.ndarray:
    """Scores (document, language) of the words `word` of documents `doc`."""
    n_langs = len(model["langs"])
    size = scores.size[word]
    at = ragged(scores.start[word], size)
    total = np.bincount(np.repeat(doc, size) * n_langs + scores.lang[at], weights=scores.more[at], minlength=n_docs * n_langs).astype(float).reshape(n_docs, n_langs)
    for n, own in enumerate(model["tables"]):
        total += np.bincount(doc[scores.table[word] == n], minlength=n_docs)[:, None] * own.base
    return total


def _predicted(model_b, names: tuple[str, str]):
    def run(batches):
        model, is_letter = model_b.value, letters()
        langs = model["langs"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            _, offsets = text_buffer(batch.column("text"))
            best, share = [], []
            for a, b in chunks(offsets):
                words = Words([t or "" for t in texts[a:b]], is_letter)
                if not langs:
                    best += [UNKNOWN] * (b - a)
                    share += [0.0] * (b - a)
                    continue
                _, at, back = np.unique(words.names, return_index=True, return_inverse=True)
                scores = word_scores(model, words, at)
                step = max(1, TOTALS // len(langs))
                for low in range(0, b - a, step):
                    n = min(step, b - a - low)
                    own = slice(*np.searchsorted(words.doc, [low, low + n]))
                    doc = words.doc[own] - low
                    total = document_totals(model, doc, back[own], scores, n)
                    some = np.bincount(doc, minlength=n) > 0
                    top = total.argmax(1)
                    with np.errstate(under="ignore"):
                        odds = np.exp(total - total.max(1, keepdims=True))
                    part = odds.max(1) / odds.sum(1)
                    best += [langs[k] if s else UNKNOWN for k, s in zip(top.tolist(), some.tolist(), strict=True)]
                    share += np.where(some, part, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(share, pa.float64())], names=[*batch.schema.names, *names])

    return run


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of `docs` (it needs `text`), `_lang` and `_score` (see `added`)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = added(docs)
    schema = T.StructType(docs.schema.fields + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return in_arrow(docs, in_parts(_predicted(held, names)), schema)


def added(docs: DataFrame) -> tuple[str, str]:
    """The names of the columns that `identify` adds: `_lang` and `_score`, with more underscores
    in front if `docs` has such a column."""
    return fresh(docs.columns, "_lang"), fresh(docs.columns, "_score")


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that may teach: those whose crc32 of the id leaves another remainder than 2."""
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) != 2)


def identified(docs: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of `docs` whose language is told with a score of `least` or more."""
    found, (lang, score) = identify(docs, fit(training_rows(docs), **options)), added(docs)
    return found.where((F.col(quoted(lang)) != UNKNOWN) & (F.col(quoted(score)) >= least)).drop(lang, score)
