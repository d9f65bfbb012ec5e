"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Documents become mask cells: a bit for every filter that a document fails, counted by part.  The
cells are unpivoted against all orders and steps; a running bit-or over the steps tells which
cells an earlier filter has removed, conditional sums give the counts of a step, and totals by
filter over all orders give its Shapley count.  All of it is DataFrame operations.

Only the text scan sees the text.  From there a document is one row of a few numbers, which is
shuffled by id (to meet its labels) and, combined by equal texts before it moves, by the text's
name; so a text, an id or a part that holds a third of all rows is no task of its own.  After the
cells there are at most 2**n rows a part (n filters), times n! orders and n steps.

Cases.  A null text is an empty one: it fails the word count and nothing else.  Very long texts
are split to words in the memory of one task, as the other operators do.  A null doc_id counts as
the smallest id: such rows never fail E, and of a text they hold every row with an id does.
Repeated rows are documents of their own; rows of one id and one text do not make each other fail.
A null part is the empty string's.  A null or absent label is none; of several label rows for an
id one that says 1 is enough; labels without id label nothing.  Ties: the outcome depends on
no order of rows.  An empty table gives an empty result.  Columns beside those that are read
(`doc_id`, `text`, the part's; `doc_id`, `quality`, `toxic`) are not looked at, whatever their names.
Texts are told apart by 128-bit names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID

#: n filters have n! orders; more than this many are refused.
MAX_FILTERS = 7
SPACES = r"[\x20\x09-\x0D]+"
COPIES = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone, each true where the text fails it."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", filters=text_filters) -> DataFrame:
    """`part`, `mask`, `n`, `good`, `toxic`: documents by part and the filters they fail, and how many
    of them are labelled so.  Bit k of the mask is the k-th of `filters`, the bit after them is
    `E`: a smaller doc_id has the same text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), text.alias("text"))
    failed = list(filters(F.col("text")).values())
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))
    named = seen.select("part", "id", mask.alias("mask"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"))
    rows = named.groupBy("id", "t", "u", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    # rows without id meet no label, so they are dealt by text (the salt of labels is 0)
    salted = rows.withColumn("salt", F.when(F.col("id") == NULL_ID, F.col("t").bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(yes("quality"), yes("toxic")).withColumn("salt", F.lit(0).cast("long"))
    facts = salted.join(told, ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    kinds = facts.groupBy("t", "u", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    # of a text's rows those of its least id pass; a row here is a kind of document that has the text
    least = F.min("first.id").over(Window.partitionBy("t", "u"))
    passed = F.when(F.col("first.id") == least, F.col("first.n")).otherwise(F.lit(0))
    both = kinds.select("part", "mask", "quality", "toxic", "n", passed.alias("passed"))
    split = F.array(F.struct("mask", F.col("passed").alias("n")), F.struct((F.col("mask") + (1 << len(failed))).alias("mask"), (F.col("n") - F.col("passed")).alias("n")))
    cells = both.select("part", "quality", "toxic", F.inline(split)).where("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic"))


def interactions(cells: DataFrame, names: str) -> DataFrame:
    """`part`, `filter_order`, `step` and its counts, for all orders of the filters `names` (a letter each,
    bit k of the cells' mask is the k-th letter's).

    kept, removed: documents after and at this step; redundant: those that fail its filter and were
    removed before; unique_fails: those that fail no other; good_lost, toxic_lost: of the removed
    those labelled so; shapley: the filter's removed, summed over all orders at whatever step.
    """
    if not 0 < len(set(names)) == len(names) <= MAX_FILTERS:
        raise ValueError(f"1 to {MAX_FILTERS} filters of different letters")
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])).alias("filter_order")
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step")
    long = cells.repartition("part").select("*", orders).select("*", steps)
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{names}', substring(filter_order, step, 1)) - 1)"))
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumns({"gone": F.coalesce(F.bit_or("fails").over(earlier), F.lit(0)) != 0, "fails": F.col("fails") != 0})

    def total(when: Column, of: str = "n") -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(F.lit(0))).cast("long")

    gone, fails = F.col("gone"), F.col("fails")
    counted = long.groupBy("part", "filter_order", "step", "bit").agg(
        total(~gone & ~fails).alias("kept"),
        total(~gone & fails).alias("removed"),
        total(gone & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"),
        total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", filters=text_filters) -> DataFrame:
    """The interactions of the text filters and of `E` over whole `docs`."""
    names = "".join(filters(F.lit("")))
    if COPIES in names:
        raise ValueError(f"{COPIES} is the filter of copies")
    return interactions(mask_cells(docs, labels, part, filters), names + COPIES)
