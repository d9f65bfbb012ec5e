"""Running totals over a long order without one task for all rows.

A window without `partitionBy` runs in a single task.  Here rows are windowed by day, and each
day adds the totals of the days before it: only the day table (a few hundred rows a year)
passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def with_prefix(df: DataFrame, order: str, sums: dict[str, Column], day: int = DAY, maxes: dict[str, Column] | None = None) -> DataFrame:
    """`df` with running sums (inclusive, as long) and running maxima of the given columns in the
    order of `order`.

    order: a column of distinct whole numbers.
    """
    maxes = maxes or {}
    keyed = df.withColumn("_day", F.floor(F.col(order) / day)).withColumns({f"_v_{n}": c.cast("long") for n, c in (sums | maxes).items()})
    totals = keyed.groupBy("_day").agg(*[(F.max if n in maxes else F.sum)(f"_v_{n}").alias(f"_t_{n}") for n in sums | maxes])
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_day", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums], *[F.max(f"_t_{n}").over(before).alias(f"_b_{n}") for n in maxes])
    within = Window.partitionBy("_day").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    added = {n: (F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(within)).cast("long") for n in sums}
    added |= {n: F.greatest(F.col(f"_b_{n}"), F.max(f"_v_{n}").over(within)) for n in maxes}
    out = keyed.join(totals, "_day").withColumns(added)
    return out.drop("_day", *[f"_v_{n}" for n in added], *[f"_b_{n}" for n in added])


def trailing(df: DataFrame, order: str, frames: dict[str, tuple[str, int]]) -> DataFrame:
    """`df` with, for each name, the minimum of a column over rows at most `width` before, own included.

    frames: name -> (column, width).  Rows are repeated for as many days as the widest frame
    reaches, so that every day's task holds all its rows look back on.
    """
    widest = max(w for _, w in frames.values())
    reach = -(-widest // DAY)
    copies = df.withColumn("_own", F.floor(F.col(order) / DAY)).withColumn("_day", F.explode(F.sequence(F.col("_own"), F.col("_own") + reach)))
    by_day = Window.partitionBy("_day").orderBy(order)
    out = copies.withColumns({n: F.min(c).over(by_day.rangeBetween(-w, 0)) for n, (c, w) in frames.items()})
    return out.where("_day = _own").drop("_day", "_own")


def previous(df: DataFrame, key: list[str], order: str, values: list[str], stretch: int = 1 << 22) -> DataFrame:
    """`df` with `prev_<value>`, the values of the row before it in the order of `order` among rows of its
    key (null: none).

    A key with very many rows is dealt by stretches of the order; a stretch's first row takes the
    values of the last stretch before it that has the key.
    """
    keyed = df.withColumn("_s", F.floor(F.col(order) / stretch))
    last = keyed.groupBy(*key, "_s").agg(F.max_by(F.struct(*values), order).alias("_l"))
    before = last.select(*key, "_s", F.lag("_l").over(Window.partitionBy(*key).orderBy("_s")).alias("_b")).where("_b is not null")
    own = Window.partitionBy(*key, "_s").orderBy(order)
    near = keyed.withColumn("_n", F.lag(F.struct(*values)).over(own)).join(before, [*key, "_s"], "left")
    found = F.coalesce("_n", "_b")
    return near.select(*df.columns, *[found[v].alias(f"prev_{v}") for v in values])
