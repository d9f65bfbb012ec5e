"""URL filters as a temporal list join, in DataFrame operations only.

A list is a history of dated entries: (kind, key, action, ts) with kind `host` (that host),
`domain` (that host and all below it) or `prefix` (host and path begin so, at a `/`), and
action `add` or `remove`.  Each entry's history becomes validity intervals, and every capture
is evaluated against the intervals that hold its fetch time (from inclusive, to exclusive).

The as-of join is an equi-join on (key, time bucket, salt): intervals are repeated for the
buckets they touch and for every salt, captures take the salt of their own hash, so a hot
host is dealt over `buckets * salts` keys.  Spells are cut to the captures' time, and buckets
widened where that time is long, so entries and captures of any date are few rows.  The intervals are broadcast only if they have
been counted and are at most `max_broadcast` rows.

Cases: at equal ts a removal counts last; repeated entries count once; entries that lack a
field are ignored; an entry never removed is valid for ever; captures without url, host or
time match nothing; repeated captures are evaluated each by itself; an empty list blocks nothing,
and no captures give no rows; very long urls are matched whole;
columns of captures and entries beside those named here, whatever they are called, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
REST = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
BUCKET = 30 * 86_400
SALTS = 16
MAX_BROADCAST = 50_000
#: Buckets over the captures' whole time; wider ones than asked for are taken beyond.
MAX_BUCKETS = 4096


def place(ts: Column, bucket: int) -> Column:
    """The bucket of a time; whole numbers, as a double is not exact for far times."""
    return F.floor((ts - F.pmod(ts, F.lit(bucket))) / bucket)


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), HOST, 1)


def path_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(url), REST, 1), F.lit("")), F.lit("/"))


def intervals(entries: DataFrame) -> DataFrame:
    """`rule` (kind and key in one), `since` and `until` (null: still valid) of each spell."""
    e = entries.select(
        F.concat_ws(":", F.col("kind"), F.lower("key")).alias("rule"),
        (F.col("action") == "add").alias("on"),
        F.col("ts").cast("long").alias("ts"),
    ).where("ts is not null and on is not null")
    e = e.where(F.col("rule").rlike("^(host|domain|prefix):.")).groupBy("rule", "ts").agg(F.min("on").alias("on"))
    spell = Window.partitionBy("rule").orderBy("ts")
    return e.withColumn("until", F.lead("ts").over(spell)).where("on").select("rule", F.col("ts").alias("since"), "until")


def rules_of(url: Column) -> Column:
    """Every rule that could hold for a URL: host, its parent domains and its path prefixes."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    parts = F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes))


def filter_urls(captures: DataFrame, entries: DataFrame, bucket: int = BUCKET, salts: int = SALTS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`captures` rows (`page_id`, `url`, `fetched_at` in seconds) with `n_rules`, the rules
    valid at the fetch, `rules` (sorted) and `blocked`."""
    c = captures.select("page_id", "url", F.col("fetched_at").cast("long").alias("fetched_at"))
    spells = intervals(entries)
    keys = c.where("fetched_at is not null").select("page_id", "url", "fetched_at", F.explode(F.array_distinct(rules_of(F.col("url")))).alias("rule"))
    if spells.limit(max_broadcast + 1).count() <= max_broadcast:
        spells = F.broadcast(spells)
        on: list[str] = ["rule"]
    else:
        # only the captures' own time counts, and a spell is in at most MAX_BUCKETS buckets
        first, last = (x or 0 for x in c.agg(F.min("fetched_at"), F.max("fetched_at")).first())
        bucket = max(bucket, -(-(last - first + 1) // MAX_BUCKETS))
        spells = spells.where((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
        since, until = F.greatest("since", F.lit(first)), F.least(F.coalesce("until", F.lit(last)), F.lit(last))
        spells = spells.withColumn("bucket", F.explode(F.sequence(place(since, bucket), place(until, bucket))))
        spells = spells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = keys.withColumn("bucket", place(F.col("fetched_at"), bucket)).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        on = ["rule", "bucket", "salt"]
    valid = (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    hits = keys.join(spells, on).where(valid).groupBy("page_id", "url", "fetched_at").agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    # rows are told apart by all they hold; nulls match nulls
    own = F.struct("page_id", "url", "fetched_at")
    hits = hits.select(F.xxhash64("page_id", "url", "fetched_at").alias("_n"), own.alias("_m"), "rules")
    out = c.withColumn("_h", F.xxhash64("page_id", "url", "fetched_at")).withColumn("_c", own)
    out = out.join(hits, (F.col("_h") == F.col("_n")) & F.col("_c").eqNullSafe(F.col("_m")), "left")
    n = F.when(F.col("rules").isNotNull(), F.size("rules")).otherwise(0)
    return out.select("page_id", "url", "fetched_at", n.cast("long").alias("n_rules"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), (n > 0).alias("blocked"))
