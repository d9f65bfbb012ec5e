"""The opN_<name> queries: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_quality
from .common import KEY, id_column
from .decontaminate import decontaminate
from .filter_audit import audit
from .jaccard import component_ids
from .langid import fit as fit_langid
from .langid import identify, training_rows
from .mixing import TARGETS, label_domains, mix_domains
from .simhash import component_ids as simhash_ids
from .suffix_dedup import dedup_substrings
from .superkmers import dedup_windows
from .topk import top_k
from .url_filter import filter_urls, host_of
from .warc import round_trip
from .whiten import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = label_domains(table(spark, sf_dir, "labels"))
    return mix_domains(docs, labels, TARGETS, keep=("doc_id", "source")).drop(*KEY)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.col("_items_sha256").alias("items_sha256"),
        (F.col("_n_hit") > 0).alias("contaminated"),
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90, den=100)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_langid(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_score").alias("score"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(id_column(), "n_words", "n_removed", "kept_sha256")


#: First day of the year in which op7's captures are dated, in seconds; a day and a year.
DAY0, DAY, YEAR = 1_704_067_200, 86_400, 365 * 86_400


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` has no fetch times and there is no list: both follow from ids and host names by
    rules.  Captures are spread over a year; about half of the hosts are listed for some weeks
    (some again later), the others' `/en/` paths for good, and parent domains for 20 days."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", DAY0 + F.pmod(F.col("page_id") * 7919, F.lit(YEAR)))
    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    number = F.ascii("h") * 31 + F.length("h") * 7 + F.ascii(F.substring("h", 2, 1))
    hosts = hosts.withColumn("c", number.cast("long"))
    parents = hosts.select(F.regexp_replace("h", r"^[^.]*\.", "").alias("h")).where("h <> ''").distinct().withColumn("c", number.cast("long"))

    def entry(source: DataFrame, kind: str, key: F.Column, action: str, day: F.Column, when: F.Column) -> DataFrame:
        return source.where(when).select(F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"), (DAY0 + day * DAY).alias("ts"))

    c, h = F.col("c"), F.col("h")
    even = c % 2 == 0
    entries = (
        entry(hosts, "host", h, "add", c % 180, even)
        .union(entry(hosts, "host", h, "remove", c % 180 + 30 + c % 90, even))
        .union(entry(hosts, "host", h, "add", c % 180 + 200, even & (c % 3 == 0)))
        .union(entry(hosts, "prefix", F.concat(h, F.lit("/en/")), "add", c % 120, ~even))
        .union(entry(parents, "domain", h, "add", c % 250, F.lit(True)))
        .union(entry(parents, "domain", h, "remove", c % 250 + 20, F.lit(True)))
    )
    return filter_urls(captures, entries).select("page_id", "url", "fetched_at", "n_rules", "blocked")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = crf_quality.fit(crf_quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return crf_quality.score(docs, model).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(id_column(), "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds is null (the operator has it as a decimal)."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, distance=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontaminate": op2_decontaminate,
    "op3_jaccard": op3_jaccard,
    "op4_langid": op4_langid,
    "op5_topk": op5_topk,
    "op6_superkmers": op6_superkmers,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op9_crf_quality": op9_crf_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_simhash": op13_simhash,
}

#: SQL for the operators it can express.  Classifiers, fitted rates and archives are tested
#: against plain Python, as is every case the tables do not hold (null and repeated ids).
ORACLE: dict[str, str] = {
    "op2_decontaminate": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select coalesce(cast(item_id as varchar), 'null') as item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), phrases as (
  select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + 9], ' ') as s
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), sizes as (
  select distinct size from phrases
), hits as (
  select doc_id, i, size, item
  from (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as s
        from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes))
  join phrases using (size, s)
), covered as (
  select doc_id, count(distinct i + j) as n_hit from hits, range(10) r(j) where j < size group by doc_id
), items as (
  select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as s from hits group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
""",
    "op3_jaccard": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)
), named as (
  select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as name from shingles group by doc_id
), classes as (
  select name, min(doc_id) as c, any_value(n) as n from named group by name
), own as (
  select c, n, s from classes join shingles on doc_id = c
), links as (
  select a.c as a, b.c as b from own a join own b on a.s = b.s and a.c < b.c
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach as (
  select c as a, c as b from classes
  union select reach.a, e.b from reach join (select a, b from links union all select b, a from links) e on reach.b = e.a
), roots as (
  select a as c, min(b) as root from reach group by a
)
select d.doc_id, cast(coalesce(named.n, 0) as bigint) as n_shingles, coalesce(root, d.doc_id) as component_id
from d left join named using (doc_id) left join classes using (name) left join roots using (c)
""",
    "op6_superkmers": r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as name from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)
), later as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by name order by doc_id, i) as place from windows) where place > 1
), gone as (
  select distinct doc_id, i + j as nth from later, range(20) r(j)
), kept as (
  select doc_id, count(*) as n, string_agg(x, ' ' order by nth) as s
  from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as nth from d) anti join gone using (doc_id, nth) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (doc_id)
""",
    "op8_warc": """
with p as (
  select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as least from pages
), digits as (
  select *, list_transform(range(32), lambda k: (cast('0x' || substr(h, cast(k // 4 * 5 + 1 as integer), 5) as bigint) >> cast(15 - k % 4 * 5 as integer)) & 31) as v from p
)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(k + 1 as integer), 1)), '') as payload_digest,
       case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to
from digits
""",
    "op10_suffix_dedup": r"""
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), bytes as (
  select doc_id, i, substr(h, 2 * i - 1, 2) as x, case when 2 * i + 398 <= length(h) then md5_number(substr(h, 2 * i - 1, 400)) end as name
  from (select doc_id, h, unnest(range(1, length(h) // 2 + 1)) as i from d)
), counted as (
  select doc_id, i, x, name is not null and count(*) over (partition by name) > 1 as again from bytes
), marked as (
  select doc_id, i, x, coalesce(max(again) over (partition by doc_id order by i rows between 199 preceding and current row), false) as gone from counted
), runs as (
  select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as begins from marked
), sums as (
  select doc_id, count(*) as n, count(*) filter (gone) as n_gone, count(*) filter (begins) as n_runs, string_agg(x, '' order by i) filter (not gone) as kept from runs group by doc_id
)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_bytes, cast(coalesce(n_gone, 0) as bigint) as n_removed, cast(coalesce(n_runs, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join sums using (doc_id)
""",
    "op7_url_filter": r"""
with p as (
  select page_id, url, 1704067200 + (page_id * 7919) % 31536000 as fetched_at,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) as host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) as path
  from pages
), hosts as (
  select h, cast(ascii(h) * 31 + length(h) * 7 + ascii(substring(h, 2, 1)) as bigint) as c
  from (select distinct host as h from p where host <> '')
), parents as (
  select h, cast(ascii(h) * 31 + length(h) * 7 + ascii(substring(h, 2, 1)) as bigint) as c
  from (select distinct regexp_replace(h, '^[^.]*\.', '') as h from hosts) where h <> ''
), e as (
  select 'host' as kind, h as k, true as adds, c % 180 as day from hosts where c % 2 = 0
  union all select 'host', h, false, c % 180 + 30 + c % 90 from hosts where c % 2 = 0
  union all select 'host', h, true, c % 180 + 200 from hosts where c % 2 = 0 and c % 3 = 0
  union all select 'prefix', h || '/en/', true, c % 120 from hosts where c % 2 <> 0
  union all select 'domain', h, true, c % 250 from parents
  union all select 'domain', h, false, c % 250 + 20 from parents
), one as (
  select kind, k, day, bool_and(adds) as adds from e group by kind, k, day
), spells as (
  select kind, k, adds, 1704067200 + day * 86400 as since,
         lead(1704067200 + day * 86400) over (partition by kind, k order by day) as until
  from one
), hits as (
  select p.page_id, count(distinct (s.kind, s.k)) as n
  from p join spells s on s.adds and p.fetched_at >= s.since and (s.until is null or p.fetched_at < s.until)
   and ((s.kind = 'host' and p.host = s.k) or (s.kind = 'domain' and (p.host = s.k or ends_with(p.host, '.' || s.k)))
        or (s.kind = 'prefix' and starts_with(p.host || p.path, s.k)))
  where p.host <> '' group by p.page_id
)
select p.page_id, p.url, cast(p.fetched_at as bigint) as fetched_at, cast(coalesce(n, 0) as bigint) as n_rules, coalesce(n, 0) > 0 as blocked
from p left join hits using (page_id)
""",
    "op5_topk": """
with e as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r, q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
  from e q join e c on q.r <> c.r where q.vec_id % 20 = 0
), r as (
  select query_id, cast(row_number() over (partition by r order by score desc, vec_id nulls last) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 20
""",
    "op12_filter_audit": r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), told as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id
), facts as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
         || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end
         || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
         || case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end as failed
  from d left join told using (doc_id)
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as x
), orders as (
  select a.x || b.x || c.x || e.x || f.x as filter_order from letters a, letters b, letters c, letters e, letters f
  where len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5
), cells as (
  select part, failed, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from facts group by all
), long as (
  select *, filter_order[step] as own, contains(failed, own) as fails, len(list_filter(range(1, step), lambda k: contains(failed, filter_order[k]))) > 0 as gone
  from cells, orders, range(1, 6) s(step)
), counted as (
  select part, filter_order, cast(step as integer) as step, own,
         cast(coalesce(sum(n) filter (not gone and not fails), 0) as bigint) as kept, cast(coalesce(sum(n) filter (not gone and fails), 0) as bigint) as removed,
         cast(coalesce(sum(n) filter (gone and fails), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (failed = own), 0) as bigint) as unique_fails,
         cast(coalesce(sum(good) filter (not gone and fails), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (not gone and fails), 0) as bigint) as toxic_lost
  from long group by part, filter_order, step, own
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from counted
""",
    # XXH64 (seed 42) of every distinct shingle in 128-bit numbers: its bytes as numbers of eight (lanes),
    # the four running sums of 32-byte stripes, the lanes after them, then bytes and the final mix
    "op13_simhash": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select doc_id, array_to_string(w[i:i + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)
), k as (
  select 18446744073709551616::uhugeint as m, 11400714785074694791::uhugeint as p1, 14029467366897019727::uhugeint as p2, 1609587929392839161::uhugeint as p3,
         9650029242287828579::uhugeint as p4, 2870177450012600261::uhugeint as p5, 42::uhugeint as seed
), spelt as (
  select s, n, list_transform(range(n), lambda i: ('0x' || substr(h, cast(2 * i + 1 as integer), 2))::uhugeint) as b from (select s, strlen(s) as n, hex(encode(s)) as h from (select distinct s from shingles))
), lanes as (
  select s, n, b, n // 32 * 4 as striped, n // 8 as whole,
         list_transform(range(n // 8), lambda j: b[8 * j + 1] + b[8 * j + 2] * 256 + b[8 * j + 3] * 65536 + b[8 * j + 4] * 16777216
           + (b[8 * j + 5] + b[8 * j + 6] * 256 + b[8 * j + 7] * 65536 + b[8 * j + 8] * 16777216) * 4294967296) as l
  from spelt
), stripes as (
  select s, n, b, striped, whole, l,
         list_transform([(seed + p1 + p2) % m, (seed + p2) % m, seed, (m + seed - p1) % m], lambda v0, j: list_reduce(
           list_filter(l[1:striped], lambda x, i: i % 4 = j % 4),
           lambda acc, x: ((((acc + x * p2 % m) % m * 2147483648) % m + (acc + x * p2 % m) % m // 8589934592) * p1) % m, v0)) as v
  from lanes, k
), merged as (
  select s, n, b, striped, whole, l, case when n < 32 then (seed + p5) % m else list_reduce(v,
           lambda acc, x: (xor(acc, (((x * p2 % m * 2147483648) % m + x * p2 % m // 8589934592) * p1) % m) * p1 + p4) % m,
           (v[1] * 2 % m + v[1] // 9223372036854775808 + v[2] * 128 % m + v[2] // 144115188075855872 + v[3] * 4096 % m + v[3] // 4503599627370496 + v[4] * 262144 % m + v[4] // 70368744177664) % m) end as h
  from stripes, k
), eights as (
  select s, n, b, whole, list_reduce(l[striped + 1:],
           lambda acc, x: ((xor(acc, (((x * p2 % m * 2147483648) % m + x * p2 % m // 8589934592) * p1) % m) * 134217728 % m
                            + xor(acc, (((x * p2 % m * 2147483648) % m + x * p2 % m // 8589934592) * p1) % m) // 137438953472) * p1 + p4) % m, (h + cast(n as uhugeint)) % m) as h
  from merged, k
), fours as (
  select s, n, b, whole * 8 + case when n - whole * 8 >= 4 then 4 else 0 end as done, case when n - whole * 8 < 4 then h else
           (xor(h, f * p1 % m) * 8388608 % m + xor(h, f * p1 % m) // 2199023255552) * p2 % m + p3 end % m as h
  from (select *, case when n - whole * 8 >= 4 then b[whole * 8 + 1] + b[whole * 8 + 2] * 256 + b[whole * 8 + 3] * 65536 + b[whole * 8 + 4] * 16777216 end as f from eights), k
), ones as (
  select s, list_reduce(b[done + 1:], lambda acc, x: (xor(acc, x * p5 % m) * 2048 % m + xor(acc, x * p5 % m) // 9007199254740992) * p1 % m, h) as h from fours, k
), mixed as (
  select s, xor(h, h // 8589934592) * p2 % m as h from ones, k
), again as (
  select s, xor(h, h // 536870912) * p3 % m as h from mixed, k
), hashed as (
  select s, cast(xor(h, h // 4294967296) as ubigint) as h from again
), bits as (
  select doc_id, bit, 2 * sum(h >> cast(bit as ubigint) & 1) > count(*) as one
  from shingles join hashed using (s), range(64) r(bit) group by doc_id, bit
), prints as (
  select d.doc_id, coalesce(f, 0::ubigint) as f
  from d left join (select doc_id, bit_or(case when one then 1::ubigint << cast(bit as ubigint) else 0::ubigint end) as f from bits group by doc_id) using (doc_id)
), classes as (
  select f, min(doc_id) as c from prints group by f
), links as (
  select a.f as a, b.f as b from classes a join classes b on a.f <> b.f and bit_count(xor(a.f, b.f)) <= 2
), reach as (
  select f as a, f as b from classes union select reach.a, links.b from reach join links on reach.b = links.a
), roots as (
  select a as f, min(c) as component_id from reach join classes on f = b group by a
)
select doc_id, lower(lpad(hex(f), 16, '0')) as fingerprint, component_id from prints join roots using (f)
""",
}
