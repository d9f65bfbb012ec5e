"""Registered queries of the transfer engine and their DuckDB equivalents.

All read the whole `events` table through the derivation in `sources.fixture`.  Cadences are
5 / 20 / 100 / 500 moves, so that every window ticks on the test tables; `win_ticks_default` has
the engine's own.  Graph queries write the flattened transfers once and read them from there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import encoding as E
from tidewell.operators import chain, dictionary, graph
from tidewell.plans import windows
from tidewell.sources import fixture, generator, messages, offsets
from tidewell.sources.store import scratch, stored
from tidewell.streaming import sinks
from tidewell.streaming.ids import EventLog

CADENCE = (5, 20, 100, 500)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BASE = """
with ev as (
  select event_id, ts as moment, cast(floor(epoch(ts) / 600) * 600 as bigint) as ts, user_id, value, event_type,
         cast(json_extract_string(props, '$.k') as bigint) as k from events
), b as (
  select cast(row_number() over (order by ts) as bigint) as number, ts, n_tx,
         cast(sum(n_tx) over (order by ts rows unbounded preceding) as bigint) as head
  from (select ts, count(*) as n_tx from ev group by ts)
), blocks as (
  select number, ts, n_tx, head, head - n_tx as rel,
         '0x' || sha256(unhex(lpad(to_hex(number), 16, '0') || lpad(to_hex(ts), 16, '0'))) as hash from b
), tx as (
  select ev.ts, number, rel + row_number() over (partition by ev.ts order by moment, event_id) - 1 as idx,
         lpad(lower(to_hex(user_id)), 40, '0') as src, lpad(lower(to_hex(k)), 40, '0') as dst,
         event_type as tok, cast(round(value * 100) as bigint) as amount, event_id as nonce
  from ev join blocks on ev.ts = blocks.ts
), mv as (
  select number, ts, head,
         min(rel) over (order by ts range between 60 preceding and current row) as t0,
         min(rel) over (order by ts range between 300 preceding and current row) as t1,
         min(rel) over (order by ts range between 3600 preceding and current row) as t2,
         min(rel) over (order by ts range between 86400 preceding and current row) as t3,
         min(number) over (order by ts range between 86400 preceding and current row) > 1 as open_win
  from blocks
), moves as (
  select number, ts, 0 as win_idx, head, t0 as tail, open_win from mv union all select number, ts, 1, head, t1, open_win from mv
  union all select number, ts, 2, head, t2, open_win from mv union all select number, ts, 3, head, t3, open_win from mv
), gated as (
  select *, row_number() over (partition by win_idx order by number) as place
  from moves where number >= (select min(number) from mv where open_win)
), ticks as (
  select number, win_idx, head, tail, open_win from gated
  where place % case win_idx when 0 then 5 when 1 then 20 when 2 then 100 else 500 end = 0
), addr as (
  select a, row_number() over (order by min(f)) as id
  from (select src as a, idx * 2 as f from tx union all select dst, idx * 2 + 1 from tx) group by a
), toks as (
  select tok, cast(row_number() over (order by min(idx)) as integer) as id from tx group by tok
), enc as (
  select idx, ts, s.id as from_id, d.id as to_id, toks.id as token_id, amount
  from tx join addr s on s.a = src join addr d on d.a = dst join toks on toks.tok = tx.tok
), wev as (
  select win_idx, head, tail, enc.* from ticks join enc on idx >= tail and idx < head
)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL that may use the tables of BASE."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = BASE + sql if not sql.lstrip().startswith("--alone") else sql
        return f

    return add


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return fixture.blocks(spark, d)


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.flatten(_blocks(spark, d), fixture.transfers(spark, d))


def _chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks and encoded events; blocks and flattened transfers are written once."""
    blocks = stored(_blocks(spark, d))
    flat = stored(dictionary.flatten(blocks, fixture.transfers(spark, d)))
    return blocks, dictionary.encoded(flat, *dictionary.dictionaries(flat))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d)[1]


def _windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ticks and encoded events."""
    blocks, events = _chain(spark, d)
    return windows.ticks(blocks, CADENCE), events


def _ticks(spark: SparkSession, d: str) -> DataFrame:
    return windows.ticks(stored(_blocks(spark, d)), CADENCE)


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    """The chain's second half, with a hole at every seventh height."""
    blocks = stored(_blocks(spark, d))
    top = blocks.agg(F.max("number").alias("top"))
    return stored(blocks.join(F.broadcast(top)).where("number > top div 2 and number % 7 <> 3").drop("top"))


@query("select number as head_num, hash as head_hash, ts as head_timestamp, false as empty from blocks order by number desc limit 1")
def chain_head(spark, d):
    return chain.head(_blocks(spark, d))


@query("select number, ts, n_tx, hash from blocks where number = 100")
def block_by_number(spark, d):
    return chain.by_number(_blocks(spark, d), 100).select("number", "ts", "n_tx", "hash")


@query("select number, ts, n_tx, hash from blocks where hash = (select hash from blocks where number = 42)")
def block_by_hash(spark, d):
    import hashlib

    blocks = stored(_blocks(spark, d))
    ts = chain.by_number(blocks, 42).first()["ts"]
    text = "  0x" + hashlib.sha256((42).to_bytes(8, "big") + ts.to_bytes(8, "big")).hexdigest().upper()
    return chain.by_hash(blocks, text).select("number", "ts", "n_tx", "hash")


@query("select number as block_num, hash as block_hash, ts as block_timestamp from blocks where ts >= 1705000000 order by number limit 1")
def block_lower_bound(spark, d):
    return chain.at_or_after(_blocks(spark, d), 1_705_000_000)


@query("select number, ts, n_tx, hash from blocks where number between 50 and 250")
def block_range(spark, d):
    return chain.block_range(_blocks(spark, d), 50, 250).select("number", "ts", "n_tx", "hash")


@query('select cast(50 as bigint) as "from", cast(250 as bigint) as "to", cast(50 as bigint) as n, true as partial, cast(99 as bigint) as last_ok')
def block_range_partial(spark, d):
    return chain.range_status(_blocks(spark, d).where("number <> 100"), 50, 250)


@query("select number, ts from blocks where number >= 200 and number < 300")
def block_contiguous(spark, d):
    return chain.contiguous(_blocks(spark, d).where("number <> 300"), 200).select("number", "ts")


@query(", g as (select number, lag(ts) over (order by number) as start_ts, ts as end_ts from blocks) select number, start_ts, end_ts, end_ts - start_ts as seconds from g where end_ts - start_ts > 600")
def block_gaps(spark, d):
    return chain.gaps(_blocks(spark, d), 600)


@query(", g as (select number, ts - lag(ts) over (order by number) as s from blocks) select min(number) as number from g where s > 600 and number > 100 having min(number) is not null")
def first_gap_after(spark, d):
    return chain.first_gap_after(_blocks(spark, d), 100, 600)


DECISION = """
, g as (select number as n, ts, ts - lag(ts) over (order by number) as s from blocks), x as (
  select max(n) as hn, max(ts) as hts, min(case when ts >= {target} then n end) as pos, min(case when ts >= {target} then ts end) as pts,
         min(case when ts >= {target} and s > {gap} then n end) as gh from g)
select case when hn is null then 'REBUILD' when hts < {target} then 'KEEP_ALL_CATCH_UP'
            when pts > {target} + {gap} then case when pos = 1 then 'REBUILD' else 'TRIM_AFTER_KEEP' end
            when gh is not null then 'TRIM_AFTER_KEEP' else 'KEEP_ALL_CATCH_UP' end as action,
       case when hn is null then 0 when hts < {target} then hn when pts > {target} + {gap} then pos - 1
            when gh is not null then gh - 1 else hn end as keep from x"""


@query(DECISION.format(target=1_706_572_800 - 86_400 * 20, gap=1800))
def tail_decision(spark, d):
    return chain.tail_decision(_blocks(spark, d), 1_706_572_800, 86_400 * 20, 1800)


@query(DECISION.format(target=1_706_572_800 - 86_400 * 400, gap=1800))
def tail_decision_rebuild(spark, d):
    return chain.tail_decision(_blocks(spark, d), 1_706_572_800, 86_400 * 400, 1800)


@query(DECISION.format(target=1_706_572_800 - 40_000, gap=100_000))
def tail_decision_keep(spark, d):
    return chain.tail_decision(_blocks(spark, d), 1_706_572_800, 40_000, 100_000)


@query("select min(number) as start, 'backfill' as mode from blocks where ts >= (select max(ts) from blocks) - 86400")
def start_height_decision(spark, d):
    return chain.start_height(_blocks(spark, d), 86_400, (7, "0x00"))


@query("select max(number) as start, 'head' as mode from blocks")
def start_height_tail_only(spark, d):
    return chain.start_height(_blocks(spark, d), -1)


@query("select cast(43 as bigint) as start, 'resume' as mode")
def start_height_resume(spark, d):
    """The checkpoint's hash, read from the table, is written in upper case and without prefix."""
    blocks = _blocks(spark, d)
    text = chain.by_number(blocks, 42).first()["hash"][2:].upper()
    return chain.start_height(blocks, 86_400, (42, text))


@query("select number, n_tx from blocks")
def tx_per_block(spark, d):
    return _flat(spark, d).groupBy("number").agg(F.count("*").alias("n_tx"))


@query(", ck as (select number, case when number % 3 = 0 then hash else upper(substr(hash, 3)) || '0' end as claimed from blocks) select number from ck where number % 3 = 0")
def checkpoint_validation(spark, d):
    """Which of many checkpoints (height, hash) agree with the chain."""
    blocks = _blocks(spark, d)
    claims = blocks.select("number", F.when(F.col("number") % 3 == 0, F.upper(F.substring("hash", 3, 64))).otherwise(F.concat(F.upper(F.substring("hash", 3, 64)), F.lit("0"))).alias("claimed"))
    return claims.join(blocks.select("number", "hash"), "number").where(E.equal_hex(F.col("claimed"), F.col("hash"))).select("number")


HALVES = ", h as (select max(number) // 2 as half, max(number) // 4 as quarter from blocks)"


def _halves(spark, d):
    """The chain's first half, and all after its first quarter with other times."""
    blocks = stored(_blocks(spark, d))
    both = blocks.join(F.broadcast(blocks.agg(F.expr("max(number) div 2").alias("half"), F.expr("max(number) div 4").alias("quarter"))))
    old, new = both.where("number <= half"), both.where("number > quarter")
    return old.select("number", "ts"), new.select("number", (F.col("ts") + F.col("number") % 5 * 200).alias("ts"))


@query(HALVES + " select number, ts + case when number > half then number % 5 * 200 else 0 end as ts from blocks, h")
def append_replayed(spark, d):
    """The heights after the first quarter arrive again; the first block of a height stays."""
    return chain.append(*_halves(spark, d))


APPENDED = HALVES + """, a as (select number, ts + case when number > half then number % 5 * 200 else 0 end as ts, number > half as fresh from blocks, h)
, g as (select number, ts, fresh, ts - lag(ts) over (order by number) as s from a)"""


@query(APPENDED + " select ts as end_ts, number from g where fresh and s > 700")
def append_gap_events(spark, d):
    """What the append adds to the gap index."""
    return chain.gap_events(*_halves(spark, d), 700)


@query(APPENDED + " select ts as end_ts, number from g where fresh and s > 700 and ts >= 1706400000 order by ts limit 1")
def gap_seek(spark, d):
    """The first indexed gap from a time on; the index also holds entries the chain no longer has."""
    old, new = _halves(spark, d)
    index = chain.gap_events(old, new, 700)
    stale = index.select((F.col("end_ts") - 1).alias("end_ts"), "number")
    return chain.seek_gap(index.union(stale), stored(chain.append(old, new)), 1_706_400_000, 700)


@query(HALVES + " select number, ts + case when number <= half then 0 when number % 4 = 1 then 300 else number % 5 * 200 end as ts from blocks, h")
def append_repeats(spark, d):
    """Every height of the batch comes three times in it; the first by offset stays."""
    old, new = _halves(spark, d)
    copies = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k * 300).alias("late")) for k in range(3)]))
    sent = new.select("number", "ts", copies.alias("c")).select("number", F.when(F.col("number") % 4 == 1, F.col("ts") - F.col("number") % 5 * 200 + F.col("c.late")).otherwise(F.col("ts") + F.col("c.late")).alias("ts"), "c.k")
    offset = F.when(F.col("number") % 4 == 1, F.col("number") + F.abs(F.col("k") - 1) * 1_000_000).otherwise(F.col("number") + F.col("k") * 1_000_000)
    return chain.append(old, sent.select("number", "ts", offset.alias("offset")))


@query("select number from blocks where number % 10 = 0")
def broken_links(spark, d):
    """Heights whose parent hash is not that of the block before; every tenth is made wrong."""
    blocks = _blocks(spark, d)
    parents = blocks.select((F.col("number") + 1).alias("number"), F.col("hash").alias("p"))
    linked = blocks.join(parents, "number", "left").withColumn("parent_hash", F.when(F.col("number") % 10 == 0, F.lit("0x")).otherwise(F.col("p")))
    return chain.linked(linked)


@query("select from_id, to_id, count(*) as n, min(idx) as first_idx, max(idx) as last_idx from enc group by 1, 2")
def edge_totals(spark, d):
    return _events(spark, d).groupBy("from_id", "to_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("select number, ts, n_tx from blocks where n_tx > 0 and ts >= 1704067200")
def block_messages(spark, d):
    """Blocks as JSON messages and back, among messages that are no blocks."""
    listed = _flat(spark, d).groupBy("number", "ts").agg(
        F.collect_list(F.struct(F.lit(None).cast("string").alias("hash"), F.struct(F.col("sender").alias("from"), F.col("receiver").alias("to"), "token", "amount", F.col("ts").alias("timestamp")).alias("tx_body"), F.col("number").alias("block_num"))).alias("txs")
    )
    header = F.struct("number", F.lit("").alias("parent_hash"), F.col("ts").alias("timestamp"), F.lit("").alias("tx_root"))
    sent = messages.encode(listed.select(header.alias("header"), F.lit("").alias("hash"), "txs")).select(F.col("key").cast("long").alias("offset"), "value")
    noise = sent.select("offset", F.concat(F.lit("{"), "value").alias("value")).where("offset % 4 = 0")
    return messages.block_rows(messages.decode(sent.union(noise))).select("number", "ts", "n_tx")


@query("select number, ts, n_tx from blocks where number <= 120")
def truncate_after(spark, d):
    return chain.truncate_after(_blocks(spark, d), 120).select("number", "ts", "n_tx")


@query("select number, ts, n_tx from blocks where ts >= 1706572800 - 86400")
def replay_24h(spark, d):
    return chain.replay_since(_blocks(spark, d), 1_706_572_800).select("number", "ts", "n_tx")


@query("select h.number + 1 + i as number, h.ts + 600 + i * 600 as ts from (select max(number) as number, max(ts) as ts from blocks) h, range(100) r(i) where h.ts + 600 + i * 600 + 600 < 1706700000")
def warm_up_schedule(spark, d):
    return chain.warm_up(_blocks(spark, d), 1_706_700_000, 86_400 * 40, 600)


@query("select b.number, a.hash as parent_hash from blocks b left join blocks a on a.number = b.number - 1")
def parent_lookup(spark, d):
    b = _blocks(spark, d)
    parents = b.select((F.col("number") + 1).alias("number"), F.col("hash").alias("parent_hash"))
    return b.select("number").join(parents, "number", "left")


@query("select idx, number, ts, '0x' || src as sender, '0x' || dst as receiver, tok as token, amount from tx")
def tx_flatten(spark, d):
    return _flat(spark, d).select("idx", "number", "ts", "sender", "receiver", "token", "amount")


MESSY = """
, messy as (select idx, case idx % 7 when 0 then upper(src) when 1 then '0X' || src when 2 then ' 0x' || src || chr(10) when 3 then '0x' || substr(src, 2) else '0x' || src end as s,
  case idx % 11 when 0 then '0x' || dst || '0' when 1 then replace(dst, '0', 'g') else dst end as t from tx)
, ok as (select idx, regexp_replace(s, '^\\s+|\\s+$', '', 'g') as s, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as t from messy)
"""
VALID = "regexp_full_match({0}, '(0[xX])?[0-9a-fA-F]{{40}}')"


def _messy(spark, d):
    """Transfers with prefixes, upper case, white space, and addresses too short, too long or not hex."""
    src, dst = F.substring("sender", 3, 40), F.substring("receiver", 3, 40)
    k, m = F.col("idx") % 7, F.col("idx") % 11
    s = F.when(k == 0, F.upper(src)).when(k == 1, F.concat(F.lit("0X"), src)).when(k == 2, F.concat(F.lit(" 0x"), src, F.lit("\n"))).when(k == 3, F.concat(F.lit("0x"), F.substring("sender", 4, 39))).otherwise(F.concat(F.lit("0x"), src))
    t = F.when(m == 0, F.concat(F.lit("0x"), dst, F.lit("0"))).when(m == 1, F.replace(dst, F.lit("0"), F.lit("g"))).otherwise(dst)
    return _flat(spark, d).withColumns({"sender": s, "receiver": t})


@query(MESSY + f"select idx, lower(right(s, 40)) as src, lower(right(t, 40)) as dst from ok where {VALID.format('s')} and {VALID.format('t')}")
def addr_filter(spark, d):
    return dictionary.clean(_messy(spark, d)).select("idx", "src", "dst")


@query(MESSY + f", seen as (select lower(right(s, 40)) as addr, idx * 2 as f from ok where {VALID.format('s')} union all select lower(right(t, 40)), idx * 2 + 1 from ok where {VALID.format('s')} and {VALID.format('t')}) select addr, row_number() over (order by min(f)) as id from seen group by addr")
def addr_ids_messy(spark, d):
    return dictionary.address_ids(_messy(spark, d))


@query("select a as addr, id from addr")
def addr_ids(spark, d):
    return dictionary.address_ids(_flat(spark, d))


@query("select tok, id from toks")
def token_ids(spark, d):
    return dictionary.token_ids(_flat(spark, d))


@query("select * from enc")
def encoded_events(spark, d):
    return _events(spark, d)


@query("select idx, '0x' || src as sender, '0x' || dst as receiver, tok as token from tx")
def decoded_events(spark, d):
    flat = stored(_flat(spark, d))
    a, t = dictionary.dictionaries(flat)
    return dictionary.decoded(dictionary.encoded(flat, a, t), a, t).select("idx", "sender", "receiver", "token")


@query("select idx, (from_id << 32) | to_id as edge from enc")
def edge_keys(spark, d):
    return _events(spark, d).select("idx", dictionary.edge_key().alias("edge"))


TX_HASH = "sha256(unhex(lpad(to_hex(42), 16, '0') || hex('0x' || src) || lpad(to_hex(42), 16, '0') || hex('0x' || dst) || lpad(to_hex(length(tok)), 16, '0') || hex(tok) || lpad(to_hex(amount), 16, '0') || lpad(to_hex(tx.ts), 16, '0') || lpad(to_hex(nonce), 16, '0')))"


def _hashed(spark, d):
    return _flat(spark, d).withColumn("h", E.tx_hash(F.col("sender"), F.col("receiver"), F.col("token"), F.col("amount"), F.col("ts"), F.col("nonce")))


@query(f"select idx, {TX_HASH} as tx_hash from tx")
def tx_hash(spark, d):
    return _hashed(spark, d).select("idx", F.col("h").alias("tx_hash"))


def _roots(spark, d):
    listed = _hashed(spark, d).groupBy("number", "ts").agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("l"))
    return listed.select("number", "ts", E.tx_root(F.transform("l", lambda x: x["h"])).alias("tx_root"))


ROOTS = f", roots as (select number, tx.ts, sha256(unhex(string_agg({TX_HASH}, '' order by idx))) as tx_root from tx group by number, tx.ts)"


@query(ROOTS + " select number, tx_root from roots")
def tx_root(spark, d):
    return _roots(spark, d).select("number", "tx_root")


@query(ROOTS + " select number, sha256(unhex(lpad(to_hex(number), 16, '0') || lpad(to_hex(ts), 16, '0') || repeat('0', 64) || tx_root || lpad(to_hex(number), 16, '0'))) as header_hash from roots")
def header_hash(spark, d):
    return _roots(spark, d).select("number", E.header_hash(F.col("number"), F.col("ts"), F.repeat(F.lit("0"), 64), F.col("tx_root"), F.col("number")).alias("header_hash"))


@query("select number, sha256(unhex(lpad(to_hex(number), 16, '0') || lpad(to_hex(length(hash)), 8, '0') || hex(hash) || lpad(to_hex(32), 8, '0') || substr(hash, 3) || case when n_tx % 2 = 0 then '01' else '00' end)) as key from blocks")
def key_builder(spark, d):
    parts = F.concat(E.be64(F.col("number")), E.put_string(F.col("hash")), E.put_hex(F.col("hash")), E.put_bool(F.col("n_tx") % 2 == 0))
    return _blocks(spark, d).select("number", E.sha256_hex(parts).alias("key"))


@query("select number, case when number % 5 = 0 then null else substr(hash, 3) end as digits from blocks")
def hash_parse(spark, d):
    text = F.when(F.col("number") % 5 == 0, F.substring("hash", 1, 20)).when(F.col("number") % 5 == 1, F.upper("hash")).otherwise(F.concat(F.lit(" "), "hash"))
    return _blocks(spark, d).select("number", F.lower(F.hex(E.parse_hash32(text))).alias("digits"))


@query("""select number, case when number % 3 = 0 then null else hash end as text,
 case when number % 4 = 0 then '0x' || repeat('0', 64) when number % 4 = 1 then null else hash end as or_zero,
 case when number % 4 = 0 then true when number % 4 = 1 then null else false end as is_zero from blocks""")
def hash_text(spark, d):
    """32 bytes as text (other lengths are none), and null, broken and whole texts with zero for null."""
    raw = F.unhex(F.substring("hash", 3, 64))
    cut = F.when(F.col("number") % 3 == 0, F.substring(raw, 1, 31)).otherwise(raw)
    given = F.when(F.col("number") % 4 == 1, F.substring("hash", 1, 9)).when(F.col("number") % 4 != 0, F.col("hash"))
    found = E.hash32_or_zero(given)
    return _blocks(spark, d).select("number", E.to_hex32(cut).alias("text"), E.to_hex32(found).alias("or_zero"), E.is_zero(found).alias("is_zero"))


@query("select number, case when number % 5 = 0 then null else number * 1000003 - ts * 7 end as value, (ts % 256) << 56 | number as wide from blocks where ts % 256 < 128 union all select number, case when number % 5 = 0 then null else number * 1000003 - ts * 7 end, -(((255 - ts % 256) << 56 | (72057594037927935 - number)) + 1) from blocks where ts % 256 >= 128")
def be64_round_trip(spark, d):
    """Eight big-endian bytes back to numbers, negative ones too; fewer bytes are none."""
    digits = E.be64(F.col("number") * 1_000_003 - F.col("ts") * 7)
    wide = F.concat(F.lpad(F.hex(F.col("ts") % 256), 2, "0"), F.lpad(F.hex("number"), 14, "0"))
    short = F.when(F.col("number") % 5 == 0, F.substring(digits, 1, 14)).otherwise(digits)
    return _blocks(spark, d).select("number", E.be64_value(short).alias("value"), E.be64_value(wide).alias("wide"))


@query("""select a as addr, cast(list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(range(20), lambda i: cast('0x' || substr(a, cast(i as integer) * 2 + 1, 2) as bigint))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 64 as integer) as shard from addr""")
def address_shard(spark, d):
    """The dictionary shard of every address, by the FNV-1a hash of its bytes."""
    return dictionary.address_ids(_flat(spark, d)).select("addr", E.shard(F.col("addr"), 64).alias("shard"))


@query("select number, ts, cast(win_idx as integer) as win_idx, head, tail, open_win from moves")
def window_moves(spark, d):
    return windows.moves(stored(_blocks(spark, d))).drop("at")


@query("select min(number) as open_at from mv where open_win")
def window_gate(spark, d):
    return windows.gate(_blocks(spark, d))


@query("select number, cast(win_idx as integer) as win_idx, head, tail, open_win from ticks")
def win_ticks(spark, d):
    return _ticks(spark, d)


@query("select number, cast(win_idx as integer) as win_idx, head, tail, open_win from gated where place % case win_idx when 0 then 50 when 1 then 200 when 2 then 1000 else 5000 end = 0")
def win_ticks_default(spark, d):
    return windows.ticks(stored(_blocks(spark, d)))


REPLAY = """
, rb as (select number, ts, row_number() over (order by ts) as nth, cast(sum(n_tx) over (order by ts rows unbounded preceding) as bigint) as head, n_tx
  from blocks where number > (select max(number) // 2 from blocks) and number % 7 <> 3
), rmv as (
  select number, ts, nth, head,
         min(head - n_tx) over (order by ts range between 60 preceding and current row) as t0,
         min(head - n_tx) over (order by ts range between 300 preceding and current row) as t1,
         min(head - n_tx) over (order by ts range between 3600 preceding and current row) as t2,
         min(head - n_tx) over (order by ts range between 86400 preceding and current row) as t3,
         min(nth) over (order by ts range between 86400 preceding and current row) > 1 as open_win from rb
), rmoves as (
  select number, nth, 0 as win_idx, head, t0 as tail, open_win from rmv union all select number, nth, 1, head, t1, open_win from rmv
  union all select number, nth, 2, head, t2, open_win from rmv union all select number, nth, 3, head, t3, open_win from rmv
)"""


@query(REPLAY + """ select number, cast(win_idx as integer) as win_idx, head, tail, open_win from
 (select *, row_number() over (partition by win_idx order by nth) as place from rmoves where nth >= (select min(nth) from rmv where open_win))
 where place % case win_idx when 0 then 5 when 1 then 20 when 2 then 100 else 500 end = 0""")
def win_ticks_replay(spark, d):
    """Ticks of a replay that begins in the middle of the chain and lacks heights."""
    return windows.ticks(_replayed(spark, d), CADENCE)


@query(REPLAY + " select min(number) as open_at from rmv where open_win")
def window_gate_replay(spark, d):
    return windows.gate(_replayed(spark, d))


@query(REPLAY + " select number, cast(win_idx as integer) as win_idx, head, tail, open_win from rmoves")
def window_moves_replay(spark, d):
    return windows.moves(_replayed(spark, d)).drop("ts", "at")


UNEVEN = """
, ub as (select number, ts - case when number % 7 = 0 then 4000 when number % 7 = 1 then 600 else 0 end as ts, n_tx from blocks)
, ur as (select number, max(ts) over (order by number) as latest, cast(sum(n_tx) over (order by number) as bigint) as head, n_tx, first(ts) over (order by number) as begin from ub)
, umv as (select number, head, latest > begin + 86400 as open_win,
  min(head - n_tx) over (order by latest range between 60 preceding and current row) as t0, min(head - n_tx) over (order by latest range between 300 preceding and current row) as t1,
  min(head - n_tx) over (order by latest range between 3600 preceding and current row) as t2, min(head - n_tx) over (order by latest range between 86400 preceding and current row) as t3 from ur)
, umoves as (select number, 0 as win_idx, head, t0 as tail, open_win from umv union all select number, 1, head, t1, open_win from umv
  union all select number, 2, head, t2, open_win from umv union all select number, 3, head, t3, open_win from umv)
"""


def _uneven(spark: SparkSession, d: str) -> DataFrame:
    """The chain as a topic may hold it: times step back or are equal, and every fifth height comes
    again two blocks later with another time and more transfers."""
    step = F.when(F.col("number") % 7 == 0, 4000).when(F.col("number") % 7 == 1, 600).otherwise(0)
    sent = stored(_blocks(spark, d)).select((F.col("number") * 10).alias("offset"), "number", (F.col("ts") - step).alias("ts"), "n_tx")
    again = sent.where("number % 5 = 0").select((F.col("offset") + 25).alias("offset"), "number", (F.col("ts") + 700).alias("ts"), (F.col("n_tx") + 3).alias("n_tx"))
    return stored(sent.union(again))


@query(UNEVEN + " select number, cast(win_idx as integer) as win_idx, head, tail, open_win from umoves")
def window_moves_uneven(spark, d):
    return windows.moves(_uneven(spark, d)).drop("ts", "at")


@query(UNEVEN + """ select number, cast(win_idx as integer) as win_idx, head, tail, open_win from
 (select *, row_number() over (partition by win_idx order by number) as place from umoves where open_win)
 where place % case win_idx when 0 then 5 when 1 then 20 when 2 then 100 else 500 end = 0""")
def win_ticks_uneven(spark, d):
    return windows.ticks(_uneven(spark, d), CADENCE)


RECUT = """
, cb as (select number, ts, case when number > (select max(number) * 2 // 3 from blocks) then n_tx + number % 3 else n_tx end as n_tx
  from blocks where number <= (select max(number) * 9 // 10 from blocks))
, cr as (select number, ts, cast(sum(n_tx) over (order by number) as bigint) as head, n_tx from cb)
, cmv as (select number, head, min(number) over (order by ts range between 86400 preceding and current row) > 1 as open_win,
  min(head - n_tx) over (order by ts range between 60 preceding and current row) as t0, min(head - n_tx) over (order by ts range between 300 preceding and current row) as t1,
  min(head - n_tx) over (order by ts range between 3600 preceding and current row) as t2, min(head - n_tx) over (order by ts range between 86400 preceding and current row) as t3 from cr)
, cmoves as (select number, 0 as win_idx, head, t0 as tail, open_win from cmv union all select number, 1, head, t1, open_win from cmv
  union all select number, 2, head, t2, open_win from cmv union all select number, 3, head, t3, open_win from cmv)
, cticks as (select number, cast(win_idx as integer) as win_idx, head, tail, open_win from
 (select *, row_number() over (partition by win_idx order by number) as place from cmoves where open_win)
 where place % case win_idx when 0 then 5 when 1 then 20 when 2 then 100 else 500 end = 0)
"""


def _recut(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ticks of the chain, and of the chain that is cut at two thirds and goes on with other blocks."""
    blocks = stored(_blocks(spark, d).select("number", "ts", "n_tx"))
    top = blocks.agg(F.max("number")).first()[0]
    cut = chain.truncate_after(blocks, top * 2 // 3)
    other = blocks.where(f"number > {top * 2 // 3} and number <= {top * 9 // 10}").withColumn("n_tx", F.col("n_tx") + F.col("number") % 3)
    return stored(windows.ticks(blocks, CADENCE)), stored(windows.ticks(chain.append(cut, other), CADENCE))


TICK_KEY = ["win_idx", "head", "tail"]


@query(RECUT + """ select coalesce(c.win_idx, t.win_idx) as win_idx, coalesce(c.head, t.head) as head, coalesce(c.tail, t.tail) as tail,
 case when c.number is null then 'delete' else 'insert' end as op, coalesce(c.number, t.number) as number
 from (select cast(win_idx as integer) as win_idx, head, tail, number from ticks) t full join cticks c on t.win_idx = c.win_idx and t.head = c.head and t.tail = c.tail
 where t.number is null or c.number is null or t.number <> c.number""")
def tick_changes(spark, d):
    """What a truncation and other blocks change in the table of ticks."""
    return sinks.differences(*_recut(spark, d), TICK_KEY).select(*TICK_KEY, "op", "number")


@query(RECUT + " select * from cticks")
def ticks_after_truncation(spark, d):
    """The table of the old chain with those changes equals a fresh run."""
    old, new = _recut(spark, d)
    return sinks.applied(old, stored(sinks.differences(old, new, TICK_KEY)), TICK_KEY)


@query("""select number, 'win_tick' as type, '{"win_idx":' || win_idx || ',"head":' || head || ',"tail":' || tail || ',"open_win":' || open_win || '}' as data from ticks""")
def tick_envelope(spark, d):
    return sinks.envelope(_ticks(spark, d), "win_tick", ["win_idx", "head", "tail", "open_win"], keep=["number"])


@query("select cast(win_idx as integer) as win_idx, head, tail, open_win from ticks where number % 3 <> 0 and number % 5 <> 0")
def envelope_demux(spark, d):
    e = sinks.envelope(_ticks(spark, d), "win_tick", ["win_idx", "head", "tail", "open_win"], keep=["number"])
    kind = F.when(F.col("number") % 3 == 0, "other").otherwise(F.col("type"))
    data = F.when(F.col("number") % 5 == 0, F.lit('{"win_idx": "x", ')).otherwise(F.col("data"))
    text = F.to_json(F.struct(kind.alias("type"), F.lit(0).cast("long").alias("ts"), data.alias("data")))
    return sinks.demux(e.select(text.alias("value")))


@query("select cast(win_idx as integer) as win_idx, head // 50 as head, cast(0 as bigint) as tail, arg_max(number % 2 = 0, number) as open_win from ticks group by 1, 2")
def ticks_upsert(spark, d):
    rows = _ticks(spark, d).select("win_idx", F.floor(F.col("head") / 50).alias("head"), F.lit(0).cast("long").alias("tail"), (F.col("number") % 2 == 0).alias("open_win"), "number")
    return sinks.keep_last(rows, ["win_idx", "head", "tail"], "number").drop("number")


@query("select cast(win_idx as integer) as win_idx, head, tail, count(distinct (from_id, to_id)) as n_edges, count(*) as n_tx from wev group by all")
def window_edges_at_ticks(spark, d):
    return graph.edge_counts(*_windows(spark, d))


@query("""
select cast(win_idx as integer) as win_idx, head, tail, count(distinct (from_id, to_id)) as n_edges, count(*) as n_tx
from (select distinct win_idx, head, tail from moves) m join enc on idx >= tail and idx < head group by all""")
def window_edges_at_moves(spark, d):
    """The windows at every block overlap many times over: counted, not spread."""
    blocks, events = _chain(spark, d)
    return graph.edge_counts(windows.moves(blocks), events)


@query("""
, x as (select from_id, ts, amount, ts - lag(ts) over (partition by from_id order by ts, idx) as away, idx from enc)
, s as (select from_id, ts, amount, sum(case when away is null or away > 14400 then 1 else 0 end) over (partition by from_id order by ts, idx) as k from x)
select from_id, min(ts) as start, max(ts) + 14400 as "end", count(*) as n_tx, cast(sum(amount) as bigint) as amount from s group by from_id, k""")
def sender_sessions(spark, d):
    """Transfers of a sender that follow each other within four hours."""
    return graph.sender_sessions(_events(spark, d), 14_400)


@query("select from_id, ts // 7200 * 7200 as start, count(*) as n_tx, cast(sum(amount) as bigint) as amount from enc group by 1, 2")
def sender_windows(spark, d):
    return graph.sender_windows(_events(spark, d), 7200)


@query("select cast(win_idx as integer) as win_idx, head, from_id, to_id, list(idx order by idx) as evidence from wev group by 1, 2, 3, 4")
def edge_evidence(spark, d):
    return graph.evidence(*_windows(spark, d))


@query("select cast(win_idx as integer) as win_idx, head, from_id as node, list_sort(list(distinct to_id)) as neighbours from wev group by 1, 2, 3")
def adjacency(spark, d):
    return graph.adjacency(*_windows(spark, d))


@query("select cast(win_idx as integer) as win_idx, head, to_id as node, list_sort(list(distinct from_id)) as neighbours from wev group by 1, 2, 3")
def reverse_adjacency(spark, d):
    return graph.adjacency(*_windows(spark, d), reverse=True)


DEGREES = ", deg as (select win_idx, head, node, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree from (select win_idx, head, from_id as node, 1 as o, 0 as i from wev union all select win_idx, head, to_id, 0, 1 from wev) group by 1, 2, 3)"


@query(DEGREES + " select cast(win_idx as integer) as win_idx, head, node, out_degree, in_degree from deg")
def window_degrees(spark, d):
    return graph.degrees(*_windows(spark, d))


@query(DEGREES + ", r as (select *, row_number() over (partition by win_idx, head order by out_degree desc, node) as rank from deg where out_degree > 0) select cast(win_idx as integer) as win_idx, head, cast(rank as integer) as rank, node, out_degree from r where rank <= 5")
def top_out_degree(spark, d):
    return graph.top_out_degree(*_windows(spark, d))


@query("""
, seen as (select distinct from_id, to_id, ts from enc)
, around as (select *, lag(ts) over w as p, lead(ts) over w as q from seen window w as (partition by from_id, to_id order by ts))
, marks as (select ts as t, 1 as v from around where p is null or ts - p > 3600 union all
            select ts + 3601, -1 from around where q is null or q - ts > 3600 union all select ts, 0 from blocks)
, run as (select t, sum(sum(v)) over (order by t) as n from marks group by t)
select blocks.ts, cast(n as bigint) as n_edges from blocks join run on t = blocks.ts""")
def active_edges(spark, d):
    blocks, events = _chain(spark, d)
    return graph.active_edges(events, blocks, 3600)


@query("""
, link as (select distinct from_id as a, to_id as b from enc where to_id % 3 <> 0 or from_id < to_id)
, reach as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a)
, node as (select a as n from link union select b from link)
select n as node, least(n, coalesce((select min(r.b) from reach r join reach q on q.a = r.b and q.b = r.a where r.a = n), n)) as component from node""")
def strong_components(spark, d):
    """Of the edges, without those that lead to a third of the nodes from later ones."""
    edges = _events(spark, d).where("to_id % 3 <> 0 or from_id < to_id")
    return graph.strong_components(edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))


ORACLE["strong_components"] = ORACLE["strong_components"].replace("with ev as", "with recursive ev as", 1)


def _drawn(name: str, *at: str) -> str:
    """DuckDB's form of `generator.draw`."""
    text = " || ':' || ".join([f"'{generator.stream_seed(42, name)}'", *[f"cast({c} as varchar)" for c in at]])
    return f"cast('0x' || substr(sha256({text}), 1, 13) as bigint)"


def _addressed(k: str) -> str:
    return f"'0x' || substr(sha256('{generator.stream_seed(42, 'addr')}:' || cast({k} as varchar)), 1, 40)"


@query(f"""
, pool as (select count(*) as n from customer)
, t as (select number, ts, unnest(range(1, {_drawn('tx_count', 'number')} % 50 + 51)) as pos0 from blocks)
, p as (select number, ts, pos0 - 1 as pos from t)
, x as (select *, {_drawn('from', 'number', 'pos')} % n as src, {_drawn('to', 'number', 'pos')} % (n - 1) as hop from p, pool)
select number, ts, pos, {_addressed('src')} as sender,
  {_addressed(f"case when {_drawn('choose', 'number', 'pos')} / 4503599627370496.0 < 0.1 then src else (src + 1 + hop) % n end")} as receiver,
  'MOCK' as token, {_drawn('amount', 'number', 'pos')} % 1000 + 1 as amount, {_drawn('nonce', 'number', 'pos')} as nonce from x""")
def synthetic_transfers(spark, d):
    """Generated transfers for every block of the chain, among as many addresses as there are customers."""
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    return generator.transfers(_blocks(spark, d).select("number", "ts"), n, seed=42)


@query(f"--alone\nselect c_custkey as k, {_addressed('c_custkey')} as addr from customer")
def synthetic_addresses(spark, d):
    """An address for every customer."""
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), generator.address(42, k).alias("addr"))


@query(f"select number, ts, {_drawn('tx_count', 'number')} % 50 + 50 as n_tx from blocks")
def synthetic_blocks(spark, d):
    """The chain's heights and times mined anew, as on the wire, by the count of transfers that a header's
    root stands for."""
    blocks = stored(_blocks(spark, d).select("number", "ts"))
    mined = generator.block_messages(blocks, generator.transfers(blocks, spark.read.parquet(f"{d}/customer.parquet").count(), seed=42), seed=42)
    return mined.select("number", "ts", F.size("txs").cast("long").alias("n_tx"))


@query("select number % 8 as partition, min(number) as offset from blocks where number % 8 <> 5 group by 1")
def first_offsets(spark, d):
    """The first offset seen of each partition."""
    raw = _blocks(spark, d).select((F.col("number") % 8).alias("partition"), F.col("number").alias("offset"))
    return messages.first_seen(raw.where("partition <> 5"))


@query("select number, ts, n_tx from blocks where number >= (select max(number) // 3 from blocks)")
def offset_base(spark, d):
    """Messages below the base offset are left out, whatever they hold."""
    blocks = stored(_blocks(spark, d))
    base = blocks.agg(F.expr("max(number) div 3")).first()[0]
    txs = F.to_json(F.transform(F.sequence(F.lit(1), F.col("n_tx")), lambda k: F.struct(F.lit("").alias("hash"))))
    value = F.concat(F.lit('{"header":{"number":'), "number", F.lit(',"timestamp":'), "ts", F.lit('},"hash":"","txs":'), txs, F.lit("}"))
    sent = blocks.select(F.col("number").alias("offset"), F.when(F.col("number") % 2 == 0, value).when(F.col("number") < base, F.lit("{")).otherwise(value).alias("value"))
    return messages.block_rows(messages.decode(sent, base)).select("number", "ts", "n_tx")


def _sent(spark: SparkSession, d: str, partitions: int) -> DataFrame:
    """Every block as a JSON message of one of several partitions, as a topic holds them."""
    flat = stored(_flat(spark, d))
    body = F.struct(F.col("sender").alias("from"), F.col("receiver").alias("to"), "token", "amount", F.col("ts").alias("timestamp"))
    tx = F.struct(F.lit("").alias("hash"), body.alias("tx_body"), F.col("number").alias("block_num"))
    listed = flat.groupBy("number", "ts").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", tx.alias("tx")))), lambda x: x["tx"]).alias("txs"))
    header = F.struct("number", F.lit("").alias("parent_hash"), F.col("ts").alias("timestamp"), F.lit("").alias("tx_root"))
    value = F.to_json(F.struct(header.alias("header"), F.lit("").alias("hash"), "txs"))
    return stored(listed.select((F.col("number") % partitions).cast("int").alias("partition"), F.floor(F.col("number") / partitions).alias("offset"), value.alias("value")))


@query("select cast(number % 4 as integer) as partition, min(number // 4) as offset from blocks where ts >= (select max(ts) - 86400 from blocks) group by 1")
def replay_offsets(spark, d):
    """Where a replay of the last day begins in each of four partitions, by the index of block times."""
    index = stored(offsets.time_index(messages.block_rows(messages.decode(_sent(spark, d, 4)))))
    return offsets.starting_offsets(index, index.agg(F.max("ts")).first()[0] - 86_400)


@query("select number, ts, n_tx from blocks where ts >= (select max(ts) - 86400 from blocks)")
def replay_by_index(spark, d):
    """The blocks of the last day, read from the offsets that the index names."""
    sent = _sent(spark, d, 4)
    index = stored(offsets.time_index(messages.block_rows(messages.decode(sent))))
    starts = offsets.starting_offsets(index, index.agg(F.max("ts")).first()[0] - 86_400)
    return messages.block_rows(messages.decode(offsets.from_offsets(sent, starts))).select("number", "ts", "n_tx")


def _logged(spark: SparkSession, d: str) -> EventLog:
    """The chain's messages, encoded in five batches of a stream, some blocks twice."""
    blocks = stored(messages.block_rows(messages.decode(_sent(spark, d, 1))))
    top = blocks.agg(F.max("number")).first()[0]
    log = EventLog(spark, scratch(spark, "events"))
    for k in range(5):
        log.append(blocks.where(f"number > {top * k // 5} - 3 and number <= {top * (k + 1) // 5}"), k)
    return log


@query("select * from enc")
def encoded_in_batches(spark, d):
    return _logged(spark, d).events()


@query("select a as addr, id from addr union all select tok, id from toks")
def ids_in_batches(spark, d):
    """Address and token ids that five batches give, each going on from the one before."""
    addresses, tokens = _logged(spark, d).dictionaries()
    return addresses.union(tokens.select("tok", F.col("id").cast("long")))


@query("select idx, tok from tx where idx % 4 <> 0")
def token_filter(spark, d):
    """Transfers without a token are dropped on request: blank ones and missing ones."""
    flat = _flat(spark, d)
    k = F.col("idx") % 8
    messy = flat.withColumn("token", F.when(k == 0, F.lit(" \t")).when(k == 4, F.lit(None)).otherwise(F.concat(F.lit(" "), "token")))
    return dictionary.clean(messy, drop_no_token=True).select("idx", "tok")


@query("select idx, number, ts, '0x' || src as sender, '0x' || dst as receiver, tok as token, amount from tx")
def json_flatten(spark, d):
    """Transfers out of the blocks' JSON messages, numbered on from `rel`."""
    flat = stored(_flat(spark, d))
    body = F.struct(F.col("sender").alias("from"), F.col("receiver").alias("to"), "token", "amount", F.col("ts").alias("timestamp"))
    listed = flat.groupBy("number", "ts").agg(F.min("idx").alias("rel"), F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct(F.lit("").alias("hash"), body.alias("tx_body"), F.col("number").alias("block_num")).alias("tx")))), lambda x: x["tx"]).alias("txs"))
    header = F.struct("number", F.lit("").alias("parent_hash"), F.col("ts").alias("timestamp"), F.lit("").alias("tx_root"))
    sent = listed.select("rel", "number", F.to_json(F.struct(header.alias("header"), F.lit("").alias("hash"), "txs")).alias("value"))
    read = messages.decode(sent.select(F.col("number").alias("offset"), "value")).select("block.*").join(sent.select("number", "rel"), F.col("header.number") == F.col("number")).select("header", "txs", "rel")
    return dictionary.flatten_json(read).select("idx", "number", "ts", "sender", "receiver", "token", "amount")


@query("select count(*) as n, count(distinct src || dst) as n_edges, count(distinct src) as n_from, count(distinct tok) as n_token from tx")
def hash_ids(spark, d):
    """Ids without a dictionary: as many of them as there are names."""
    e = dictionary.hash_ids(_flat(spark, d))
    return e.agg(F.count("*").alias("n"), F.countDistinct("from_id", "to_id").alias("n_edges"), F.countDistinct("from_id").alias("n_from"), F.countDistinct("token_id").alias("n_token"))


@query("select tok as token, cast(sum(amount) as bigint) as amount, count(*) as n from tx group by tok")
def amount_by_token(spark, d):
    """Not an operator of the reference: a plain aggregation for comparison."""
    return _flat(spark, d).groupBy("token").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


@query("""--alone
with e as (select event_id, epoch_us(ts) as us from events), t as (
 select event_id, case event_id % 5 when 0 then cast(us // 1000000 as varchar) when 1 then cast(us // 1000 as varchar) when 2 then cast(us as varchar)
  when 3 then cast(us as varchar) || '000' else cast(us // 1000000 as varchar) || '.5' end as s, us from e)
select event_id, s as text, case event_id % 5 when 1 then 'milliseconds' when 2 then 'microseconds' when 3 then 'nanoseconds' else 'seconds' end as unit,
  strftime(make_timestamp((us // 1000000) * 1000000), '%Y-%m-%d %H:%M:%S') as utc,
  strftime(make_timestamp((us // 1000000) * 1000000 + 28800000000), '%Y-%m-%d %H:%M:%S') as at_0800,
  strftime(make_timestamp((us // 1000000) * 1000000 - 19800000000), '%Y-%m-%d %H:%M:%S') as at_0530,
  strftime(make_timestamp((us // 1000000) * 1000000 + 32400000000), '%Y-%m-%d %H:%M:%S') as tokyo from t""")
def ts_unit_inference(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    sec, k = F.floor(F.col("us") / 1_000_000).cast("string"), F.col("event_id") % 5
    text = F.when(k == 0, sec).when(k == 1, F.floor(F.col("us") / 1000).cast("string")).when(k == 2, F.col("us").cast("string")).when(k == 3, F.concat(F.col("us").cast("string"), F.lit("000"))).otherwise(F.concat(sec, F.lit(".5")))
    t = e.select("event_id", text.alias("text"))
    seconds = E.epoch_seconds(F.col("text"))
    return t.select("event_id", "text", E.epoch_unit(F.col("text")).alias("unit"), E.epoch_text(seconds, E.zone(F.lit("UTC"))).alias("utc"), E.epoch_text(seconds, E.zone(F.lit("+0800"))).alias("at_0800"), E.epoch_text(seconds, E.zone(F.lit("-05:30"))).alias("at_0530"), E.epoch_text(seconds, E.zone(F.lit("Asia/Tokyo"))).alias("tokyo"))


@query("""--alone
select o_orderkey, list_filter(list_transform(string_split(o_orderpriority || ', ,' || o_orderstatus || ' ,,x', ','), lambda x: trim(x)), lambda x: x <> '') as parts from orders""")
def csv_split(spark, d):
    text = F.concat("o_orderpriority", F.lit(", ,"), "o_orderstatus", F.lit(" ,,x"))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", E.split_csv(text).alias("parts"))
