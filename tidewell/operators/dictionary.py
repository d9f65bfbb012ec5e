"""Flattening, address rules and dictionary encoding of transfers.

Ids are dense from 1 in the order of first sight.  They are numbered by ranges of that order:
each range counts its names, and only the table of counts is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import encoding as E
from tidewell.plans.prefix import with_prefix
from tidewell.sources.store import stored

RANGE = 1 << 20


def flatten(blocks: DataFrame, transfers: DataFrame) -> DataFrame:
    """`idx` (running number of the transfer, from 0), the block's `number` and `ts`, and its fields."""
    b = blocks.select("number", "ts", "rel")
    return transfers.join(b, "ts").select((F.col("rel") + F.col("pos")).alias("idx"), "number", "ts", "pos", "sender", "receiver", "token", "amount", "nonce")


def flatten_json(blocks: DataFrame) -> DataFrame:
    """As flatten, for blocks with `header`, `txs` and `rel`; the event's time is the block's."""
    b = blocks.select(F.col("header.number").alias("number"), F.col("header.timestamp").alias("ts"), "rel", F.posexplode("txs").alias("pos", "tx"))
    body = F.col("tx.tx_body")
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return b.select(
        (F.col("rel") + F.col("pos")).alias("idx"), "number", "ts", F.col("pos").cast("long").alias("pos"),
        zero(body["from"], "").alias("sender"), zero(body["to"], "").alias("receiver"), zero(body["token"], "").alias("token"), zero(body["amount"], 0).alias("amount"),
    )


def clean(flat: DataFrame, drop_bad_address: bool = True, drop_no_token: bool = False) -> DataFrame:
    """`flat` with canonical `src`, `dst` and `tok` (null: invalid); dropped rows keep their number."""
    out = flat.withColumns({"src": E.address(F.col("sender")), "dst": E.address(F.col("receiver")), "tok": E.token(F.col("token"))})
    if drop_bad_address:
        out = out.where("src is not null and dst is not null")
    return out.where("tok is not null") if drop_no_token else out


ADDRESS, TOKEN = 0, 1


def first_sight(flat: DataFrame, kinds: tuple[int, ...] = (ADDRESS, TOKEN), drop_bad_address: bool = True) -> DataFrame:
    """`kind`, `name`, `first`: the place at which each name is first seen.

    The sender is seen before the receiver; a bad sender hides the receiver, and a bad address
    the token, unless such transfers are kept.
    """
    c = clean(flat, drop_bad_address=False)
    src, dst, tok = F.col("src"), F.col("dst"), F.col("tok")
    if drop_bad_address:
        dst, tok = F.when(src.isNotNull(), dst), F.when(src.isNotNull() & dst.isNotNull(), tok)
    seen = {ADDRESS: [(src, 0), (dst, 1)], TOKEN: [(tok, 0)]}
    names = F.array(*[F.struct(F.lit(k).alias("kind"), name.alias("name"), (F.col("idx") * 2 + at).alias("first")) for k in kinds for name, at in seen[k]])
    return c.select(F.inline(names)).where("name is not null").groupBy("kind", "name").agg(F.min("first").alias("first"))


def numbered(first: DataFrame, kinds: tuple[int, ...] = (ADDRESS, TOKEN)) -> DataFrame:
    """`kind`, `name`, `id`: dense ids from 1 of the names of each kind, by first sight (a table that is
    read twice)."""
    # a name's number among its kind; numbers of the other kinds at the same place do not count
    ids = with_prefix(first, "first", {f"id{k}": F.when(F.col("kind") == k, 1).otherwise(0) for k in kinds}, day=RANGE)
    own = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"id{k}")) for k in kinds])
    return ids.select("kind", "name", own.alias("id"))


def _numbered(flat: DataFrame, kinds: tuple[int, ...], drop_bad_address: bool) -> DataFrame:
    """Ids of whole tables.  The names' first sight is written, as numbering reads it twice, and so are
    the ids: a table of known size, which joins broadcast while small."""
    return stored(numbered(stored(first_sight(flat, kinds, drop_bad_address)), kinds))


def dictionaries(flat: DataFrame, drop_bad_address: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both dictionaries from one pass: (`addr`, `id`) and (`tok`, `id`)."""
    ids = _numbered(flat, (ADDRESS, TOKEN), drop_bad_address)
    return ids.where(F.col("kind") == ADDRESS).select(F.col("name").alias("addr"), "id"), ids.where(F.col("kind") == TOKEN).select(F.col("name").alias("tok"), F.col("id").cast("int").alias("id"))


def address_ids(flat: DataFrame, drop_bad_address: bool = True) -> DataFrame:
    """`addr`, `id`."""
    return _numbered(flat, (ADDRESS,), drop_bad_address).select(F.col("name").alias("addr"), "id")


def token_ids(flat: DataFrame, drop_bad_address: bool = True) -> DataFrame:
    """`tok`, `id`; an empty token has no id (0 in events)."""
    return _numbered(flat, (TOKEN,), drop_bad_address).select(F.col("name").alias("tok"), F.col("id").cast("int").alias("id"))


def encoded(flat: DataFrame, addresses: DataFrame, tokens: DataFrame, drop_bad_address: bool = True, drop_no_token: bool = False) -> DataFrame:
    """`idx`, `ts`, `from_id`, `to_id`, `token_id`, `amount`; unknown names are 0.

    Catalyst chooses the joins: dictionaries under the session's threshold are broadcast.
    """
    c = clean(flat, drop_bad_address, drop_no_token)
    out = c.join(addresses.select(F.col("addr").alias("src"), F.col("id").alias("from_id")), "src", "left")
    out = out.join(addresses.select(F.col("addr").alias("dst"), F.col("id").alias("to_id")), "dst", "left")
    out = out.join(tokens.select("tok", F.col("id").alias("token_id")), "tok", "left")
    z = lambda n, k: F.coalesce(F.col(n), F.lit(0)).cast(k).alias(n)
    return out.select("idx", "ts", z("from_id", "long"), z("to_id", "long"), z("token_id", "int"), "amount")


def decoded(events: DataFrame, addresses: DataFrame, tokens: DataFrame) -> DataFrame:
    """`events` with the names of their ids (`sender`, `receiver`, `token`)."""
    out = events.join(addresses.select(F.col("id").alias("from_id"), F.concat(F.lit("0x"), "addr").alias("sender")), "from_id", "left")
    out = out.join(addresses.select(F.col("id").alias("to_id"), F.concat(F.lit("0x"), "addr").alias("receiver")), "to_id", "left")
    return out.join(tokens.select(F.col("id").alias("token_id"), F.col("tok").alias("token")), "token_id", "left")


def hash_ids(flat: DataFrame) -> DataFrame:
    """Events with 64-bit hash ids instead of dense ones: no dictionary, nothing to order."""
    c = clean(flat)
    return c.select("idx", "ts", F.xxhash64("src").alias("from_id"), F.xxhash64("dst").alias("to_id"), F.xxhash64("tok").alias("token_id"), "amount")


def edge_key(sender: str = "from_id", receiver: str = "to_id"):
    """One number for an edge of ids below 2**32."""
    return F.shiftleft(F.col(sender), 32).bitwiseOR(F.col(receiver).bitwiseAND(F.lit(0xFFFFFFFF)))
