"""Column functions: hex and address rules, canonical hashes, epoch units.  No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = "^(0[xX])?[0-9a-fA-F]{40}$"


def strip_space(c: Column) -> Column:
    """Without white space at the ends (all of it, not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def to_hex32(binary: Column) -> Column:
    """32 bytes as `0x` and lower-case hex; null if the length differs."""
    return F.when(F.octet_length(binary) == 32, F.concat(F.lit("0x"), F.lower(F.hex(binary))))


def parse_hash32(text: Column) -> Column:
    """32 bytes from 64 hex digits with or without 0x/0X; null if invalid."""
    bare = F.regexp_replace(strip_space(text), "^0[xX]", "")
    return F.when(F.regexp_like(bare, F.lit("^[0-9a-fA-F]{64}$")), F.unhex(bare))


def hash32_or_zero(text: Column) -> Column:
    """As parse_hash32, with 32 zero bytes for null."""
    return F.when(text.isNull(), F.unhex(F.repeat(F.lit("00"), 32))).otherwise(parse_hash32(text))


def is_zero(binary: Column) -> Column:
    return binary == F.unhex(F.repeat(F.lit("00"), 32))


def valid_address(text: Column) -> Column:
    return F.coalesce(F.regexp_like(strip_space(text), F.lit(ADDRESS)), F.lit(False))


def address(text: Column) -> Column:
    """40 lower-case hex digits, or null if the text is no address."""
    return F.when(valid_address(text), F.lower(F.right(strip_space(text), F.lit(40))))


def token(text: Column) -> Column:
    """The trimmed token, or null if nothing is left; case matters."""
    return F.nullif(strip_space(text), F.lit(""))


def equal_hex(a: Column, b: Column) -> Column:
    bare = lambda c: F.lower(F.regexp_replace(strip_space(c), "^0x", ""))
    return bare(a) == bare(b)


def be64(value: Column) -> Column:
    """8 bytes, big-endian, as hex digits (two's complement)."""
    return F.lpad(F.hex(value.cast("long")), 16, "0")


def be64_value(hex_digits: Column) -> Column:
    """The number in 16 hex digits of 8 big-endian bytes; null unless there are 8 bytes."""
    digits = F.when(F.regexp_like(hex_digits, F.lit("^[0-9a-fA-F]{16}$")), hex_digits)
    high, low = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def fnv32a(hex_digits: Column) -> Column:
    """The 32-bit FNV-1a hash of bytes given as hex digits, as a whole number from 0 to 2**32 - 1."""
    count = (F.length(hex_digits) / 2).cast("int")
    places = F.filter(F.sequence(F.lit(0), count), lambda k: k < count)
    byte = lambda k: F.conv(F.substring(hex_digits, k * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(0x811C9DC5).cast("long"), lambda h, k: (h.bitwiseXOR(byte(k)) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def shard(hex_digits: Column, parts: int) -> Column:
    """Which of `parts` shards of a dictionary holds the key of these bytes."""
    return (fnv32a(hex_digits) % parts).cast("int")


def be32(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("long")), 8, "0")


def text_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-8"))


def put_bytes(hex_digits: Column) -> Column:
    """Length in four bytes, then the bytes."""
    return F.concat(be32((F.length(hex_digits) / 2).cast("long")), hex_digits)


def put_string(text: Column) -> Column:
    return put_bytes(text_hex(text))


def put_bool(flag: Column) -> Column:
    return F.when(flag, F.lit("01")).otherwise(F.lit("00"))


def put_hex(text: Column) -> Column:
    """A hex string as length and bytes: 0x dropped, an odd digit padded on the left."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(strip_space(text), "^0x", ""), "^0X", ""))
    even = F.when(F.length(bare) % 2 == 1, F.concat(F.lit("0"), bare)).otherwise(bare)
    return F.when(F.regexp_like(even, F.lit("^[0-9a-f]*$")), put_bytes(even))


def sha256_hex(hex_digits: Column) -> Column:
    return F.sha2(F.unhex(hex_digits), 256)


def tx_hash(sender: Column, receiver: Column, tok: Column, amount: Column, ts: Column, nonce: Column) -> Column:
    """Canonical hash of a transfer: three texts behind their lengths in 8 bytes, three numbers."""
    texts = [x for c in (sender, receiver, tok) for x in (be64(F.octet_length(c)), text_hex(c))]
    return sha256_hex(F.concat(*texts, be64(amount), be64(ts), be64(nonce)))


def header_hash(number: Column, ts: Column, parent: Column, root: Column, nonce: Column) -> Column:
    """parent and root: 64 hex digits."""
    return sha256_hex(F.concat(be64(number), be64(ts), parent, root, be64(nonce)))


def tx_root(hashes: Column) -> Column:
    """Hash of the transactions' hashes (hex digits) in the order given."""
    return sha256_hex(F.array_join(hashes, ""))


def split_csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip_space), lambda x: x != "")


def epoch_unit(text: Column) -> Column:
    """seconds, milliseconds, microseconds or nanoseconds, by the number of digits; null if no number."""
    s = strip_space(text)
    digits = F.length(F.regexp_replace(s, "^-", ""))
    return F.when(
        F.regexp_like(s, F.lit(r"^[+-]?\d+(\.\d+)?$")),
        F.when(s.contains("."), "seconds")
        .when(digits <= 10, "seconds")
        .when(digits <= 13, "milliseconds")
        .when(digits <= 16, "microseconds")
        .when(digits <= 19, "nanoseconds")
        .otherwise("seconds"),
    )


def epoch_seconds(text: Column) -> Column:
    unit, value = epoch_unit(text), strip_space(text).try_cast("double")
    scale = F.when(unit == "milliseconds", 1e3).when(unit == "microseconds", 1e6).when(unit == "nanoseconds", 1e9).otherwise(1.0)
    return F.when(unit.isNotNull(), value / scale)


def zone(token_: Column) -> Column:
    """A zone name Spark knows: UTC, Z, +hh:mm, +hhmm or a region; blank is the session's zone."""
    t = strip_space(token_)
    offset = F.regexp_replace(t, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    return F.when(t.isNull() | (t == ""), F.current_timezone()).when(F.upper(t).isin("UTC", "Z"), "UTC").otherwise(offset)


def epoch_text(seconds: Column, zone_name: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` in a zone, for a session in UTC."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_micros((seconds * 1e6).cast("long")), zone_name), "yyyy-MM-dd HH:mm:ss")
