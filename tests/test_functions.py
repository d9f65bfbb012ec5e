import hashlib

from pyspark.sql import functions as F

from tidewell.functions import encoding as E
from tidewell.sources.generator import stream_seed
from tidewell.sources.retry import call, pauses


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


A = "Ab" * 20


def test_addresses(spark):
    ok = [A, "0x" + A, "0X" + A, f" \t0x{A}\n"]
    assert {one(spark, E.address(F.col("a")), a=a) for a in ok} == {A.lower()}
    for bad in (A[:-1], A + "0", "0x" + A[:-1], "0x" + "g" * 40, "", None):
        assert one(spark, E.address(F.col("a").cast("string")), a=bad) is None


def test_hashes(spark):
    raw = bytes(range(32))
    assert one(spark, E.parse_hash32(F.col("h")), h=" 0X" + raw.hex().upper()) == raw
    assert one(spark, E.parse_hash32(F.col("h")), h=raw.hex()[:-1]) is None
    assert one(spark, E.to_hex32(F.unhex("h")), h=raw.hex()) == "0x" + raw.hex()
    assert one(spark, E.to_hex32(F.unhex("h")), h="00") is None
    assert one(spark, E.is_zero(E.hash32_or_zero(F.col("h").cast("string"))), h=None)
    assert one(spark, E.equal_hex(F.col("a"), F.lit("ABC")), a=" 0xabc ")


def test_transfer_hash_is_the_hash_of_its_bytes(spark):
    texts, numbers = ("0xé", "b", ""), (7, -1, 2**63 - 1)
    raw = b"".join(len(t.encode()).to_bytes(8, "big") + t.encode() for t in texts) + b"".join(n.to_bytes(8, "big", signed=True) for n in numbers)
    got = one(spark, E.tx_hash(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("e"), F.col("f")), a=texts[0], b=texts[1], c=texts[2], d=numbers[0], e=numbers[1], f=numbers[2])
    assert got == hashlib.sha256(raw).hexdigest()


def test_builder(spark):
    assert one(spark, E.put_hex(F.col("h")), h="0xABC") == "000000020abc"
    assert one(spark, E.put_hex(F.col("h")), h=" ") == "00000000"
    assert one(spark, E.put_hex(F.col("h")), h="xyz") is None
    assert one(spark, E.put_string(F.col("h")), h="ab") == "000000026162"
    assert one(spark, E.be64(F.col("n")), n=-1) == "F" * 16


def test_numbers_and_shards_of_bytes(spark):
    for n in (0, 1, -1, 2**63 - 1, -(2**63), 7 << 40):
        assert one(spark, E.be64_value(F.col("h")), h=(n % 2**64).to_bytes(8, "big").hex()) == n
    assert one(spark, E.be64_value(F.col("h")), h="00") is None
    for text, h in (("", 0x811C9DC5), ("a", 0xE40C292C), ("foobar", 0xBF9CF968)):
        assert one(spark, E.fnv32a(F.col("h")), h=text.encode().hex()) == h


def test_epochs(spark):
    unit = lambda s: one(spark, E.epoch_unit(F.col("s")), s=s)
    assert [unit(s) for s in ("1700000000", "1700000000000", "1700000000000000", "1700000000000000000", "17.5", "-12345678901", "x", "1" * 20)] == ["seconds", "milliseconds", "microseconds", "nanoseconds", "seconds", "milliseconds", None, "seconds"]
    at = lambda z: one(spark, E.epoch_text(E.epoch_seconds(F.col("s")), E.zone(F.col("z"))), s="1700000000", z=z)
    assert [at(z) for z in ("UTC", "z", "+08:00", "-0530", "Asia/Singapore", "")] == ["2023-11-14 22:13:20"] * 2 + ["2023-11-15 06:13:20", "2023-11-14 16:43:20", "2023-11-15 06:13:20", "2023-11-14 22:13:20"]


def test_split(spark):
    assert one(spark, E.split_csv(F.col("s")), s=" a,, b ,\t,c") == ["a", "b", "c"]


def test_seeds_differ_by_name():
    assert stream_seed(0, "") == 0xCBF29CE484222325 - 2**64
    assert len({stream_seed(1, n) for n in ("a", "b", "c")}) == 3


def test_retry_pauses_double_up_to_a_limit():
    waited, slept, tries = [], [], []

    def fails():
        tries.append(1)
        raise OSError

    try:
        call(fails, pauses(5, 1, 5), on_retry=lambda n, p, e: waited.append((n, p)), sleep=slept.append)
    except OSError:
        pass
    assert (waited, slept, len(tries)) == ([(1, 1), (2, 2), (3, 4), (4, 5)], [1, 2, 4, 5], 5)
    tries.clear()
    for waits, again in ((pauses(5), lambda e: False), (pauses(1), lambda e: True), (pauses(0), lambda e: True)):
        try:
            call(fails, waits, again, sleep=slept.append)
        except OSError:
            pass
    assert len(tries) == 3 and len(slept) == 4
    assert all(0.1 <= w <= 0.3 for w in pauses(2, 0, 0, 0.2))
    assert call(lambda: 7, pauses(3)) == 7
