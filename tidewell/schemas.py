"""Explicit schemas of the wire and table formats."""

from pyspark.sql import types as T

BODY = T.StructType(
    [
        T.StructField("from", T.StringType()),
        T.StructField("to", T.StringType()),
        T.StructField("token", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
TX = T.StructType([T.StructField("hash", T.StringType()), T.StructField("tx_body", BODY), T.StructField("block_num", T.LongType())])
HEADER = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("parent_hash", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("tx_root", T.StringType()),
    ]
)
BLOCK = T.StructType([T.StructField("header", HEADER), T.StructField("hash", T.StringType()), T.StructField("txs", T.ArrayType(TX))])
TICK = T.StructType(
    [
        T.StructField("win_idx", T.IntegerType()),
        T.StructField("head", T.LongType()),
        T.StructField("tail", T.LongType()),
        T.StructField("open_win", T.BooleanType()),
    ]
)
RAW_MESSAGE = T.StructType([T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("value", T.BinaryType())])
