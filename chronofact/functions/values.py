"""Heterogeneous values and their total order as one struct column.

A value is a struct (k, num, str, sid, id, arr): k ranks the value's class,
the slot of the class is filled and the others are null. Spark compares structs
field by field with nulls first, so ordering by the struct is the total order:
null, sequences, booleans, numbers, strings, then entity ids by (stream, id).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALUE = "struct<k:tinyint,num:double,str:string,sid:string,id:bigint,arr:array<string>>"
# Ranks of classes, in the order in which they sort.
RANKS = {"null": 0, "entity": 1, "keyword": 2, "sequence": 3, "symbol": 4, "boolean": 5, "character": 6, "number": 7, "string": 8, "date": 9, "uuid": 10}


def _value(rank: str, **slots: Column) -> Column:
    kinds = {"num": "double", "str": "string", "sid": "string", "id": "bigint", "arr": "array<string>"}
    parts = [slots.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()]
    return F.struct(F.lit(RANKS[rank]).cast("tinyint").alias("k"), *parts)


def null_value() -> Column:
    return _value("null")


def number(c: Column) -> Column:
    return _value("number", num=c)


def string(c: Column) -> Column:
    return _value("string", str=c)


def keyword(c: Column) -> Column:
    """Names without a namespace sort before those with one."""
    return _value("keyword", id=F.when(c.contains("/"), 1).otherwise(0), str=c)


def symbol(c: Column) -> Column:
    """Like keywords, in a class of their own."""
    return _value("symbol", id=F.when(c.contains("/"), 1).otherwise(0), str=c)


def character(c: Column) -> Column:
    return _value("character", str=c)


def binary(c: Column) -> Column:
    """Bytes compare as the sequence of their values."""
    return _value("sequence", arr=F.regexp_extract_all(F.lower(F.hex(c)), F.lit(".."), F.lit(0)))


def boolean(c: Column) -> Column:
    return _value("boolean", num=c.cast("int"))


def sequence(c: Column) -> Column:
    return _value("sequence", arr=c)


def set_value(c: Column) -> Column:
    """A set compares as its sorted elements."""
    return _value("sequence", arr=F.array_sort(c))


def map_value(c: Column) -> Column:
    """A map compares as its entries sorted by key."""
    return _value("sequence", arr=F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("\x00", e["key"], e["value"])))


def date(c: Column) -> Column:
    return _value("date", num=c.cast("timestamp").cast("double"))


def uuid(c: Column) -> Column:
    return _value("uuid", str=F.lower(c))


# Entity ids: local ones have no stream, global ones have one.


def local_id(number: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("stream_id"), number.cast("bigint").alias("id"))


def global_id(stream: Column, number: Column) -> Column:
    return F.struct(stream.cast("string").alias("stream_id"), number.cast("bigint").alias("id"))


def is_local(entity: Column) -> Column:
    return entity["stream_id"].isNull() & entity["id"].isNotNull()


def made_local(stream: Column, entity: Column) -> Column:
    """The same id, local if it belongs to the stream."""
    return F.when(entity["stream_id"] == stream, local_id(entity["id"])).otherwise(entity)


def made_global(stream: Column, entity: Column) -> Column:
    """The same id, with the stream if it has none."""
    return global_id(F.coalesce(entity["stream_id"], stream), entity["id"])
