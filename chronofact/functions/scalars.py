"""Text, parsing and encoding functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Everything but Latin letters, digits and the pipe becomes a space."""
    return F.regexp_replace(text, r"[^\p{IsLatin}|0-9]", " ")


def tokenize(text: Column) -> Column:
    """Lower-case tokens of the normalized text."""
    return F.filter(F.split(F.lower(normalize(text)), " "), lambda t: t != "")


def tokenize_spaces(text: Column, lower: bool = True) -> Column:
    return F.split(F.lower(text) if lower else text, " ")


def strip_quotes(text: Column, quote: str = '"') -> Column:
    """Without one pair of quotes around it, where it has one."""
    quoted = F.startswith(text, F.lit(quote)) & F.endswith(text, F.lit(quote)) & (F.length(text) >= 2)
    return F.when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def parsed_number(text: Column) -> Column:
    """struct(i, d, s): an integer, else a double, else the string."""
    i, d = text.try_cast("int"), text.try_cast("double")
    return F.struct(i.alias("i"), F.when(i.isNull(), d).alias("d"), F.when(i.isNull() & d.isNull(), text).alias("s"))


def hexify(number: Column) -> Column:
    """Two hexadecimal digits at least, in lower case."""
    digits = F.lower(F.hex(number))
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def unhexify(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def base64_encode(data: Column) -> Column:
    return F.base64(data)


def base64_decode(text: Column) -> Column:
    return F.unbase64(text)


def base16_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def sha1(data: Column) -> Column:
    return F.sha1(data)


def bits(number: Column) -> Column:
    return F.bin(number)


def bit_count(number: Column) -> Column:
    """How many binary digits the number has."""
    return F.length(F.bin(number))


def digit_count(number: Column, base: int) -> Column:
    return F.length(encoded_number(number, base))


DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ-_"


def encoded_number(number: Column, base: int, digits: str = DIGITS) -> Column:
    """A non-negative integer in base 2 to 64, most significant digit first."""
    if base <= 36 and digits == DIGITS:
        return F.lower(F.conv(number.cast("string"), 10, base))
    places = F.sequence(F.lit(0), F.lit(63))
    start = F.struct(number.cast("long").alias("left"), F.lit("").alias("text"))

    def step(acc: Column, _: Column) -> Column:
        digit = F.substring(F.lit(digits), (acc["left"] % base + 1).cast("int"), F.lit(1))
        more = (acc["left"] > 0) | (F.length(acc["text"]) == 0)
        rest = F.floor(acc["left"] / base).cast("long") if base < 2 else (acc["left"] - acc["left"] % base) / base
        return F.struct(F.when(more, rest.cast("long")).otherwise(acc["left"]).alias("left"), F.when(more, F.concat(digit, acc["text"])).otherwise(acc["text"]).alias("text"))

    return F.aggregate(places, start, step)["text"]


def vlq(number: Column) -> Column:
    """Base-128 groups, most significant first, high bit set on all but the last, as hex."""
    binary = F.bin(number)
    padded = F.lpad(binary, (F.ceil(F.length(binary) / 7) * 7).cast("int"), F.lit("0"))
    groups = F.regexp_extract_all(padded, F.lit("[01]{7}"), F.lit(0))
    marked = F.transform(groups, lambda g, i: F.concat(F.when(i < F.size(groups) - 1, "1").otherwise("0"), g))
    return F.array_join(F.transform(marked, lambda g: F.lpad(F.lower(F.conv(g, 2, 16)), 2, "0")), "")


def uuid_to_base64(text: Column) -> Column:
    return F.base64(F.unhex(F.replace(text, F.lit("-"), F.lit(""))))


def base64_to_uuid(text: Column) -> Column:
    h = F.lower(F.hex(F.unbase64(text)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def time_interval(seconds: Column) -> Column:
    """h:m:s.s; minutes are those of the whole interval, not of its last hour."""
    whole = F.floor(seconds)
    return F.format_string("%d:%d:%.1f", F.floor(whole / 3600), F.floor(whole / 60), seconds - F.floor(seconds / 60) * 60)


def cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def unsigned_byte(b: Column) -> Column:
    return b.cast("int").bitwiseAND(255)


def median(values: Column) -> Column:
    """The middle element of an array in order; the upper one of two."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def split_in(values: Column, parts: int) -> Column:
    """An array cut into parts of like size, larger ones last."""
    n = F.size(values)
    ends = [F.floor(n * k / parts).cast("int") for k in range(parts + 1)]
    return F.array(*[F.slice(values, ends[k] + 1, ends[k + 1] - ends[k]) for k in range(parts)])


def insert_after(values: Column, old: Column, new: Column) -> Column:
    return F.array_insert(values, F.array_position(values, old).cast("int") + 1, new)


def removed_at(values: Column, index: int) -> Column:
    return F.concat(F.slice(values, 1, index), F.slice(values, F.lit(index + 2), F.greatest(F.size(values) - index - 1, F.lit(0))))


def find_index(values: Column, value: Column) -> Column:
    """From 0; null if it isn't there."""
    at = F.array_position(values, value)
    return F.when(at > 0, at - 1)


def contains_map(found: Column, wanted: dict) -> Column:
    """Whether a map has all the wanted entries."""
    return reduce(lambda a, b: a & b, [found[F.lit(k)].eqNullSafe(F.lit(v)) for k, v in wanted.items()], F.lit(True))


def padded(values: Column, n: int, value: Column) -> Column:
    """The first n elements, filled up with value."""
    return F.slice(F.concat(values, F.array_repeat(value, n)), 1, n)


def mapped_values(m: Column, function) -> Column:
    """The map with function(value) in place of each value."""
    return F.transform_values(m, lambda _, v: function(v))


# Binary forms: dates in 4 bytes, numbers in little-endian groups of 7 bits.


def date_bytes(date: Column) -> Column:
    """Year in two bytes, month and day in one each, most significant first."""
    return F.unhex(F.format_string("%04x%02x%02x", F.year(date), F.month(date), F.day(date)))


def bytes_date(data: Column) -> Column:
    h = F.hex(data)
    part = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("int")
    return F.make_date(part(1, 4), part(5, 2), part(7, 2))


def leb128(number: Column) -> Column:
    """Base-128 groups, least significant first, high bit set on all but the last, as hex."""
    binary = F.bin(number)
    groups = F.regexp_extract_all(F.lpad(binary, (F.ceil(F.length(binary) / 7) * 7).cast("int"), F.lit("0")), F.lit("[01]{7}"), F.lit(0))
    marked = F.transform(F.reverse(groups), lambda g, i: F.concat(F.when(i < F.size(groups) - 1, "1").otherwise("0"), g))
    return F.array_join(F.transform(marked, lambda g: F.lpad(F.lower(F.conv(g, 2, 16)), 2, "0")), "")


def leb128_sequence(values: Column) -> Column:
    """The number of values and each of them, as hex."""
    return F.concat(leb128(F.size(values)), F.array_join(F.transform(values, leb128), ""))


def leb128_values(text: Column) -> Column:
    """The values of a sequence, from hex."""
    numbers = F.regexp_extract_all(F.lower(text), F.lit("(?:[89a-f][0-9a-f])*[0-7][0-9a-f]"), F.lit(0))

    def number(h: Column) -> Column:
        bytes_ = F.reverse(F.regexp_extract_all(h, F.lit(".."), F.lit(0)))
        bits = F.array_join(F.transform(bytes_, lambda b: F.substring(F.lpad(F.conv(b, 16, 2), 8, "0"), 2, 7)), "")
        return F.conv(bits, 2, 10).cast("long")

    return F.transform(F.slice(numbers, F.lit(2), F.greatest(F.size(numbers) - 1, F.lit(0))), number)
