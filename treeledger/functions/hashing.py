"""Hashes with 32-bit wraparound, as expressions over UTF-16 code units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seeds and multipliers of the hashes.
XOR_SEED, XOR_FACTOR = 5381, 33
FNV_SEED, FNV_FACTOR = 2166136261, 16777619
WINDOW_FACTOR = 31
LOW = 0xFFFFFFFF


def code_units(text: Column) -> Column:
    """UTF-16 code units of a text, as numbers."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(digits) / 4).cast("int")
    unit = lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), unit)).otherwise(F.array().cast("array<bigint>"))


def to_int32(value: Column) -> Column:
    return (((value + F.lit(2**31)).bitwiseAND(F.lit(LOW))) - F.lit(2**31)).cast("bigint")


def xor_hash(text: Column) -> Column:
    """The text's hash by multiplying and then mixing each unit in, as an unsigned 32-bit number."""
    return F.aggregate(code_units(text), F.lit(XOR_SEED).cast("bigint"), lambda h, u: (h * XOR_FACTOR).bitwiseAND(F.lit(LOW)).bitwiseXOR(u))


def fnv_hash(text: Column) -> Column:
    """The text's hash by mixing each unit in and then multiplying, as an unsigned 32-bit number."""
    return F.aggregate(code_units(text), F.lit(FNV_SEED).cast("bigint"), lambda h, u: (h.bitwiseXOR(u) * FNV_FACTOR).bitwiseAND(F.lit(LOW)))


def window_step(key: Column, value: Column) -> Column:
    """A window's key after one more statement: the product wraps to 32 bits, the sum does not."""
    return to_int32(to_int32(key) * WINDOW_FACTOR) + value
