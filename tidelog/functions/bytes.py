"""Byte-level column expressions: Spark has no unsigned integers, so words are longs masked to 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as an array of longs from 0 to 255; an empty array for an empty value."""
    chars = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.when(F.octet_length(data) > 0, F.transform(chars, lambda c: F.ascii(c).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def big_endian(number: Column, width: int) -> Column:
    """The low ``width`` bytes of a number, big-endian, two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * width)))


def from_big_endian(data: Column) -> Column:
    """A long of up to 8 big-endian bytes; 8 bytes are read as signed."""
    unsigned = F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")
    whole = F.when((F.octet_length(data) == 8) & (unsigned > F.lit(2**63 - 1)), unsigned - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(unsigned)
    return whole.cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
