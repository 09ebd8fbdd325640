"""Hashes of the log format as column expressions: Murmur2 for routing, CRC-32C for records, FNV-1a for groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import MASK, byte_values, let

#: Seed of the routing hash. Apache Kafka's public one is 0x9747B28C.
MURMUR2_SEED = 0x973AFB51
_M = 0x5BD1E995
_CASTAGNOLI = 0x82F63B78


def _times(x: Column) -> Column:
    return (x * F.lit(_M).cast("long")).bitwiseAND(F.lit(MASK))


def _fold(x: Column, bits: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, bits))


def _little_endian(b: Column, at: Column, size: int) -> Column:
    out = F.get(b, at)
    for k in range(1, size):
        out = out.bitwiseOR(F.shiftleft(F.get(b, at + k), 8 * k))
    return out


def murmur2(data: Column, seed: int = MURMUR2_SEED) -> Column:
    """MurmurHash2 of a binary column, as a non-negative 31-bit long. A null counts as empty."""
    data = F.coalesce(data, F.lit(b""))

    def whole(b: Column) -> Column:
        n = F.size(b)
        words = F.floor(n / 4).cast("int")
        starts = F.when(words > 0, F.transform(F.sequence(F.lit(0), words - 1), lambda i: i * 4)).otherwise(F.array().cast("array<int>"))
        start = F.lit(seed).cast("long").bitwiseXOR(n.cast("long"))
        h = F.aggregate(starts, start, lambda h, at: _times(h).bitwiseXOR(let(_times(_little_endian(b, at, 4)), lambda k: _times(_fold(k, 24)))))
        tail = words * 4
        rest = n - tail
        h = F.when(rest == 3, _times(h.bitwiseXOR(_little_endian(b, tail, 3)))).when(rest == 2, _times(h.bitwiseXOR(_little_endian(b, tail, 2)))).when(rest == 1, _times(h.bitwiseXOR(_little_endian(b, tail, 1)))).otherwise(h)
        return let(let(h, lambda x: _times(_fold(x, 13))), lambda x: _fold(x, 15).bitwiseAND(F.lit(0x7FFFFFFF)))

    return let(byte_values(data), whole)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (_CASTAGNOLI if i & 1 else 0)
        out.append(i)
    return out


CRC32C_TABLE = _crc_table()


def crc32c(data: Column) -> Column:
    """CRC-32C (Castagnoli) of a binary column as an unsigned 32-bit number in a long; Spark's own ``crc32`` is another polynomial."""
    table = F.array(*[F.lit(x).cast("long") for x in CRC32C_TABLE])
    step = lambda crc, b: F.shiftright(crc, 8).bitwiseXOR(F.get(table, crc.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")))
    return F.aggregate(byte_values(data), F.lit(MASK).cast("long"), step, lambda crc: crc.bitwiseXOR(F.lit(MASK)))


def fnv1a32(data: Column) -> Column:
    """FNV-1a, 32 bits, of a binary column."""
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(MASK))
    return F.aggregate(byte_values(data), F.lit(2166136261).cast("long"), step)
