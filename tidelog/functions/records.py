"""The record format in column expressions.

Layout, big-endian: length i32 (all that follows), offset i64, timestamp i64 (ms), CRC-32C u32, attributes i8, key (i32
length, -1 for null), value (likewise). The checksum covers attributes to value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_RECORD_BYTES, RECORD_OVERHEAD
from .bytes import big_endian, from_big_endian
from .hashing import crc32c, fnv1a32


def encoded_size(key: Column, value: Column) -> Column:
    """Bytes of the encoded record; null and empty take the same room."""
    return F.lit(RECORD_OVERHEAD) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))


def _nullable(data: Column) -> Column:
    return F.when(data.isNull(), F.lit(b"\xff\xff\xff\xff")).otherwise(F.concat(big_endian(F.octet_length(data), 4), data))


def record_body(key: Column, value: Column, attributes: Column | None = None) -> Column:
    """What the checksum covers: attributes, key and value."""
    return F.concat(big_endian(attributes if attributes is not None else F.lit(0), 1), _nullable(key), _nullable(value))


def record_crc32c(key: Column, value: Column, attributes: Column | None = None) -> Column:
    return crc32c(record_body(key, value, attributes))


def encode_record(offset: Column, timestamp: Column, key: Column, value: Column, attributes: Column | None = None) -> Column:
    """The encoded record; null if it would be larger than the format allows."""
    size = encoded_size(key, value)
    body = record_body(key, value, attributes)
    whole = F.concat(big_endian(size - 4, 4), big_endian(offset, 8), big_endian(timestamp, 8), big_endian(crc32c(body), 4), body)
    return F.when(size <= MAX_RECORD_BYTES, whole)


def valid_record(data: Column) -> Column:
    """Whether a binary column holds one whole record: its length is the declared one, and its checksum is that of its body."""
    whole = (F.octet_length(data) >= RECORD_OVERHEAD) & (from_big_endian(F.substring(data, 1, 4)) == F.octet_length(data) - 4)
    return F.coalesce(whole & (from_big_endian(F.substring(data, 21, 4)) == crc32c(F.substring(data, 25, MAX_RECORD_BYTES))), F.lit(False))


def segment_file_name(base_offset: Column) -> Column:
    return F.concat(F.lpad(base_offset.cast("string"), 20, "0"), F.lit(".log"))


def offsets_partition(group: Column, partitions: int = 50) -> Column:
    """Partition of the offsets log that a consumer group's commits go to."""
    return (fnv1a32(group.cast("binary")) % partitions).cast("int")


def valid_topic_name(name: Column) -> Column:
    """1 to 249 characters of a-z, A-Z, 0-9, '.', '_' and '-', but neither '.' nor '..'; null is not valid."""
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9._-]+\z") & F.char_length(name).between(1, 249) & ~name.isin(".", ".."), F.lit(False))


def static_leader(replicas: Column, partition: Column) -> Column:
    """The replica at position partition modulo their number; null without replicas."""
    return F.get(replicas, F.when(F.size(replicas) > 0, partition % F.size(replicas)))


def format_latency(us: Column) -> Column:
    """Microseconds as a report shows them: whole numbers from 1 on without decimals, others with three."""
    return F.when((us == F.floor(us)) & (us >= 1), F.format_string("%.0f", us.cast("double"))).otherwise(F.format_string("%.3f", us.cast("double")))


def format_median_latency(us: Column) -> Column:
    """``format_latency``, marked where what is shown is zero: below the clock's resolution."""
    shown = format_latency(us)
    return F.when(shown == "0.000", F.concat(shown, F.lit(" [*]"))).otherwise(shown)
