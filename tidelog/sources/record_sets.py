"""Record sets (blobs of encoded records) and message bodies to rows and back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.codec import Reader, ddl, decode_fields, get, put

_ROW = "offset: bigint, timestamp: bigint, attributes: tinyint, key: binary, value: binary"


class _Decode:
    lenient = False

    def eval(self, data: bytes):
        yield from map(tuple, decode_fields(bytes(data or b""), self.lenient))


@udtf(returnType=_ROW)
class DecodeRecordSet(_Decode):
    """The records of a set; one that is invalid is an error."""

    def eval(self, data: bytes):
        yield from _Decode.eval(self, data)


@udtf(returnType=_ROW)
class DecodeRecordSetLenient(_Decode):
    """The records of a set before the first invalid one."""

    lenient = True

    def eval(self, data: bytes):
        yield from _Decode.eval(self, data)


def decode_sets(sets: DataFrame, blob: str = "record_set", keys: list[str] | None = None, lenient: bool = False) -> DataFrame:
    """``keys`` of each row of ``sets`` with place (from 0) and the fields of each record in its blob."""
    keys = keys or [c for c in sets.columns if c != blob]
    picked = sets.select(*keys, blob)
    fields = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary(), pa.binary()]
    names = ["place", "offset", "timestamp", "attributes", "key", "value"]

    def run(batches):
        for b in batches:
            taken, rows = [], []
            for i, x in enumerate(b.column(len(keys))):
                for place, found in enumerate(decode_fields(x.as_py() or b"", lenient)):
                    taken.append(i)
                    rows.append((place, *found))
            own = [b.column(k).take(pa.array(taken, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, fields))], [*keys, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "place long, offset long, timestamp long, attributes tinyint, key binary, value binary"])
    return picked.mapInArrow(run, schema)


def encode_sets(encoded: DataFrame, keys: list[str], record: str = "record", order: str = "offset") -> DataFrame:
    """``keys`` and record_set: the encoded records of each group, joined in order. A group is as large as one request may be."""
    listed = encoded.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, record))).alias("__r"))
    joined = F.aggregate(F.col("__r")[record], F.lit(b""), lambda acc, x: F.concat(acc, x))
    return listed.select(*keys, joined.alias("record_set"))


def encode_bodies(rows: DataFrame, body: str, layout, encoded: str = "encoded") -> DataFrame:
    """``rows`` with ``encoded``: the column ``body``, a structure of the layout's type, as bytes."""
    at = rows.columns.index(body)

    def run(batches):
        for b in batches:
            blobs = [put(layout, x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blobs, pa.binary())], [*b.schema.names, encoded])

    typed = rows.withColumn(body, rows[body].cast(ddl(layout)))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema.fields), f"{encoded} binary"])
    return typed.mapInArrow(run, schema)


def decode_bodies(rows: DataFrame, encoded: str, layout, body: str = "body") -> DataFrame:
    """``rows`` with ``body``: the bytes of column ``encoded``, decoded by the layout. Bytes that are no valid encoding are an error."""
    at, kind = rows.columns.index(encoded), to_arrow_type(_parse_datatype_string(ddl(layout)))

    def run(batches):
        for b in batches:
            found = [get(layout, Reader(x)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, body])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{body}` {ddl(layout)}"])
    return rows.mapInArrow(run, schema)
