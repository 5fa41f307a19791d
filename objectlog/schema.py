"""Schemas of the five tables of a log, and of its JSON form."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType, TimestampType


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _M = StringType(), MapType(StringType(), StringType())

EVENTS = _struct(eid=_S, activity=_S, ts=TimestampType(), attrs=_M)
OBJECTS = _struct(oid=_S, otype=_S)
E2O = _struct(eid=_S, oid=_S, otype=_S, qualifier=_S)
O2O = _struct(src_oid=_S, tgt_oid=_S, qualifier=_S)
CHANGES = _struct(oid=_S, otype=_S, ts=TimestampType(), changed_field=_S, attrs=_M)
TYPES = _struct(name=_S, attributes=ArrayType(_struct(name=_S, type=_S)))

_REL = ArrayType(_struct(objectId=_S, qualifier=_S))
#: The nested JSON document; values of any JSON type arrive as text.
DOCUMENT = _struct(
    eventTypes=ArrayType(TYPES),
    objectTypes=ArrayType(TYPES),
    events=ArrayType(_struct(id=_S, type=_S, time=_S, attributes=ArrayType(_struct(name=_S, value=_S)), relationships=_REL)),
    objects=ArrayType(_struct(id=_S, type=_S, relationships=_REL, attributes=ArrayType(_struct(name=_S, value=_S, time=_S)))),
)

#: Fixed values of the attribute type registry: declared name to Spark type.
ATTRIBUTE_TYPES = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "time": "timestamp"}
#: Fixed value: the time of values that hold from the start.
EPOCH = "1970-01-01T00:00:00Z"
