"""The four column types, their literals, and dates and decimals at the boundary.

INT32 may carry a date as days since 1970-01-01 and INT64 a decimal as a scaled
integer. That is a convention: columns are converted where they enter and leave.
"""

from __future__ import annotations

import datetime
import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import EngineError

INT32, INT64, DOUBLE, STRING = "INT32", "INT64", "DOUBLE", "STRING"

SPARK_TYPES: dict[str, T.DataType] = {INT32: T.IntegerType(), INT64: T.LongType(), DOUBLE: T.DoubleType(), STRING: T.StringType()}
_NAMES = {"int": INT32, "bigint": INT64, "double": DOUBLE, "string": STRING}


def type_of(data_type: T.DataType, column: str = "") -> str:
    """The engine's name of a Spark type."""
    name = _NAMES.get(data_type.simpleString())
    if name is None:
        raise EngineError(f"column {column or '?'} has type {data_type.simpleString()}; expressions take int, bigint, double and string")
    return name


def literal_type(value: object) -> str:
    """The type of a Python literal; whole numbers are INT32 where they fit."""
    if isinstance(value, bool) or value is None:
        raise EngineError(f"{value!r} is not a literal of any type")
    if isinstance(value, int):
        if -(2**31) <= value < 2**31:
            return INT32
        if -(2**63) <= value < 2**63:
            return INT64
        raise EngineError(f"{value} does not fit into 64 bits")
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return STRING
    raise EngineError(f"{value!r} is not a literal of any type")


def coerce(value: object, to: str) -> object:
    """A literal as a value of type ``to``, or an error where that would change it."""
    have = literal_type(value)
    if have == to:
        return value
    if to == DOUBLE and have in (INT32, INT64):
        return float(value)
    if to in (INT32, INT64) and have in (INT32, INT64, DOUBLE):
        if have == DOUBLE and (not math.isfinite(value) or value != int(value)):
            raise EngineError(f"{value} is not a whole number; the column is {to}")
        whole, bits = int(value), 31 if to == INT32 else 63
        if -(2**bits) <= whole < 2**bits:
            return whole
        raise EngineError(f"{value} does not fit into {to}")
    raise EngineError(f"literal {value!r} cannot be compared with a {to} column")


def parse_literal(text: str, to: str) -> object:
    """A command-line literal by the column's type.

    Numbers are read from the start of the text, as C's ``strtol`` and
    ``strtod`` do; text without one is 0.
    """
    if to == STRING:
        return text
    import re

    pattern = r"\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))" if to == DOUBLE else r"\s*([+-]?\d+)"
    m = re.match(pattern, text)
    if to == DOUBLE:
        return float(m[1]) if m else 0.0
    bits = 31 if to == INT32 else 63
    return max(-(2**bits), min(2**bits - 1, int(m[1]))) if m else 0


def format_value(value: object) -> str:
    """A value as plans and reports print it."""
    if value is None:
        return "NULL"
    return f"{value:.17g}" if isinstance(value, float) else str(value)


def payload_is_set(value: object) -> bool:
    """Whether a literal in predicate position keeps every row: any bit of its number is set."""
    if isinstance(value, str):
        raise EngineError("a string literal is not a predicate")
    return struct.pack("<d", value) != bytes(8) if isinstance(value, float) else value != 0


def date_to_int32(column: Column | str) -> Column:
    """A date or timestamp as days since 1970-01-01. Filter before converting: this form isn't pushed to the scan."""
    return F.unix_date(F.to_date(F.col(column) if isinstance(column, str) else column))


def int32_to_date(column: Column | str) -> Column:
    return F.date_from_unix_date(column)


def days(date: datetime.date) -> int:
    """A date literal as INT32."""
    return (date - datetime.date(1970, 1, 1)).days


def decimal_to_int64(column: Column, scale: int) -> Column:
    """A decimal as a scaled integer; digits beyond ``scale`` are rounded half up."""
    return F.round(column.cast(T.DecimalType(38, 18)) * (10**scale), 0).cast("long")


def int64_to_decimal(column: Column, scale: int) -> Column:
    return (column.cast(T.DecimalType(38, 0)) / F.lit(10**scale)).cast(T.DecimalType(18, scale))
