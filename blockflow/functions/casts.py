"""CAST targets of APPLY: INT, VARCHAR and DATETIME, strict about what they take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The time formats that text may have.
TIME_FORMATS = ("2006-01-02T15:04:05Z07:00", "2006-01-02T15:04:05.999999999Z07:00", "YYYY-MM-DDTHH:MM:SSZ")
_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def refuse(message: Column | str) -> Column:
    return F.raise_error(message if isinstance(message, Column) else F.lit(message))


def parse_time(c: Column) -> Column:
    """Timestamp of text in one of TIME_FORMATS; other text is an error, null stays null."""
    good = F.when(c.rlike(_TIME), F.to_timestamp(c))
    return F.when(c.isNull(), F.lit(None).cast("timestamp")).when(c.rlike(_TIME), good).otherwise(refuse(F.concat(F.lit("cannot parse time '"), c, F.lit("'; formats are " + ", ".join(TIME_FORMATS)))).cast("timestamp"))


def instant(c: Column, kind: T.DataType) -> Column:
    """Timestamp of a text or time column."""
    if isinstance(kind, T.StringType):
        return parse_time(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    raise TypeError(f"a time must be text or a timestamp, not {kind.simpleString()}")


def to_int(c: Column, kind: T.DataType) -> Column:
    """BIGINT: fractions are cut off, text must be a plain decimal integer, times give Unix seconds."""
    if isinstance(kind, T.StringType):
        return F.when(c.isNull() | c.rlike(r"^[+-]?[0-9]+$"), c.cast("bigint")).otherwise(refuse(F.concat(F.lit("not an integer: "), c)).cast("bigint"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_seconds(c.cast("timestamp"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("bigint")
    raise TypeError(f"cannot cast {kind.simpleString()} to INT")


def to_varchar(c: Column, kind: T.DataType) -> Column:
    """STRING: floating numbers with six decimals, times as RFC 3339 in UTC without trailing zeros."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.format_string("%.6f", c.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def to_datetime(c: Column, kind: T.DataType) -> Column:
    """TIMESTAMP: text by parse_time, integers as Unix seconds; other kinds are refused."""
    if isinstance(kind, T.IntegralType):
        return F.timestamp_seconds(c)
    return instant(c, kind)


CASTS = {"int": to_int, "varchar": to_varchar, "datetime": to_datetime}
