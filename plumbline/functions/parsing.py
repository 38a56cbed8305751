"""Lenient parsing and binning of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.masking import strip_space

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
NUMBER_START = r"^\s*[-+]?(?:[0-9.]|(?i:inf|nan))"
HASH_RANGE = 10000


def is_iso_date(c: Column) -> Column:
    """Format test only: ``2024-13-99`` passes."""
    return strip_space(c.cast("string")).rlike(ISO_DATE)


def parse_integer(c: Column) -> Column:
    return strip_space(c.cast("string")).try_cast("bigint")


def parse_number(c: Column) -> Column:
    """A double from text, else null. Text that cannot begin a number is told apart first,
    because a failing cast costs an exception per row."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_START), text.try_cast("double"))


def parse_time(c: Column, dtype: T.DataType) -> Column:
    """A timestamp from a typed column, or from text in one of the two known formats."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS])
    return c.cast("timestamp")


def as_number(c: Column, dtype: T.DataType) -> Column:
    """The value as a double where it parses, else a repeatable hash of its text below 10000."""
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    text = c.cast("string")
    hashed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % HASH_RANGE
    if isinstance(dtype, T.StringType):
        return F.coalesce(parse_number(c), hashed.cast("double"))
    return hashed.cast("double")


def equal_width_bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number 0..bins-1 over [low, high]; null when the range is a single point."""
    return F.floor(F.try_divide(v - low, high - low) * (bins - 1)).cast("int")
