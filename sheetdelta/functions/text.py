"""Text functions of the model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shape of a dimension text, and of a value with a unit.
DIMENSION = r"(?U)^\s*(\S{1,24})\s*=\s*(\d+(?:\.\d+)?\s*[a-zA-Z°%\"']{0,8})\s*$"
VALUE = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-z%]+)\s*$"


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb`` of shares of one; null if any is null.  Halves round to even."""
    part = lambda v: F.lpad(F.lower(F.hex(F.bround(v * 255).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def parse_dimension(text: Column) -> tuple[Column, Column]:
    """(label, value) of a dimension text; nulls for any other."""
    hit = text.rlike(DIMENSION)
    return F.when(hit, F.trim(F.regexp_extract(text, DIMENSION, 1))), F.when(hit, F.trim(F.regexp_extract(text, DIMENSION, 2)))


def capitalised(text: Column) -> Column:
    """First letter upper, rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.char_length(text))))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quoted(value: Column) -> tuple[Column, Column]:
    """(text, grounded): the value in quotes, or a notice if there is none."""
    some = value.isNotNull() & (value != "")
    some = F.coalesce(some, F.lit(False))
    return F.when(some, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.lit("value unavailable")), some
