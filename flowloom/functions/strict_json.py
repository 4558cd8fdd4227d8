"""JSON texts judged in columns: one whole value, the fields it must have and no others, types and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The value that a text is, as VARIANT; null if the text is no JSON, holds more than one value, or names a field of an object twice."""
    several = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(several) == 1, F.get(several, F.lit(0)))


def fields(value: Column) -> Column:
    """The fields of an object as a map of VARIANT; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """The items of an array as VARIANT; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def has_exactly(found: Column, *names: str) -> Column:
    """Whether a map of fields has these names and no others; false if there is no map."""
    return F.coalesce(F.array_sort(F.map_keys(found)) == F.array(*map(F.lit, sorted(names))), F.lit(False))


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def string(value: Column, least: int, most: int) -> Column:
    """The text of a VARIANT if it is a string of `least` to `most` UTF-16 units; else null."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.when(units(text).between(least, most), text)


def whole(value: Column, least: int, most: int) -> Column:
    """The number of a VARIANT if it is a whole one from `least` to `most`, however it is written; else null."""
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(value, "$", "double"))
    return F.when((number == F.floor(number)) & number.between(least, most), number.cast("int"))
