"""A 64-bit text id in column form: two 32-bit xor-and-multiply folds over the UTF-16 units of a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.schema import SEPARATOR

# Seeds and factors of the two folds.
SEEDS = 0x811C9DC5, 0x9E3779B9
FACTORS = 0x01000193, 0x85EBCA6B
WORD = 0xFFFFFFFF


def _units(text: Column) -> Column:
    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("long"))


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32 without leaving 63 bits."""
    high = (F.shiftright(x, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF))
    return (high * F.lit(0x10000) + x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)).bitwiseAND(F.lit(WORD))


def hash_half(text: Column, which: int) -> Column:
    """The first or second half as a number."""
    return F.aggregate(_units(text), F.lit(SEEDS[which]).cast("long"), lambda a, c: _times(a.bitwiseXOR(c), FACTORS[which]))


def stable_hash(text: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(hash_half(text, i)), 8, "0") for i in (0, 1))))


def text_id(kind: str, *parts: Column) -> Column:
    """kind:hash of the parts, joined by the unit separator."""
    return F.concat(F.lit(f"{kind}:"), stable_hash(F.concat_ws(SEPARATOR, *parts)))


def stable_hash_of(text: str) -> str:
    """The same for one Python string."""
    units = text.encode("utf-16-be")
    out = ""
    for seed, factor in zip(SEEDS, FACTORS, strict=True):
        h = seed
        for i in range(0, len(units), 2):
            h = (h ^ int.from_bytes(units[i : i + 2], "big")) * factor & WORD
        out += f"{h:08x}"
    return out
