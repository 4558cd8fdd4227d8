"""Text functions: trimming, value inference and Portuguese number formats."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def trim_all(c: Column) -> Column:
    """Without white space of any kind, byte-order mark included, at both ends."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def _bare_letters() -> tuple[str, str]:
    """Lower-case letters with accents, and what is left of each when these go."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if c == c.lower()]
    kept = [(c, d[0]) for c, d in pairs if "a" <= d[0] <= "z" and len(d) > 1]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


def folded(c: Column) -> Column:
    """Lower case without accents, and nothing but letters, digits, colon and underscore."""
    return F.regexp_replace(F.translate(F.lower(c), *_bare_letters()), "[^a-z0-9:_]", "")


def number_pt(x: Column, at_most: int, at_least: int = 0) -> Column:
    """1.234,5: half away from zero, between at_least and at_most decimals."""
    text = F.translate(F.format_number(F.round(x, at_most), at_most), ",.", ".,")
    if at_most == at_least:
        return text
    cut = F.regexp_replace(text, "0{1,%d}$" % (at_most - at_least), "")
    return F.regexp_replace(cut, ",$", "")


def count_pt(n: Column) -> Column:
    return F.translate(F.format_number(n, 0), ",", ".")


def days_pt(x: Column, at_most: int = 2) -> Column:
    return F.concat(number_pt(x, at_most), F.lit(" dias"))


def duration_pt(days: Column) -> Column:
    """Hours below a day, else days with one decimal."""
    return F.when(days < 1, F.concat(count_pt(F.round(days * 24)), F.lit(" h"))).otherwise(F.concat(number_pt(days, 1, 1), F.lit(" dias")))


# Short names of the months in Portuguese.
MONTHS = ["jan.", "fev.", "mar.", "abr.", "mai.", "jun.", "jul.", "ago.", "set.", "out.", "nov.", "dez."]


def timestamp_label(ms: Column) -> Column:
    """24 de jan. de 2026, 09:05: day and time (UTC) as shown in Portuguese."""
    t = F.timestamp_millis(ms)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(t))
    return F.concat(F.dayofmonth(t).cast("string"), F.lit(" de "), month, F.lit(" de "), F.date_format(t, "yyyy, HH:mm"))


def attribute_kind(raw: Column) -> Column:
    """null, bool, number or string."""
    t = trim_all(raw)
    return F.when(t.isNull() | (t == ""), "null").when(F.lower(t).isin("true", "false"), "bool").when(t.rlike(r"^-?[0-9]+([.,][0-9]+)?$"), "number").otherwise("string")


def attribute_number(raw: Column) -> Column:
    return F.when(attribute_kind(raw) == "number", F.replace(trim_all(raw), F.lit(","), F.lit(".")).try_cast("double"))


def timestamp_ms(raw: Column) -> Column:
    """ISO dates and times (UTC unless they say otherwise), or positive epoch seconds (below 1e10) or milliseconds; else null."""
    t = trim_all(raw)
    number = F.when(t.rlike(r"^[0-9]+([.][0-9]+)?$"), t.try_cast("double"))
    epoch = F.when(number > 0, F.floor(F.when(number < 1e10, number * 1000).otherwise(number)).cast("long"))
    iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.unix_millis(F.try_to_timestamp(t)))
    return F.coalesce(iso, epoch)


def lifecycle_name(raw: Column) -> Column:
    low = F.lower(trim_all(raw))
    return F.when(low.isin("start", "complete"), low).otherwise("unknown")
