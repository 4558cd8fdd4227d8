"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with every run of white space as one blank. An item of m characters may be edited in
k = floor(error_rate * m) characters. It is split into k + 1 pieces: if it occurs in a document with at most k edits, one
piece occurs exactly. One automaton finds all piece hits of a document, and the text around each hit is verified with
Myers' bit-parallel edit distance.

The items go to the tasks in blocks of at most BLOCK_BYTES of text, so a benchmark of any size is matched, with a pass
over the documents for each block.

Nulls: null texts count as empty. Items of fewer than min_chars characters take no part. A null doc_id or item_id is
kept; ids may be of any simple type. Repeated documents give their rows again; repeated items with one item_id give the
smaller distance, and of equal ones the first place. Texts of any length are searched whole, one at a time. Other columns are
ignored by matches() and kept by without_leaks(), whatever their names. Without items, or without texts, there are no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ERROR_RATE, MIN_CHARS = 0.08, 16
BLOCK_BYTES = 16_000_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[str, int]]:
    """errors + 1 pieces of near-equal length, with their offsets."""
    cuts = [len(item) * j // (errors + 1) for j in range(errors + 2)]
    return [(item[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def pattern_bits(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def myers(bits: dict[str, int], m: int, text: str, low: int, high: int) -> tuple[int, int]:
    """(distance, end) of the occurrence in text[low:high] with the fewest edits; the first of equals."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, low
    for j in range(low, high):
        eq = bits.get(text[j], 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp = vn | (full & ~(d0 | vp))
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & full  # an occurrence may begin anywhere: nothing is shifted in
        hn = (hn << 1) & full
        vp = hn | (full & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float) -> None:
        import ahocorasick

        self.items = [(i, t, int(error_rate * len(t))) for i, t in items]
        self.bits: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for piece, at in pieces(text, errors):
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int | None, tuple[int, int]]:
        """item_id -> (distance, end in the normalised text)."""
        text = normalise(text)
        windows: dict[int, list[list[int]]] = {}
        for stop, (size, where) in self.automaton.iter(text) if len(self.automaton) else ():
            for n, at in where:
                _, item, errors = self.items[n]
                start = stop + 1 - size - at
                low, high = max(0, start - errors), min(len(text), start + len(item) + errors)
                own = windows.setdefault(n, [])
                if own and low <= own[-1][1] and high >= own[-1][0]:
                    own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
                else:
                    own.append([low, high])
        found: dict[int | None, tuple[int, int]] = {}
        for n, spans in windows.items():
            key, item, errors = self.items[n]
            for low, high in spans:
                at = text.find(item, low, high)
                if at >= 0:
                    got = 0, at + len(item)
                else:
                    if n not in self.bits:
                        self.bits[n] = pattern_bits(item)
                    got = myers(self.bits[n], len(item), text, low, high)
                if got[0] <= errors and (key not in found or got < found[key]):
                    found[key] = got
        return found


def _blocks(items: DataFrame, text: str, key: str, min_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The normalised items, block by block."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") >= min_chars)
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + 2 * size // BLOCK_BYTES
    for i in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i)
        yield [(r["k"], t) for r in block.collect() if len(t := normalise(r["t"])) >= min_chars]


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """doc_id, item_id, distance, stop: each item that a document holds with at most its edits; the best occurrence."""
    ids, kind = docs.schema[key], items.schema[item_key].dataType
    arrow = to_arrow_type(kind)
    schema = T.StructType([ids, T.StructField(item_key, kind), T.StructField("distance", T.IntegerType()), T.StructField("stop", T.LongType())])
    out = None
    for block in _blocks(items, text, item_key, min_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for batch in batches:
                rows, where, far, stops = [], [], [], []
                for i, t in enumerate(batch.column(1)):
                    for item, (distance, stop) in matcher.find(t.as_py()).items():
                        rows.append(i)
                        where.append(item)
                        far.append(distance)
                        stops.append(stop)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(where, arrow), pa.array(far, pa.int32()), pa.array(stops, pa.int64())], names=[key, item_key, "distance", "stop"])

        found = docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The documents that hold no item."""
    for block in _blocks(items, text, item_key, min_chars):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for batch in batches:
                clean = [not matcher.find(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
