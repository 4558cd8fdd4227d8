"""Line dedup with a sharded minimal perfect hash.

A line's key is the line without blanks at its ends, A-Z in lower case. Keys of at least min_chars code points that
two documents hold keep their lines only in the smallest doc_id that holds them.

1. Keys are counted as 96-bit hashes, once for each document: count, smallest and largest doc_id.
2. For the hashes that several documents hold, each shard builds a minimal perfect hash (levels of bits where a key
   stands alone) that indexes arrays of fingerprints, counts and smallest doc_ids.
3. Documents probe: the hashes of their lines go to the shards, texts and lines do not, and verdicts come back.
   Hashes that more than one in HOT_SHARE lines hold are answered at once in the documents' tasks: by that
   threshold they are HOT_SHARE at most, however large the corpus is. Shards with more frequent keys below that share
   are asked in parts of about SHARD_REFS references, each with the shard's arrays.

Nulls: a null text is one empty line; null doc_ids count as one document that comes last. Rows with the same doc_id are
one document, so lines that only they share stay. Further columns pass through; n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.support import written

MIN_CHARS = 10
BLANKS = b" \t\n\x0b\x0c\r"
HOT_SHARE = 20_000
LAST_DOC = 2**63 - 1
SHARD_REFS, SHARD_KEYS, MIN_SHARDS = 500_000, 50_000, 256
GAMMA = 1.5
REF = ["doc", "part", "lo", "hi"]


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _counts(key: bytes, min_chars: int) -> bool:
    return len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96-bit hashes as (64 bits, 32 bits)."""
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, keys)), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 1].view(np.int64), (both[:, 0] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def _mix(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    x = lo.view(np.uint64) ^ (hi.view(np.uint32).astype(np.uint64) << np.uint64(17)) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fingerprint(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (hi.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (lo.view(np.uint64) & np.uint64(0xFFFFFFFF))


class PerfectHash:
    """Minimal perfect hash over distinct (lo, hi). Level by level, keys that are alone at their bit stay there."""

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, lo: np.ndarray, hi: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(lo):
            m = max(8, int(GAMMA * len(lo)))
            at = (_mix(lo, hi, len(sizes)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, dtype=np.uint8)
            bits[at[alone]] = 1
            sizes.append(m)
            levels.append(bits)
            lo, hi = lo[~alone], hi[~alone]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=np.uint8))

    def index(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each key; any place or -1 for what is no key."""
        out, start, open_ = np.full(len(lo), -1, dtype=np.int64), 0, np.arange(len(lo))
        for level, m in enumerate(self.sizes):
            at = (_mix(lo[open_], hi[open_], level) % np.uint64(m)).astype(np.int64) + start
            hit = self.bits[at] == 1
            out[open_[hit]] = self.ranks[at[hit]]
            open_, start = open_[~hit], start + m
        return out


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    """The arrays of a shard as one row."""
    lo, hi = shard["lo"].to_numpy(np.int64), shard["hi"].to_numpy(np.int32)
    mph = PerfectHash.build(lo, hi)
    at = mph.index(lo, hi)
    fingerprints, counts, first = np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    fingerprints[at], counts[at], first[at] = _fingerprint(lo, hi), shard["n"], shard["first"]
    return pd.DataFrame({"shard": shard["shard"].iloc[:1], "salts": [1 + int(shard["n"].sum()) // SHARD_REFS], "sizes": [mph.sizes], "bits": [np.packbits(mph.bits).tobytes()], "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()], "first": [first.tobytes()]})


BUILT = "shard int, salts int, sizes array<long>, bits binary, fingerprints binary, counts binary, first binary"


def _probe(refs: pd.DataFrame, built: pd.DataFrame) -> pd.DataFrame:
    """The references whose line another document with a smaller doc_id holds."""
    if not len(refs) or not len(built):
        return refs.iloc[:0][REF]
    row = built.iloc[0]
    sizes = list(row["sizes"])
    mph = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)])
    lo, hi = refs["lo"].to_numpy(np.int64), refs["hi"].to_numpy(np.int32)
    at = mph.index(lo, hi)
    fingerprints, counts, first = (np.frombuffer(row[c], t) for c, t in (("fingerprints", np.uint64), ("counts", np.int64), ("first", np.int64)))
    found = (at >= 0) & (fingerprints[at] == _fingerprint(lo, hi)) & (counts[at] > 1) & (first[at] < refs["doc"].to_numpy(np.int64))
    return refs.loc[found, REF]


def _refs(docs: DataFrame, min_chars: int, hot: set[tuple[int, int]]) -> DataFrame:
    """(doc, part, lo, hi) of each document's distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for text in batch.column(2):
                own = {k for k in map(line_key, (text.as_py() or "").encode().split(b"\n")) if _counts(k, min_chars)}
                keys.extend(own)
                sizes.append(len(own))
            lo, hi = _hashes(keys)
            ids, parts = (np.repeat(np.asarray(batch.column(i), dtype=np.int64), sizes) for i in (0, 1))
            if hot:
                cold = np.fromiter((x not in hot for x in zip(lo.tolist(), hi.tolist(), strict=True)), dtype=bool, count=len(lo))
                ids, parts, lo, hi = ids[cold], parts[cold], lo[cold], hi[cold]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(parts), pa.array(lo), pa.array(hi)], names=REF)

    return docs.mapInArrow(run, "doc long, part long, lo long, hi int")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the kept lines as text, n_lines (before) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    # documents without an id are one, but each text of them gets its verdicts by itself
    part = F.when(F.col(key).isNull(), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).otherwise(F.lit(0).cast("long"))
    pairs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST_DOC)).alias("doc"), part.alias("part"), F.col(text).alias("text"))
    total = pairs.agg(F.sum(F.size(F.split("text", "\n")))).first()[0] or 0  # lines, for the sizes of shards
    keys = _refs(pairs, min_chars, set()).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    keys = written(keys.where("first < last").drop("last"), "line_keys")
    n_keys = keys.count()
    hot_rows = keys.where(F.col("n") > max(16, total // HOT_SHARE)).collect()  # HOT_SHARE rows at most
    hot = {(r["lo"], r["hi"]): r["first"] for r in hot_rows}
    shards = max(MIN_SHARDS, total // SHARD_REFS, n_keys // SHARD_KEYS)
    at = lambda: F.pmod(F.xxhash64("lo"), F.lit(shards)).cast("int")
    built = written(keys.withColumn("shard", at()).groupBy("shard").applyInPandas(_build, BUILT), "line_arrays")
    asked = _refs(pairs, min_chars, set(hot)).withColumn("shard", at())
    # a shard whose shared keys alone make up more than SHARD_REFS references is asked in several parts; there are as many
    # such shards as lines / SHARD_REFS at most
    split = built.where("salts > 1").select("shard", "salts")
    asked = asked.join(F.broadcast(split), "shard", "left").withColumn("salt", F.pmod(F.xxhash64("doc", "part"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = built.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    verdicts = asked.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(_probe, "doc long, part long, lo long, hi int")
    drops = written(verdicts.groupBy("doc", "part").agg(F.collect_set(F.struct("lo", "hi")).alias("__drops")), "line_drops")

    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, drops_, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("__doc", "__drops", text))
            kept, n_lines, n_dropped = [], [], []
            for doc, gone, body in zip(docs_.to_pylist(), drops_, texts, strict=True):
                body = body.as_py() or ""
                lines = body.encode().split(b"\n")
                n_lines.append(len(lines))
                keys = [(i, k) for i, k in enumerate(map(line_key, lines)) if _counts(k, min_chars)]
                own = {(g["lo"], g["hi"]) for g in gone.as_py() or ()}
                lo, hi = _hashes([k for _, k in keys])
                bad = {i for (i, _), x in zip(keys, zip(lo.tolist(), hi.tolist(), strict=True), strict=True) if x in own or hot.get(x, LAST_DOC) < doc}
                n_dropped.append(len(bad))
                kept.append(b"\n".join([x for i, x in enumerate(lines) if i not in bad]).decode() if bad else body)
            new = {text: pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            all_names = [*names, "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(batch.schema.get_field_index(c)) for c in all_names], names=all_names)

    joined = docs.withColumn("__doc", F.coalesce(F.col(key).cast("long"), F.lit(LAST_DOC))).withColumn("__part", part).join(drops.withColumnsRenamed({"doc": "__doc", "part": "__part"}), ["__doc", "__part"], "left")
    return joined.mapInArrow(run, schema)
