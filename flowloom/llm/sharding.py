"""Sharding by histogram sort.

Rows are ordered by (hash of text, doc_id), so equal texts are neighbours, and cut into shards of near-equal bytes.
The cuts (splitters) are found by counting: each round takes exact byte counts below candidate boundaries over all
partitions, keeps for each splitter the bucket that holds its target, and probes that bucket ten bits finer, until
a boundary lies within the tolerance or a bucket holds a single key. Then the rows are exchanged once.

A group of equal texts is cut only if neither of its edges is within group_slack of the target, so shards differ from the
mean by no more than twice that and a row at each end.
Only counts travel to the driver: at most (shards - 1) * 1024 rows a round.

A null text has zero bytes, a null doc_id sorts before all others; repeated rows are all kept; a very long text is never cut,
so a shard may exceed its share by it; further columns pass through (those named size, law, shard or slot are replaced).
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.support import written

RADIX_BITS = 10
KEY_BITS = 128
#: Parts of a shard in which its rows are numbered: this many, and more where they would have more rows.
SUBS, PART_ROWS = 32, 100_000
_LOW = -(1 << 63)


def _field(word: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _digit(done: int, bits: int) -> Column:
    """The next bits of the 128-bit key (k1, k2) after the first `done`."""
    parts, at, left = [], done, bits
    while left:
        word, inside = ("__k1", at) if at < 64 else ("__k2", at - 64)
        take = min(left, 64 - inside)
        parts.append((F.col(word), 64 - inside - take, take))
        at, left = at + take, left - take
    out = F.lit(0).cast("long")
    for word, shift, take in parts:
        out = F.shiftleft(out, take).bitwiseOR(_field(word, shift, take))
    return out


def _same_prefix(prefix: int, bits: int) -> Column:
    """Whether the first `bits` of the key equal `prefix`."""
    if bits == 0:
        return F.lit(True)
    test = _field(F.col("__k1"), 64 - min(bits, 64), min(bits, 64)) == F.lit(_signed(prefix >> max(0, bits - 64))) if bits < 64 else F.col("__k1") == F.lit(_signed(prefix >> (bits - 64)))
    if bits > 64:
        test &= _field(F.col("__k2"), 128 - bits, bits - 64) == F.lit(prefix & ((1 << (bits - 64)) - 1)) if bits < 128 else F.col("__k2") == F.lit(_signed(prefix & (2**64 - 1)))
    return test


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def splitters(keys: DataFrame, shards: int, weight: str, tolerance: float, group_slack: float) -> list[int]:
    """For shards - 1 cuts, the smallest 128-bit key of the right-hand side. keys: k1, k2 (both as unsigned words), weight."""
    total = keys.agg(F.sum(weight)).first()[0] or 0
    if not total:
        return []
    share = total / shards
    # of each open splitter: prefix of its bucket, weight before that bucket
    open_, cuts, done = {s: (0, 0) for s in range(1, shards)}, {}, 0
    while open_ and done < KEY_BITS:
        bits = min(RADIX_BITS, KEY_BITS - done)
        prefixes = sorted({p for p, _ in open_.values()})
        which = F.lit(None).cast("int")
        for i, p in enumerate(prefixes):
            which = F.when(_same_prefix(p, done), i).otherwise(which)
        seen = (
            keys.withColumn("which", which).where("which is not null").withColumn("digit", _digit(done, bits)).groupBy("which", "digit")
            .agg(F.sum(weight).alias("w"), F.min("__k1").alias("a"), F.max("__k1").alias("b"), F.min("__k2").alias("c"), F.max("__k2").alias("d"))
        )
        counts: dict[int, list] = {}
        for r in seen.collect():
            counts.setdefault(prefixes[r["which"]], []).append((r["digit"], r["w"], r["a"] == r["b"], r["a"] == r["b"] and r["c"] == r["d"]))
        done += bits
        still = {}
        for s, (prefix, before) in open_.items():
            target, at = share * s, before
            for digit, w, one_text, one_key in sorted(counts[prefix]):
                if at + w >= target or (prefix, digit) == (prefix, max(counts[prefix])[0]):
                    bucket = prefix << bits | digit
                    low, high = target - at, at + w - target
                    slack = group_slack if one_text and done <= 64 else tolerance  # a group's edges, or places within it
                    if one_key or min(low, high) <= slack * share or done >= KEY_BITS:
                        cuts[s] = (bucket if low <= high else bucket + 1) << (KEY_BITS - done)
                    else:
                        still[s] = (bucket, at)
                    break
                at += w
        open_ = still
    return [cuts[s] for s in sorted(cuts)]


def shard(docs: DataFrame, shards: int = 24, law: str = "bytes", text: str = "text", key: str = "doc_id", tolerance: float = 0.002, group_slack: float = 0.015) -> DataFrame:
    """docs with size, law, shard and slot (gapless from 0 within a shard). law: `bytes`, or `rows` for equal counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    flip = F.lit(_LOW)  # unsigned order as the order of words
    rows = docs.withColumn("size", (F.octet_length(body) + 8).cast("long")).withColumn("__k1", F.xxhash64(body)).withColumn("__k2", F.coalesce(F.col(key).cast("long"), flip).bitwiseXOR(flip))
    keys = written(rows.select("__k1", "__k2", (F.col("size") if law == "bytes" else F.lit(1).cast("long")).alias("weight")), "shard_keys")
    cuts = splitters(keys, shards, "weight", tolerance if law == "bytes" else 0.0, group_slack if law == "bytes" else 0.0)
    u1, u2 = F.col("__k1").bitwiseXOR(flip), F.col("__k2").bitwiseXOR(flip)
    at = F.lit(0)
    for c in cuts:
        if c >> KEY_BITS:
            continue  # nothing lies to the right of it
        a, b = _signed((c >> 64) ^ (1 << 63)), _signed((c & (2**64 - 1)) ^ (1 << 63))
        at = at + ((u1 > F.lit(a)) | ((u1 == F.lit(a)) & (u2 >= F.lit(b)))).cast("int")
    # slots: rows of a shard are numbered within parts, after the rows of the parts before
    subs = max(SUBS, -(-keys.count() // (shards * PART_ROWS)))
    part = F.pmod(F.xxhash64("__k1", "__k2", F.lit(7)), F.lit(subs)).cast("int")
    numbered = Window.partitionBy("shard", "__sub").orderBy("__k1", "__k2")
    parts = keys.select(at.alias("shard"), part.alias("__sub")).groupBy("shard", "__sub").count()
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("shard", "__sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))  # a row for PART_ROWS rows
    out = rows.withColumn("shard", at).withColumn("__sub", part).withColumn("__nth", F.row_number().over(numbered))
    out = out.join(F.broadcast(base), ["shard", "__sub"])
    return out.withColumn("law", F.lit(law)).withColumn("slot", (F.col("__base") + F.col("__nth") - 1).cast("long")).drop("__k1", "__k2", "__sub", "__nth", "__base")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard."""
    sharded.write.partitionBy("shard").parquet(path)
