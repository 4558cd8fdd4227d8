"""Conformance of held-out cases to the training variants by trace alignment.

The cost of aligning two paths with unit moves is m + n - 2 * (length of their longest common subsequence), and no less than
what their bags of activities differ by. Only distinct paths are aligned. A path that also occurs in training costs nothing
and is found by a join. The others look for references in an index of the training bags, in rounds of growing radius: within
a radius r, two bags share one of the r + 1 rarest of their (activity, occurrence) pairs each, at places that leave
room for enough others, and their sizes differ by r at most. Candidates are verified by a bit-parallel LCS, as long as their
bags are no further than the best cost so far. A path is done when its best cost is within the radius. No path travels
through the driver, and a pair of paths is verified only if its bags let it be the best one.

Pairs of paths are many more than paths, so they exist in a task's memory only: what asks goes to blocks of references, once to
each. Of pairs of bags, three numbers are stored and shuffled and no text.

Moves are traced back for winning pairs only, in memory that grows with the length of a path and not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import text_id
from flowloom.operators.model import variants_in_order
from flowloom.schema import SEPARATOR
from flowloom.sources.scratch import discard, ship, written

FIRST_RADIUS, GROWTH = 2, 4
#: Paths of a bag in a piece of one side; references in a block; asked paths that are compared at once, and that wait in a task.
CHUNK, BLOCK, ASKED, WAITING, SALTS = 64, 1 << 14, 512, 1 << 18, 8
#: Rows of one side in a cell of a token; pairs of bags that meet in a task; references that a task verifies, once for each path that asks.
CELL, PAIRS, REFERENCES = 1024, 1 << 23, 1 << 24
#: Numbers of 64 bits in the sketch of a bag.
NUMBERS = 4
#: The number of tokens that no training bag holds.
UNKNOWN = -1
MOVES = "array<struct<kind:string,log_activity:string,model_activity:string,cost:int>>"


def bit_masks(path: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, symbol in enumerate(path):
        out[symbol] = out.get(symbol, 0) | 1 << i
    return out


def lcs_length(masks: dict[str, int], size: int, other: list[str]) -> int:
    """Longest common subsequence by the published bit-vector recurrence; masks: bits of each symbol's places in a path of `size`."""
    full = (1 << size) - 1
    v = full
    for symbol in other:
        u = v & masks.get(symbol, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def align(log: list[str], model: list[str]) -> list[tuple]:
    """(kind, log_activity, model_activity, cost) of an optimal alignment; equal steps go together, log moves come before model moves in the back-trace.

    A row of the table is a bit vector over the model's places, whose zeros up to j tell the common length up to j. Every
    sqrt(n)-th row is kept, and the rows between two of them are made again when the back-trace comes to them.
    """
    masks, full = bit_masks(model), (1 << len(model)) - 1
    step = max(1, math.isqrt(len(log)))

    def after(v: int, symbol: str) -> int:
        u = v & masks.get(symbol, 0)
        return ((v + u) | (v - u)) & full

    kept, v = [full], full
    for i, symbol in enumerate(log, 1):
        v = after(v, symbol)
        if i % step == 0:
            kept.append(v)
    i, j, out = len(log), len(model), []
    common, first, rows = j - v.bit_count(), i + 1, []  # of the first i and the first j; the rows from `first` on
    while i or j:
        if i and i - 1 < first:
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for symbol in log[first : i - 1]:
                rows.append(after(rows[-1], symbol))
        if i and j and log[i - 1] == model[j - 1]:
            i, j, common = i - 1, j - 1, common - 1
            out.append(("sync", log[i], model[j], 0))
        # as much in common without this event: it moves alone
        elif i and (not j or j - (rows[i - 1 - first] & ((1 << j) - 1)).bit_count() == common):
            i -= 1
            out.append(("log", log[i], None, 1))
        else:
            j -= 1
            out.append(("model", None, model[j], 1))
    return out[::-1]


# ---- the index of bags


def _with_bag(paths: DataFrame) -> DataFrame:
    """bag: the sorted activities as text; size: how many."""
    return paths.withColumn("bag", F.array_join(F.array_sort("path"), SEPARATOR)).withColumn("size", F.size("path"))


def _tokens(paths: DataFrame) -> DataFrame:
    """bag, size, token: (activity, occurrence) pairs of the distinct bags."""
    bags = paths.select("bag", "size", F.array_sort("path").alias("sorted")).dropDuplicates(["bag"])
    counted = bags.select("bag", "size", F.explode("sorted").alias("activity")).groupBy("bag", "size", "activity").count()
    return counted.select("bag", "size", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "count"), lambda k: F.concat_ws(SEPARATOR, "activity", k.cast("string")))).alias("token"))


def _numbered(tokens: DataFrame) -> DataFrame:
    """token, number: the rarest first, so that joins carry numbers and no texts. To be written, as ids of rows are."""
    return tokens.groupBy("token").count().orderBy("count", "token").select("token", F.monotonically_increasing_id().alias("number"))


def _ordered(tokens: DataFrame, numbers: DataFrame) -> DataFrame:
    """id, bag, size, tokens, sketch: numbers of the tokens, the rarest first. A token that no training bag holds is UNKNOWN, which comes first and meets nothing."""
    bags = tokens.join(numbers, "token", "left").groupBy("bag", "size").agg(F.array_sort(F.collect_list(F.coalesce("number", F.lit(UNKNOWN)))).alias("tokens"))
    return bags.select(F.monotonically_increasing_id().alias("id"), "bag", "size", "tokens", _sketch("tokens").alias("sketch"))


def _sketch(tokens: str) -> Column:
    """A bit for each token, at the place of its hash."""
    at = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(64 * NUMBERS)))
    bit = lambda t, k: F.when(F.floor(t / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (t % 64).cast("int"))).otherwise(0)
    number = lambda k: F.aggregate(at, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(bit(t, k)))
    return F.struct(*(number(k).alias(f"s{k}") for k in range(NUMBERS)))


def _least_apart(a: str, b: str) -> Column:
    """What two bags differ by at least: a bit that only one of their sketches has comes from a token that only one of them has."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))) for k in range(NUMBERS)))


def _prefix(bags: DataFrame, salt: Column, radius: Column) -> DataFrame:
    """The radius + 1 first tokens with their places; small bags have one more below UNKNOWN, which they share with all small ones."""
    tokens = F.transform(F.slice("tokens", F.lit(1), radius + 1), lambda t, i: F.struct(t.alias("token"), i.alias("at")))
    small = F.transform(salt, lambda s: F.struct((UNKNOWN - 1 - s).cast("long").alias("token"), F.lit(-1).alias("at")))
    return bags.withColumn("t", F.explode(F.concat(tokens, F.when(F.col("size") <= radius, small).otherwise(F.array().cast("array<struct<token:bigint,at:int>>"))))).select("*", "t.token", "t.at").drop("t")


def _cells(probe: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both sides dealt into the cells of each token, CELL rows of a side at most or so, and the tasks that the pairs of all cells want.

    A row of one side goes to one of its token's parts on its own side, and to all of the parts on the other.
    """
    sizes = probe.groupBy("token").agg(F.count("*").alias("p")).join(index.groupBy("token").agg(F.count("*").alias("q")), "token")
    sizes = written(sizes.select("token", "p", "q", F.ceil(F.col("p") / CELL).alias("rows"), F.ceil(F.col("q") / CELL).alias("columns")), "cells")
    load = sizes.agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0
    tasks = max(int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(load) // PAIRS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    dealt = sizes.drop("p", "q")
    probe = probe.join(dealt, "token").withColumn("row", one("id", "rows")).withColumn("column", every("columns")).drop("rows", "columns")
    index = index.join(dealt, "token").withColumn("column", one("ref_id", "columns")).withColumn("row", every("rows")).drop("rows", "columns")
    cell = ("token", "row", "column")
    return probe.repartition(tasks, *cell), index.repartition(tasks, *cell), tasks


def _near_bags(asked: DataFrame, known: DataFrame, radius: int, done: int) -> DataFrame:
    """id, ref_id, apart, asks, refs: pairs of bags that differ by more than `done` and by at most the asked bag's own radius (reach), and how many paths either has.

    Rows are few bytes and make many pairs, so the number of tasks follows the pairs: a task has PAIRS of them or so, however many
    there are. What decides on a pair travels with both bags, so that pairs are not shuffled.
    """
    probe = _prefix(asked, F.sequence(F.lit(0), F.lit(SALTS - 1)), F.col("reach"))
    index = _prefix(known, F.array(F.pmod(F.xxhash64("id"), F.lit(SALTS))), F.lit(radius))
    index = index.select("token", F.col("id").alias("ref_id"), "refs", *(F.col(c).alias(f"ref_{c}") for c in ("size", "at", "tokens", "sketch")))
    total, reach = F.col("size") + F.col("ref_size"), F.col("reach")
    least = F.ceil((total - reach) / 2)  # what they must share
    room = F.when(F.col("at") < 0, total <= reach).otherwise((F.col("at") <= F.col("size") - least) & (F.col("ref_at") <= F.col("ref_size") - least))
    probe, index, _ = _cells(probe, index)
    met = probe.join(index.hint("shuffle_hash"), ["token", "row", "column"]).where((F.abs(F.col("size") - F.col("ref_size")) <= reach) & room)
    met = met.where(_least_apart("sketch", "ref_sketch") <= reach)
    # of the tokens that bring two bags together, the first one tells of them
    shared = F.array_intersect(F.slice("tokens", F.lit(1), reach + 1), F.slice("ref_tokens", 1, radius + 1))
    met = met.where(F.when(F.col("at") < 0, F.size(shared) == 0).otherwise(F.get(shared, F.lit(0)) == F.col("token")))
    apart = total - 2 * F.size(F.array_intersect("tokens", "ref_tokens"))
    return met.where((apart > done) & (apart <= reach)).select("id", "ref_id", apart.alias("apart"), "asks", "refs")


class _References:
    """The references of a piece, which have one bag."""

    def __init__(self, ords: list[int], keys: list[str]) -> None:
        paths = [k.split(SEPARATOR) for _, k in sorted(zip(ords, keys, strict=True))]
        self.ords, self.paths, self.size = sorted(ords), paths, len(paths[0])
        self.symbols = {s: i for i, s in enumerate(dict.fromkeys(paths[0]))}
        self.places = np.array([[self.symbols[s] for s in p] for p in paths]).T

    def compare(self, waiting: list[tuple[int, list[str]]], best: dict[int, tuple]) -> None:
        """Puts what is nearest to each ask into best: (cost, ord, compared) by ask. A row of the bit-vector recurrence is one step for all pairs."""
        costs = []
        short = [p for _, p in waiting if len(p) < 64]
        if short:
            masks = np.array([self._masks(p) for p in short], np.uint64)
            sizes = np.array([[len(p)] for p in short])
            full = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
            v = np.repeat(full, len(self.ords), 1)
            for at in self.places:
                u = v & masks.take(at, 1)
                v = (v + u) | (v - u)  # what leaves the path's bits at the top does not come back
            found = self.size - sizes + 2 * np.bitwise_count(v & full).astype(np.int64)
            costs = zip(found.min(1).tolist(), found.argmin(1).tolist(), strict=True)
        costs = iter(costs)
        for ask, path in waiting:
            if len(path) < 64:
                cost, at = next(costs)
            else:
                masks = bit_masks(path)
                cost, at = min((len(path) + self.size - 2 * lcs_length(masks, len(path), p), i) for i, p in enumerate(self.paths))
            old = best.get(ask, (1 << 62, 0, 0))
            best[ask] = (*min(old[:2], (cost, self.ords[at])), old[2] + len(self.ords))

    def _masks(self, path: list[str]) -> list[int]:
        out = [0] * len(self.symbols)
        for i, s in enumerate(path):
            if (at := self.symbols.get(s)) is not None:
                out[at] |= 1 << i
        return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks, first the references and then who asks for which of them: the first of the best so far for each ask, and with how many it was compared.

    Those who wait are compared with the nearest bags first, and only as long as these are no further than their best cost.
    """
    at, refs, best, waiting, count = None, {}, {}, {}, 0

    def compare_all() -> None:
        for apart in sorted(waiting):
            for key, asks in waiting[apart].items():
                open_ = [(ask, path) for ask, known, path in asks if apart <= min(known, best.get(ask, (known,))[0])]
                if open_ and isinstance(refs[key], tuple):
                    refs[key] = _References(refs[key][0], refs[key][1].to_pylist())
                for n in range(0, len(open_), ASKED):
                    refs[key].compare(open_[n : n + ASKED], best)
        waiting.clear()

    for batch in batches:
        block, part, ref_id, piece = map(np_list, batch.columns[:4])
        paths, wanted = batch.columns[4:]
        starts, ids, known, keys = np_list(paths.offsets), np_list(paths.values.field(0)), np_list(paths.values.field(1)), paths.values.field(2)
        wants, of, number, aparts = np_list(wanted.offsets), *(np_list(wanted.values.field(i)) for i in range(3))
        for r in range(batch.num_rows):
            some = slice(starts[r], starts[r + 1])
            if at != (block[r], part[r]):
                compare_all()
                at, refs, count = (block[r], part[r]), {}, 0
            if wants[r] == wants[r + 1]:
                refs[ref_id[r], piece[r]] = ids[some], keys[some]
                continue
            asks = [*zip(ids[some], known[some], (k.split(SEPARATOR) for k in keys[some].to_pylist()), strict=True)]
            for n in range(wants[r], wants[r + 1]):
                waiting.setdefault(aparts[n], {}).setdefault((of[n], number[n]), []).extend(asks)
            count += len(asks) * (wants[r + 1] - wants[r])
            if count >= WAITING:
                compare_all()
                count = 0
        if len(best) > 100_000:
            yield _found(best)
            best.clear()
    compare_all()
    yield _found(best)


def _found(best: dict[int, tuple]) -> pa.RecordBatch:
    columns = [*zip(*((ask, *told) for ask, told in best.items()), strict=True)] or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)


_FOUND = pa.schema([(n, pa.int64()) for n in ("ask", "cost", "ord", "verified")])


def np_list(x: pa.Array) -> list[int]:
    return x.to_numpy(zero_copy_only=False).tolist()


def _path(id_: str, known: Column) -> Column:
    return F.struct(F.col(id_).alias("id"), known.cast("long").alias("known"), "path_key")


def nearest_variants(validation: DataFrame, train: DataFrame) -> DataFrame:
    """path_key, cost, reference, verified: for each distinct held-out path the cheapest training path, and with how many it was compared.

    Ties go by collated path, then by first case. Without training paths there is no row.
    """
    spark = validation.sparkSession
    ship(spark)
    asked = validation.select("path_key", "path").dropDuplicates(["path_key"])
    # after a total sort the ids of rows rise with their places
    in_order = variants_in_order(train).orderBy(F.collate("path_key", "UNICODE"), "first_case", F.col("path_key"))
    known = written(_with_bag(in_order.select("path_key", "path").withColumn("ord", F.monotonically_increasing_id())), "variants")
    keys = known.select("path_key")
    same = asked.join(keys, "path_key", "left_semi").select("path_key", F.lit(0).cast("long").alias("cost"), F.col("path").alias("reference"), F.lit(0).cast("long").alias("verified"))
    other = written(_with_bag(asked.join(keys, "path_key", "left_anti").withColumn("ask", F.monotonically_increasing_id())), "held_out")
    (_, long_ref), (open_, long_ask) = (df.agg(F.count("*"), F.max("size")).first() for df in (known, other))
    if long_ref is None or long_ask is None:
        return same
    longest = long_ref + long_ask
    tokens = _tokens(known)
    numbers = written(_numbered(tokens), "tokens")
    index, probes = written(_ordered(tokens, numbers), "bags"), written(_ordered(_tokens(other), numbers), "held_out_bags")
    asks = written(other.join(probes.select("bag", "id"), "bag").select("ask", "path_key", "id"), "asks")
    sized = known.groupBy("bag").agg(F.count("*").alias("refs"))
    index = written(index.join(sized, "bag"), "index")
    pieces = lambda n: F.ceil(F.col(n) / CHUNK)
    piece = F.pmod(F.xxhash64("ord"), pieces("refs"))
    refs = known.join(index.select("bag", F.col("id").alias("ref_id"), "refs"), "bag")
    blocks = -(-known.count() // BLOCK)
    block = F.pmod(F.xxhash64("ref_id", "piece"), F.lit(blocks))
    chunks = written(refs.groupBy("ref_id", piece.alias("piece")).agg(F.collect_list(_path("ord", F.lit(0))).alias("paths")), "references")
    index, probes = index.drop("bag"), probes.drop("bag")
    best, radius, done = None, FIRST_RADIUS, -1
    while True:
        left = asks
        left = left.withColumn("known", F.lit(None).cast("long")) if best is None else left.join(best.select("ask", F.col("cost").alias("known")), "ask", "left").where(F.col("known").isNull() | (F.col("known") > done))
        left = left.withColumn("known", F.coalesce("known", F.lit(1 << 40)))
        same_bag = left.groupBy("id").agg(F.count("*").alias("asks"), F.least(F.max("known"), F.lit(radius)).cast("int").alias("reach"))
        reach = written(probes.join(same_bag, "id"), "reach")
        met = written(_near_bags(reach, index, radius, done), "met")
        part = F.pmod(F.xxhash64("ask"), pieces("asks"))
        asking = left.join(same_bag, "id").groupBy("id", part.alias("ask_piece")).agg(F.collect_list(_path("ask", F.col("known"))).alias("paths"))
        # small rows with much work in them: their number of tasks is not left to their bytes
        parts = max(1, -(-(met.agg(F.sum(F.col("asks") * F.col("refs"))).first()[0] or 0) // (blocks * REFERENCES)))
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * parts)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        wants = met.select("id", "ref_id", every(pieces("refs")).alias("piece"), F.col("apart").cast("long").alias("apart"))
        wants = wants.groupBy("id", block.alias("block")).agg(F.collect_list(F.struct("ref_id", "piece", "apart")).alias("wanted"))
        asked = wants.join(asking, "id").select("block", F.pmod(F.xxhash64("id", "ask_piece"), F.lit(parts)).alias("part"), F.lit(-1).cast("long").alias("ref_id"), F.lit(-1).cast("long").alias("piece"), "paths", "wanted")
        none = F.array().cast(asked.schema["wanted"].dataType)
        rows = chunks.select(block.alias("block"), every(F.lit(parts)).alias("part"), "ref_id", "piece", "paths", none.alias("wanted")).unionByName(asked)
        found = rows.repartition(tasks, "block", "part").sortWithinPartitions("block", "part", F.size("wanted") > 0).mapInArrow(_verify, "ask long, cost long, ord long, verified long")
        if best is not None:
            found = found.unionByName(best)
        before, best = best, written(found.groupBy("ask").agg(F.min(F.struct("cost", "ord")).alias("b"), F.sum("verified").alias("verified")).select("ask", "b.cost", "b.ord", "verified"), "nearest")
        discard(reach, met, before)
        if radius >= longest or best.where(F.col("cost") <= radius).count() == open_:
            break
        radius, done = min(radius * GROWTH, longest), radius
    discard(numbers, chunks)
    told = best.join(asks.select("ask", "path_key"), "ask").join(known.select("ord", F.col("path").alias("reference")), "ord")
    return same.unionByName(told.select("path_key", "cost", "reference", "verified"))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("log_activity", pa.string()), ("model_activity", pa.string()), ("cost", pa.int32())]))
    for batch in batches:
        for r in range(batch.num_rows):
            moves = [dict(zip(("kind", "log_activity", "model_activity", "cost"), m, strict=True)) for m in align(batch.column(1)[r].as_py(), batch.column(2)[r].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([moves], kind)], names=["path_key", "moves"])


def alignments(cases: DataFrame, moves: bool = True) -> DataFrame:
    """For each held-out case: cost, fitness, reference path, and the moves if asked for. cases: traces with is_validation, read several times."""
    validation, train = cases.where("is_validation"), cases.where("not is_validation")
    nearest = nearest_variants(validation, train)
    fitness = F.greatest(F.lit(0.0), 1 - F.col("cost") / F.greatest(F.lit(1), F.size("path") + F.size("reference")))
    told = validation.select("case_id", "path_key", "path").join(nearest, "path_key")
    if moves:
        pairs = validation.select("path_key", "path").dropDuplicates(["path_key"]).join(nearest, "path_key").select("path_key", "path", "reference")
        told = told.join(pairs.mapInArrow(_traced, f"path_key string, moves {MOVES}"), "path_key")
    return told.select(
        "case_id", text_id("variant", F.col("path_key")).alias("variant_id"), text_id("variant", F.array_join("reference", SEPARATOR)).alias("reference_variant_id"),
        "cost", fitness.alias("fitness"), (F.col("cost") > 0).alias("is_deviation"), *(["moves"] if moves else []),
    )


def pairs(paths: DataFrame) -> DataFrame:
    """Distinct directly-follows pairs of paths."""
    from flowloom.operators.profile import follows

    return follows(paths.select("path_key", "path").dropDuplicates(["path_key"])).select("from_activity", "to_activity")


def coverage(cases: DataFrame) -> DataFrame:
    """precision: share of the training pairs that held-out cases show; generalization: the reverse. One where there are no pairs."""
    train, held = pairs(cases.where("not is_validation")), pairs(cases.where("is_validation"))
    both = train.withColumn("t", F.lit(1)).join(held.withColumn("h", F.lit(1)), ["from_activity", "to_activity"], "full")
    n = both.agg(F.count("t").alias("t"), F.count("h").alias("h"), F.count_if(F.col("t").isNotNull() & F.col("h").isNotNull()).alias("both"))
    share = lambda c: F.when(F.col(c) > 0, F.col("both") / F.col(c)).otherwise(1.0)
    return n.select(share("t").alias("precision"), share("h").alias("generalization"))


def summary(cases: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """One row for the whole held-out set. cases: traces with is_validation, read several times; `aligned` if they are aligned already."""
    aligned = alignments(cases, moves=False) if aligned is None else aligned
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    told = aligned.agg(
        F.count("*").alias("aligned_cases"), F.count_if("is_deviation").alias("deviating_cases"), zero(F.avg(F.col("is_deviation").cast("double"))).alias("deviation_rate"),
        zero(F.avg("cost")).alias("mean_cost"), zero(F.percentile("cost", 0.5)).alias("median_cost"), F.coalesce(F.avg("fitness"), F.lit(1.0)).alias("fitness"),
    )
    sizes = cases.agg(F.count_if(~F.col("is_validation")).alias("train_cases"), F.count_if("is_validation").alias("validation_cases"))
    return told.crossJoin(coverage(cases)).crossJoin(sizes)
