"""Hard negatives by blocked dense products.

Vectors are packed once into blocks of integers. Anchors travel to the tasks in blocks of bounded size, one at a time, and each
task multiplies them with its candidate blocks. A first pass finds each anchor's best rows of its own label, its positives;
a second one finds, for each positive, the best rows of other labels whose score lies in a window told by the positive's.
Tasks keep only the best of what they have seen, so they send back a few rows for each anchor, and the bests of several tasks
merge into the best of all. Products are float64 matrix products while no sum can reach 2^53, and integer ones beyond.

Rows with a null id, label or vector, or with a null or non-finite component, take no part, and neither do vectors whose
length is not the commonest (of equally common lengths the greatest). Scores that could leave 64 bits, and components of 2^54
or more, are an error. An anchor id given several times is asked once, with its smallest label and vector; rows that bear its
id are no positives of it. Repeated rows are candidates each, and each is a positive of its own, told apart by
positive_rank. Ties go to the smaller id. A label that is no integer is compared by a 64-bit hash. Columns other than the
three named are ignored, whatever their names. An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from flowloom.llm.support import scratch_path, ship, written

CANDIDATE_ROWS = 2_048
#: Bytes of the vectors of one anchor block, as float64; and cells of one product.
ANCHOR_BYTES, CELLS = 1 << 24, 1 << 20
EXACT = 1 << 53
PACKED = "rows int, kind string, ids binary, labels binary, x binary"
POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long"
RESULT = "anchor_id long, positive_rank int, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vectors: DataFrame, key: str, column: str, label: Column) -> DataFrame:
    """vec_id, label, embedding of the rows that take part, of all lengths."""
    v = F.col("embedding")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), label.alias("label"), F.col(column).alias("embedding"))
    if not isinstance(rows.schema["label"].dataType, IntegralType):
        rows = rows.withColumn("label", F.when(F.col("label").isNotNull(), F.xxhash64("label")))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)


def smallest_kind(x: np.ndarray) -> str:
    """The narrowest integer type that holds all of x."""
    top = max(-int(x.min()), int(x.max()) + 1) if x.size else 0
    return next(k for k, bits in (("i1", 7), ("i2", 15), ("i4", 31), ("i8", 63)) if top <= 1 << bits)


class Block:
    """Ids, labels and integer vectors of some rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.top = int(np.abs(x).max()) if x.size else 0

    @classmethod
    def read(cls, packed: list[tuple], dims: int) -> Block:
        ids, labels, x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, dims))]
        for rows, kind, i, lab, v in packed:
            ids.append(np.frombuffer(i, np.int64))
            labels.append(np.frombuffer(lab, np.int64))
            x.append(np.frombuffer(v, kind).reshape(rows, dims))
        # as float64 where that is exact
        whole = np.concatenate([a.astype(np.int64) for a in x])
        return cls(np.concatenate(ids), np.concatenate(labels), whole if whole.size and np.abs(whole).max() >= EXACT else whole.astype(np.float64))

    def take(self, rows: np.ndarray | slice) -> Block:
        return Block(self.ids[rows], self.labels[rows], self.x[rows])


def product(a: Block, b: Block) -> np.ndarray:
    """All inner products, exact: float64 where no sum can reach 2^53, else 64-bit integers."""
    bound = a.x.shape[1] * a.top * b.top
    if bound < EXACT:
        return a.x @ b.x.T
    if bound >= 1 << 63:
        raise ValueError("inner products may leave 64 bits")
    return a.x.astype(np.int64) @ b.x.astype(np.int64).T


class Best:
    """The k best (score, id) of each slot, best first, smaller ids first among equals."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.bar = k, np.full(slots, np.iinfo(np.int64).min)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = score.astype(np.int64)
        may = score >= self.bar[slot]
        if not may.any():
            return
        slot, score, ids = (np.concatenate([x, y[may]]) for x, y in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        at = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = at < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        last = at[kept] == self.k - 1
        self.bar[self.slot[last]] = self.score[last]


def _pieces(rows: int, others: int) -> Iterator[slice]:
    """Stretches of rows whose product with the others keeps to CELLS."""
    step = max(1, CELLS // max(1, others))
    return (slice(i, min(rows, i + step)) for i in range(0, rows, step))


def add_positives(best: Best, anchors: Block, found: Block) -> None:
    """Rows of the same label, label by label; slots are the anchors' places."""
    for label in np.intersect1d(anchors.labels, found.labels).tolist():
        mine, theirs = np.flatnonzero(anchors.labels == label), found.take(found.labels == label)
        for piece in _pieces(len(mine), len(theirs.ids)):
            at = mine[piece]
            scores = product(anchors.take(at), theirs)
            bar = best.bar[at]
            if len(theirs.ids) > best.k + 1:  # its own row may be among them
                bar = np.maximum(bar, np.partition(scores, -best.k - 1, axis=1)[:, -best.k - 1].astype(np.int64))
            r, c = np.nonzero(scores >= bar[:, None])
            other = anchors.ids[at][r] != theirs.ids[c]
            best.add(at[r[other]], scores[r[other], c[other]], theirs.ids[c[other]])


def add_negatives(best: Best, anchors: Block, low: np.ndarray, high: np.ndarray, found: Block) -> None:
    """Rows of other labels within [low, high]: a row of windows for each anchor; slots are anchor * windows + window."""
    windows = low.shape[1]
    for piece in _pieces(len(anchors.ids), len(found.ids)):
        own = anchors.take(piece)
        scores = product(own, found)
        within = (scores >= low[piece].min(1)[:, None]) & (scores <= high[piece].max(1)[:, None])
        r, c = np.nonzero(within & (own.labels[:, None] != found.labels[None, :]))
        s = scores[r, c]
        for w in range(windows):
            on = (s >= low[piece][r, w]) & (s <= high[piece][r, w])
            best.add((r[on] + piece.start) * windows + w, s[on], found.ids[c[on]])


def packed(rows: DataFrame, dims: int, scale: int, more: str = "") -> DataFrame:
    """Blocks of the rows of the right length, floor(scale * component) as integers; the column `more` is kept, a value a block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATE_ROWS):
                part = batch.slice(at, CANDIDATE_ROWS)
                values = part.column(2)
                right = np.flatnonzero(np.asarray(values.value_lengths()) == dims)
                x = np.floor(float(scale) * np.asarray(values.take(pa.array(right)).flatten(), dtype=np.float64).reshape(len(right), dims))
                if x.size and np.abs(x).max() >= 2.0**62:
                    raise ValueError("a component is too large for an exact score")
                ids, labels = (np.asarray(part.column(i), dtype=np.int64)[right] for i in (0, 1))
                groups = np.asarray(part.column(3), dtype=np.int64)[right] if more else np.zeros(len(right), np.int64)
                for g in np.unique(groups):
                    on = groups == g
                    whole = x[on].astype(np.int64)
                    kind = smallest_kind(whole)
                    cells = [pa.array([int(on.sum())], pa.int32()), pa.array([kind]), *(pa.array([a[on].tobytes()], pa.binary()) for a in (ids, labels)), pa.array([whole.astype(kind).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array([int(g)], pa.int32())][: 6 if more else 5], names=["rows", "kind", "ids", "labels", "x", *([more] if more else [])])

    return rows.mapInArrow(pack, PACKED + (f", {more} int" if more else ""))


def _over(blocks: DataFrame, dims: int, work, out: str) -> DataFrame:
    """work() makes (take, give) for a task: take(candidates) for each block, then give() the columns of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, give = work()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                take(Block.read([row], dims))
        names = [f.split()[0] for f in out.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c), pa.int32() if n == "positive_rank" else pa.int64()) for n, c in zip(names, give(), strict=True)], names=names)

    return blocks.mapInArrow(run, out)


def _first(found: DataFrame, slot: list[str], score: str, key: str, k: int, rank: str) -> DataFrame:
    """The k best rows of each slot; tasks have sent k at most each."""
    order = Window.partitionBy(*slot).orderBy(F.desc(score), key)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def commonest_length(rows: DataFrame, column: str = "embedding") -> int | None:
    """The length that most vectors have; of equally common ones the greatest. Lengths are counted before any row travels."""
    most = rows.groupBy(F.size(column).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return None if most is None else most["dims"]


def mine(vectors: DataFrame, anchor: Column, key: str = "vec_id", column: str = "embedding", label: str | Column = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: float | str = "0.5", high: float | str = "0.95") -> DataFrame:
    """anchor_id, positive_rank, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` says, of `vec_id`, which rows are anchors. Negatives score low to high times their positive's score. Anchors are
    asked in blocks of ANCHOR_BYTES, with two passes over the packed vectors for each block.
    """
    spark = vectors.sparkSession
    ship(spark)
    lo, hi = Fraction(str(low)), Fraction(str(high))
    rows = usable(vectors, key, column, F.col(label) if isinstance(label, str) else label)
    dims = commonest_length(rows)
    if dims is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("embedding") == dims)
    asked = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    step = max(64, ANCHOR_BYTES // (8 * max(1, dims)))
    count = asked.count()
    blocks = -(-count // step)
    if not blocks:
        return spark.createDataFrame([], RESULT)
    of_block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    # a folder for each block, so a pass reads its own anchors only
    place_of = scratch_path(spark, "anchors")
    packed(asked.select("vec_id", "label", "embedding", of_block).repartition("block"), dims, scale, "block").write.partitionBy("block").parquet(place_of)
    anchors = spark.read.schema(f"{PACKED}, block int").parquet(place_of)
    candidates = written(packed(rows, dims, scale), "candidates")
    path = scratch_path(spark, "negatives")
    for b in range(blocks):
        block = Block.read([tuple(r)[:5] for r in anchors.where(F.col("block") == b).collect()], dims)  # about `step` anchors
        shared = spark.sparkContext.broadcast(block)

        def positive_work(shared=shared):
            best = Best(len(shared.value.ids), positives)
            return lambda found: add_positives(best, shared.value, found), lambda: (shared.value.ids[best.slot], best.id, best.score)

        first = _first(_over(candidates, dims, positive_work, POSITIVES), ["anchor_id"], "positive_score", "positive_id", positives, "positive_rank")
        place = {a: i for i, a in enumerate(block.ids.tolist())}
        ids, scores = (np.zeros((len(block.ids), positives), dtype=np.int64) for _ in range(2))
        # an empty window where there is no positive
        floor, ceiling = np.full(ids.shape, np.iinfo(np.int64).max), np.full(ids.shape, np.iinfo(np.int64).min)
        for r in first.collect():  # `positives` rows for each anchor of the block
            at = place[r["anchor_id"]], r["positive_rank"] - 1
            ids[at], scores[at] = r["positive_id"], r["positive_score"]
            floor[at], ceiling[at] = -(-lo * r["positive_score"] // 1), hi * r["positive_score"] // 1
        windows = spark.sparkContext.broadcast((ids, scores, floor, ceiling))

        def negative_work(shared=shared, windows=windows):
            own, (pid, score, floor, ceiling) = shared.value, windows.value
            best = Best(pid.size, negatives)

            def give():
                a, j = np.divmod(best.slot, positives)
                return own.ids[a], j + 1, pid[a, j], score[a, j], best.id, best.score

            return lambda found: add_negatives(best, own, floor, ceiling, found), give

        found = _over(candidates, dims, negative_work, NEGATIVES)
        ranked = _first(found, ["anchor_id", "positive_rank"], "negative_score", "negative_id", negatives, "rank")
        ranked.select(*(f.split()[0] for f in RESULT.split(", "))).write.mode("append").parquet(path)
        windows.destroy()
        shared.destroy()
    return spark.read.schema(RESULT).parquet(path)
