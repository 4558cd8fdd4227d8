"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: the signs of learned rotations (iterative quantisation) of the centred unit vectors. Tasks cut
the codes into substrings and index each substring. By the pigeonhole principle, a code within the radius of a query's
code is within radius // substrings bits in some substring (and within one less in all but a few, see `thresholds`),
so probing the substrings' balls retrieves every code within the radius. Retrieved codes within the radius are ranked by
their original vectors in double precision.

The rotations and the radius are learned on a bounded sample: the radius is the one that holds `target` of the sample's
true neighbours. Every row is indexed. Queries that find fewer than k codes within it, over all rows, are asked again with
twice the radius, until they have k or all rows. So what is found depends on codes and radius alone, and not on how the
table is dealt out.
Queries travel in blocks of at most QUERY_BLOCK, with one pass over the vectors for each block, so no data of unbounded
size is sent to the tasks; each task merges what its indexes find and sends back k rows for each query.

Vectors that are null or zero, that hold nulls or non-finite components, or whose length is not the sample's commonest
take no part, and neither do rows with a null id. Repeated rows are candidates each; equal scores are ranked by id. A query
id that is given several times is asked once, with its smallest vector; rows that bear its id are no candidates. Columns
other than the id and the vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.support import written

ROTATIONS, SUB_BITS = 2, 8
SAMPLE, SAMPLE_QUERIES, TARGET = 8_000, 400, 0.98
QUERY_BLOCK, INDEX_ROWS = 4_096, 16_384
MATCHES = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, embedding (array<double>) of the vectors that take part."""
    v = F.col("embedding")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


class Codes:
    """Binary codes of one sample's rotations, and the radius that suits them."""

    def __init__(self, sample: np.ndarray, k: int, target: float, seed: int = 7) -> None:
        unit = _unit(sample)
        self.dims, self.mean = sample.shape[1], unit.mean(0)
        rng, centred, turned = np.random.default_rng(seed), unit - self.mean, []
        _, _, axes = np.linalg.svd(centred.T @ centred)
        for _ in range(ROTATIONS):
            v = centred @ axes.T
            r, _ = np.linalg.qr(rng.normal(size=(self.dims, self.dims)))
            for _ in range(25):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            turned.append(axes.T @ r)
        self.turn = np.concatenate(turned, axis=1)
        self.turn = np.pad(self.turn, ((0, 0), (0, -self.turn.shape[1] % 64)))
        self.radius = self._learned(unit, k, target)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of bytes."""
        return np.packbits((_unit(vectors) - self.mean) @ self.turn > 0, axis=1)

    def _learned(self, unit: np.ndarray, k: int, target: float) -> int:
        codes, far = self.of(unit), []
        for i in range(min(len(unit), SAMPLE_QUERIES)):
            near = unit @ unit[i]
            near[i] = -2
            best = np.argsort(-near, kind="stable")[: min(k, len(unit) - 1)]
            far.extend(hamming(codes[best], codes[i]).tolist())
        return int(np.quantile(far, target, method="higher")) if far else codes.shape[1] * 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes.view(np.uint64) ^ code.view(np.uint64)).sum(1)


def thresholds(radius: int, substrings: int) -> list[int]:
    """Bits by which some substring must be met; they sum up to radius - substrings + 1, as evenly as can be. -1: not at all."""
    low, more = divmod(max(radius, 0) - substrings + 1, substrings)
    return [low + (i < more) for i in range(substrings)]


class Index:
    """Substring tables over the codes of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes) -> None:
        self.ids, self.vectors, self.codes = ids, vectors, codes.of(vectors)
        self.norms = np.linalg.norm(vectors, axis=1)
        self.tables = []
        for s in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, s], kind="stable")
            self.tables.append((order, np.searchsorted(self.codes[order, s], np.arange(257))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from `code` in at most `radius` bits."""
        seen = np.zeros(len(self.ids), dtype=bool)
        for s, t in enumerate(thresholds(radius, len(self.tables))):
            if t >= 0:
                order, starts = self.tables[s]
                for value in (code[s] ^ _BALLS[min(t, SUB_BITS)]).tolist():
                    seen[order[starts[value] : starts[value + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.codes[rows], code) <= radius]

    def nearest(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of those within the radius, without the query's own row."""
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != query_id]
        rough = self.vectors[rows] @ vector / self.norms[rows]
        if len(rows) > k:  # those that may be among the best, ties included
            rows = rows[rough >= np.partition(rough, -k)[-k] - 1e-9 * np.linalg.norm(vector)]
        scores = (self.vectors[rows] * vector).sum(1) / (self.norms[rows] * np.sqrt((vector * vector).sum()))
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


_BALLS = [np.array([0, *(sum(1 << b for b in c) for r in range(1, t + 1) for c in combinations(range(SUB_BITS), r))], dtype=np.uint8) for t in range(SUB_BITS + 1)]


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the right length, and which rows they are."""
    rows = np.flatnonzero(np.asarray(column.value_lengths()) == dims)
    return np.asarray(column.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(-1, dims), rows


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest rows found, by cosine. Both: vec_id, embedding."""
    spark = vectors.sparkSession
    vectors, queries = usable(vectors), usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(taken):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = taken.map(len).mode().iloc[0]
    codes = Codes(np.stack([x for x in taken if len(x) == dims]).astype(np.float64), k, target)
    bits, radius, out = codes.turn.shape[1], max(1, codes.radius), None
    pending = written(queries.where(F.size("embedding") == dims), "ann_queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    while True:
        hits = _asked(vectors, pending, codes, k, radius)
        best = written(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann_best")
        # those with k rows are done
        done = best.where(F.col("rank") == k).select("query_id") if radius < bits else best.select("query_id").distinct()
        found = best.join(done, "query_id", "left_semi")
        out = found if out is None else out.unionByName(found)
        if radius >= bits:
            return out
        pending = written(pending.join(done, F.col("vec_id") == F.col("query_id"), "left_anti"), "ann_queries")
        if pending.isEmpty():
            return out
        radius = min(bits, 2 * radius)


def _asked(vectors: DataFrame, queries: DataFrame, codes: Codes, k: int, radius: int) -> DataFrame:
    """query_id, vec_id, score: of each task's rows within the radius the k best for each query."""
    dims, count = codes.dims, queries.count()
    blocks, found = 1 + (2 * count - 1) // QUERY_BLOCK if count > QUERY_BLOCK else 1, []
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = block.collect()  # about QUERY_BLOCK at most
        ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        points = np.array([r["embedding"] for r in rows], dtype=np.float64).reshape(-1, dims)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, points=points) -> Iterator[pa.RecordBatch]:
            asked = codes.of(points) if len(points) else []

            best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

            def look(own_ids: list[np.ndarray], own: list[np.ndarray]) -> None:
                """Keep the k best of those so far and of one more index."""
                index = Index(np.concatenate(own_ids), np.concatenate(own), codes)
                for i in range(len(ids)):
                    v, s = (np.concatenate(x) for x in zip(best[i], index.nearest(ids[i], points[i], asked[i], k, radius), strict=True))
                    order = np.lexsort((v, -s))[:k]
                    best[i] = v[order], s[order]

            own_ids, own, n = [], [], 0
            for batch in batches:
                matrix, at = _matrix(batch.column(1), dims)
                own_ids.append(np.asarray(batch.column(0), dtype=np.int64)[at])
                own.append(matrix)
                n += len(matrix)
                if n >= INDEX_ROWS:
                    look(own_ids, own)
                    own_ids, own, n = [], [], 0
            if n:
                look(own_ids, own)
            if len(ids):
                q = np.repeat(ids, [len(v) for v, _ in best])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([v for v, _ in best])), pa.array(np.concatenate([s for _, s in best]))], names=["query_id", "vec_id", "score"])

        hits = vectors.mapInArrow(run, MATCHES)
        found.append(hits if blocks == 1 else written(hits, "ann_hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    return hits
