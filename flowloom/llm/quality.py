"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector w, shared by all grades,
and ordered thresholds theta_1 < theta_2. Features are hashes of what a whole text holds: its words, the shapes of its
words (letters and digits by class) and bands of a few ratios. Each counts once, however often it occurs.

The fit takes at most `sample` labelled documents (those with the smallest hashes of doc_id). Features are chosen and
counted over that sample by Spark; the model, a few thousand weights, is fitted in numpy and sent with the tasks.
Documents are selected if the tail probability P(grade >= 2) reaches `least`.

Nulls: labels without quality count as good, without toxic as not toxic, without both or without doc_id they take no
part; of several labels of a document the lowest grade holds. A null text counts as empty. Without any label, or with
labels of one grade only, the model has no weights and every document is selected. Repeated rows and equal texts get
equal scores, and all stay; ties at the threshold are selected. Texts of any length are read whole. Further columns pass
through (p_ge1, p_ge2 and expected_grade are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.support import written

SAMPLE, MIN_DOCS, MIN_Z, LEAST = 20_000, 8, 4.0, 0.7
GRADES = 3
STRETCH = 1000  # words among which the distinct ones are counted, so that long texts compare with short ones
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_ENDS = b".,;:!?()[]{}\"'"


def _hash(x: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(x) >> 1


def _band(x: float) -> bytes:
    return b"%d" % min(20, int(20 * x))


class Features:
    """The hashed features of a text; shapes are kept, there are few of them."""

    def __init__(self) -> None:
        self.shapes: dict[bytes, int] = {}

    def _shape(self, translated: bytes) -> int:
        found = self.shapes.get(translated)
        if found is None:
            if len(self.shapes) > 100_000:
                self.shapes.clear()
            found = self.shapes[translated] = _hash(b"s:" + _RUN.sub(rb"\1", translated))
        return found

    def of(self, text: str | None) -> set[int]:
        data = (text or "").encode()
        words = data.split()
        distinct = set(words)
        out = {_hash(w.strip(_ENDS).lower()) for w in distinct}
        out |= {self._shape(t) for t in {w.translate(_SHAPE) for w in distinct}}
        n, size = len(words), max(1, len(data))
        classes = np.bincount(np.frombuffer(data.translate(_SHAPE), np.uint8), minlength=128) if data else np.zeros(128, np.int64)
        lines = data.split(b"\n")
        ratios = {
            b"upper": classes[65] / max(1, classes[65] + classes[97]),
            b"digit": classes[48] / size,
            b"mark": 1 - (classes[65] + classes[97] + classes[48] + classes[32] + classes[10]) / size,
            b"distinct": (len(distinct) if n <= STRETCH else sum(len(set(words[i : i + STRETCH])) for i in range(0, n, STRETCH))) / max(1, n),
            b"again": sum(map(eq, words, islice(words, 1, None))) / max(1, n),
            b"lines": len(set(lines)) / len(lines),
            b"words": n.bit_length() / 20,
            b"length": (size / max(1, n)) / 20,
        }
        return out | {_hash(b"r:" + k + b":" + _band(v)) for k, v in ratios.items()}


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, float] = (-20.0, -10.0)

    def tails(self, features: set[int]) -> tuple[float, float]:
        """P(grade >= 1), P(grade >= 2)."""
        get = self.weights.get
        score = sum(w for w in map(get, sorted(features & self.weights.keys())))
        return tuple(float(1 / (1 + np.exp(np.clip(t - score, -500, 500)))) for t in self.thresholds)


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    return rated.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_ordinal(rows: list[tuple[int, list[int]]], size: int, l2: float = 2e-4, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float, float]:
    """Weights and the two thresholds, by Adam on the whole sample. rows: grade and places of features below size."""
    y = np.array([g for g, _ in rows])
    at = np.repeat(np.arange(len(rows)), [len(p) for _, p in rows])
    place = np.fromiter((p for _, ps in rows for p in ps), dtype=np.int64, count=len(at))
    params = np.zeros(size + 2)
    params[size:] = -1.0, 0.0  # theta_1 and the logarithm of theta_2 - theta_1
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, t1, gap = params[:size], params[size], np.exp(params[size + 1])
        f = np.bincount(at, w[place], minlength=len(y))
        a, b = (1 / (1 + np.exp(-np.clip(f - t, -40, 40))) for t in (t1, t1 + gap))
        middle = np.maximum(a - b, 1e-12)
        # derivatives of the log-likelihood by f - theta_1 and by f - theta_2
        da = np.where(y == 0, -a, np.where(y == 1, a * (1 - a) / middle, 0))
        db = np.where(y == 2, 1 - b, np.where(y == 1, -b * (1 - b) / middle, 0))
        grad = np.empty_like(params)
        grad[:size] = -np.bincount(place, (da + db)[at], minlength=size) / len(y) + l2 * w
        grad[size] = (da + db).mean()
        grad[size + 1] = db.mean() * gap
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:size], params[size], params[size] + np.exp(params[size + 1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Model:
    rated = grades(labels.select(F.col("doc_id"), "quality", "toxic"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound of the sample
    known = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [sorted(features.of(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["grade", "features"])

    sampled = written(known.select("grade", "text").mapInArrow(run, "grade int, features array<long>"), "quality_sample")
    totals = {r["grade"]: r["count"] for r in sampled.groupBy("grade").count().collect()}
    n = sum(totals.values())
    if len(totals) < 2:
        return Model()
    counts = sampled.select("grade", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *(F.count_if(F.col("grade") == g).alias(f"n{g}") for g in range(GRADES)))
    # how far a feature's documents of a grade lie from what their number would give by chance
    far = []
    for g in range(GRADES):
        p = totals.get(g, 0) / n
        far.append(F.abs(F.col(f"n{g}") - F.col("n") * p) / F.sqrt(F.col("n") * max(p * (1 - p), 1e-9)))
    picked = counts.where((F.col("n") >= MIN_DOCS) & (F.greatest(*far) >= MIN_Z)).select("f").collect()
    places = {f: i for i, f in enumerate(sorted(r["f"] for r in picked))}
    if not places:
        return Model()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[places[f] for f in fs if f in places] for fs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["grade", "places"])

    rows = sorted((r["grade"], r["places"]) for r in sampled.mapInArrow(place, "grade int, places array<long>").collect())
    weights, t1, t2 = fit_ordinal(rows, len(places))
    return Model({f: float(weights[i]) for f, i in places.items()}, (float(t1), float(t2)))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with p_ge1, p_ge2 (tail probabilities) and expected_grade."""
    new = ["p_ge1", "p_ge2", "expected_grade"]
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            tails = [model.tails(features.of(t.as_py())) for t in batch.column(batch.schema.get_field_index(text))]
            a, b = [t[0] for t in tails], [t[1] for t in tails]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(a, pa.float64()), pa.array(b, pa.float64()), pa.array([x + y for x, y in tails], pa.float64())], names=[*kept, *new])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def select_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The documents whose tail probability P(grade >= 2) is at least `least`, with their scores."""
    return score(docs, fit(docs, labels, sample, text), text, keep_text).where(F.col("p_ge2") >= least)
