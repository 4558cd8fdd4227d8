"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints: bit b is 1 if more than half of the hashes of a text's word shingles have it. Links: fingerprints that
differ in at most `radius` bits. Groups: connected components, named by their smallest doc_id.

The 64 bits are divided into parts. If the thresholds t_i of the parts sum up to radius - parts + 1, any fingerprint
within the radius of q differs from q in at most t_i bits in some part i. Correlated bits go to the same part, so the
parts tell fingerprints apart as well as they can. For each fingerprint, dynamic programming chooses the thresholds
with the least estimated work: probes sent, plus candidates met, from counts of the corpus' part values. -1 leaves a
part out. Fingerprints are indexed by (part, value); each sends its probes, and what they hit is verified.

Equal fingerprints are merged before all this, so copies never meet each other in pairs. A pair is kept only if it is
within the radius. Components are found by smallest-label rounds with pointer jumping, on links between fingerprints.

Near copies by similarity of shingles (first_of_similar) are these groups, verified, and what a prefix filter over shingles adds to them.

Nulls: a null or blank text has fingerprint zero, linked like any other; a null doc_id stays and names a component only
where no other doc_id is in it. Repeated rows stay. Further columns pass through (fingerprint and component_id are replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.support import written

BITS, RADIUS, PARTS, SEED = 64, 3, 2, 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
HISTOGRAM_BITS = 12
HASHED_AT_ONCE, STAR_ROUNDS = 256, 4


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text over shingles of `width` words, repeats included."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else [b" ".join(words)]
    h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=len(shingles))
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(h), 1 << 16):  # very long texts in steps
        ones += np.unpackbits(h[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 3, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with fp (the fingerprint as a signed 64-bit integer)."""
    kept = [c for c in docs.columns if c != "fp" and (keep_text or c != text)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(batch.schema.get_field_index(text))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(fps.view(np.int64))], names=[*kept, "fp"])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def correlations(fps: DataFrame) -> np.ndarray:
    """64 x 64 absolute correlations of the bits, from counts over all fingerprints."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for f in frames:
            x = _bits(f["fp"].to_numpy(np.int64)).astype(np.float32)
            both += x.T @ x
            n += len(x)
        yield pd.DataFrame({"row": range(BITS), "both": list(both), "n": n})

    slots = [F.sum(F.col("both")[i]).alias(str(i)) for i in range(BITS)]
    rows = fps.select("fp").mapInPandas(run, "row int, both array<double>, n long").groupBy("row").agg(F.sum("n").alias("n"), *slots).collect()
    if not rows or not rows[0]["n"]:
        return np.zeros((BITS, BITS))
    n = rows[0]["n"]
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["row"]] = [r[str(i)] for i in range(BITS)]
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of equal width; each grows by the bit that correlates most with the bits it has."""
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        off = corr.copy()
        np.fill_diagonal(off, 0)
        seed = max(free, key=lambda b: (off[b, sorted(free)].sum(), -b))
        own = [seed]
        free.discard(seed)
        while len(own) < width:
            best = max(free, key=lambda b: (off[b, own].sum(), -b))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """The value of each part."""
    x = _bits(fps).astype(np.int64)
    return [x[:, g] @ (np.int64(1) << np.arange(len(g), dtype=np.int64)) for g in groups]


def _balls(width: int, radius: int) -> np.ndarray:
    return np.array([0, *(sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(width), r))], dtype=np.int64)


def allocate(values: list[np.ndarray], widths: list[int], radius: int, histograms: list[np.ndarray], total: int) -> np.ndarray:
    """Thresholds of each fingerprint's parts with the least estimated work, by dynamic programming over the parts.

    The number of fingerprints near a part value is estimated from the histogram of its leading bits and spread evenly
    over the remaining ones. Work of a threshold: its probes, and the fingerprints that they are expected to hit.
    """
    n, parts, budget = len(values[0]), len(widths), radius - len(widths) + 1
    options = list(range(-1, radius + 1))
    cost = np.zeros((parts, len(options), n))
    for i, (v, w) in enumerate(zip(values, widths, strict=True)):
        lead = min(HISTOGRAM_BITS, w)
        near = histograms[i][v >> (w - lead)] / 2.0 ** (w - lead)  # expected with exactly this value
        even = total / 2.0**w
        for k, t in enumerate(options):
            if t >= 0:
                probes = len(_balls(w, t)) if t <= 2 else np.inf
                cost[i, k] = probes + near + (probes - 1) * (near + even) / 2
    # best[s]: least cost with thresholds summing up to s - parts so far
    span = budget + parts + 1
    best = np.full((span, n), np.inf)
    best[0] = 0
    picked = np.zeros((parts, span, n), dtype=np.int8)
    for i in range(parts):
        new = np.full((span, n), np.inf)
        for s in range(span):
            for k, t in enumerate(options):
                if s + t + 1 < span:
                    c = best[s] + cost[i, k]
                    better = c < new[s + t + 1]
                    new[s + t + 1][better] = c[better]
                    picked[i, s + t + 1][better] = t
        best = new
    out, at = np.zeros((n, parts), dtype=np.int64), np.full(n, budget + parts)
    for i in reversed(range(parts)):
        out[:, i] = picked[i, at, np.arange(n)]
        at = at - (out[:, i] + 1)
    return out


def links(fps: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """(a, b) with a < b: pairs of distinct fingerprints (column fp) that differ in at most `radius` bits. parts: 2 or more."""
    groups = group_bits(correlations(fps), parts)
    widths = [len(g) for g in groups]
    leads = [min(HISTOGRAM_BITS, w) for w in widths]

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = f["fp"].to_numpy(np.int64)
            for i, v in enumerate(_values(x, groups)):
                yield pd.DataFrame({"part": np.int32(i), "value": v, "fp": x})

    schema = "part int, value long, fp long"
    indexed = fps.select("fp").mapInPandas(index, schema)
    shift = F.lit(None).cast("int")
    for i, (w, lead) in enumerate(zip(widths, leads, strict=True)):
        shift = F.when(F.col("part") == i, w - lead).otherwise(shift)
    histograms = [np.zeros(1 << lead) for lead in leads]
    for r in indexed.groupBy("part", F.call_function("shiftright", F.col("value"), shift).alias("lead")).count().collect():
        histograms[r["part"]][r["lead"]] = r["count"]  # parts * 2**HISTOGRAM_BITS rows at most
    total = int(histograms[0].sum())

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for low in range(0, len(f), 2000):
                x = f["fp"].to_numpy(np.int64)[low : low + 2000]
                values = _values(x, groups)
                chosen = allocate(values, widths, radius, histograms, total)
                for i, w in enumerate(widths):
                    for t in range(radius + 1):
                        rows = np.flatnonzero(chosen[:, i] == t)
                        if len(rows):
                            ball = _balls(w, t)
                            yield pd.DataFrame({"part": np.int32(i), "value": (values[i][rows, None] ^ ball).ravel(), "fp": np.repeat(x[rows], len(ball))})

    probes = fps.select("fp").mapInPandas(probe, schema).withColumnRenamed("fp", "q")
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    hits = probes.alias("p").join(indexed.alias("x"), (F.col("p.part") == F.col("x.part")) & (F.col("p.value") == F.col("x.value")) & near & (F.col("q") != F.col("fp")))
    return hits.select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the smallest node that it reaches.

    A round hooks the root of each link's larger side to the smaller root and then jumps, until no link joins two roots.
    """
    edges = written(pairs.select(F.least("a", "b").alias("to"), F.greatest("a", "b").alias("root")), "links")
    open_, label = edges, None
    while not open_.isEmpty():
        hooks = written(open_.groupBy("root").agg(F.min("to").alias("to")), "hooks")
        while True:  # to the end of each chain; targets are smaller, so there are no circles
            far = hooks.select(F.col("root").alias("to"), F.col("to").alias("beyond"))
            jumped = written(hooks.join(far, "to", "left").select("root", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        if label is None:
            label = edges.select(F.explode(F.array("to", "root")).alias("node")).distinct().withColumn("root", F.col("node"))
        label = written(label.join(hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        left, right = label.select(F.col("node").alias("to"), F.col("root").alias("r1")), label.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        ends = edges.join(left, "to").join(right, "root").where("r1 <> r2")
        open_ = written(ends.select(F.least("r1", "r2").alias("to"), F.greatest("r1", "r2").alias("root")), "open_links")
    return edges.select(F.col("to").alias("node"), "root").limit(0) if label is None else label


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, parts: int = PARTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without text, with fp and component_id: the smallest key that links of at most `radius` bits reach."""
    docs = written(with_fingerprints(docs.drop("component_id"), width, text, keep_text=False), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min(key).alias("first")), "distinct_fingerprints")
    nodes = components(links(fps, radius, parts))
    # of the fingerprints that have links: the smallest key of their component
    roots = fps.join(nodes.withColumnRenamed("node", "fp"), "fp")
    least = roots.groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(least, "root").select("fp", "least")
    named = written(fps.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "named_fingerprints")
    return docs.join(named, "fp")


# ---- groups of similar documents, for de-duplication


def shingles(text: str | None, width: int) -> set[bytes]:
    """Distinct shingles of `width` words; the whole text if it has fewer."""
    words = WORD.findall((text or "").encode().lower())
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) if len(words) >= width else {b" ".join(words)}


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of shingles(text, width), each once."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").encode().lower())
    h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - width + 1
    if n < 1:  # the whole text, told apart by its number of words
        h, n, width = np.concatenate([h, np.zeros(1, dtype=np.uint64)]), 1, len(h) + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _hashed(texts: DataFrame, width: int) -> DataFrame:
    """(s, node, n): each shingle of each text, with how many the text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for low in range(0, batch.num_rows, HASHED_AT_ONCE):
                found = [_shingle_hashes(t.as_py(), width) for t in batch.column(1).slice(low, HASHED_AT_ONCE)]
                sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
                columns = [np.concatenate(found).view(np.int64), np.repeat(nodes[low : low + len(found)], sizes), np.repeat(sizes, sizes).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "node", "n"])

    return texts.mapInArrow(run, "s long, node long, n int")


def _prefixes(texts: DataFrame, width: int, least: float) -> DataFrame:
    """(s, node, n, at): of each text the rarest of its n shingles, as many as a similar text must share one of.

    All texts order their shingles alike: those that no other text has, then by frequency and hash; at is the place in that
    order. Similar texts share least * n shingles, so the first that they share is among the first n - least * n + 1 of
    both. Shingles of one text only meet nothing: they take their places, and no row.
    """
    of_s, of_node = Window.partitionBy("s"), Window.partitionBy("node")
    counted = _hashed(texts, width).withColumns({"df": F.count("*").over(of_s), "low": F.min("node").over(of_s), "high": F.max("node").over(of_s)})
    shared = written(counted.where("low <> high").select("s", "node", "n", "df"), "similar_shingles").distinct()
    placed = shared.withColumn("at", F.col("n") - F.count("*").over(of_node) + F.row_number().over(of_node.orderBy("df", "s")) - 1)
    return placed.where(F.col("at") <= F.col("n") - F.ceil(least * F.col("n") - 1e-6)).select("s", "node", "n", F.col("at").cast("int").alias("at"))


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b, ra, rb) whose texts have a Jaccard similarity of shingles of at least `least`, as (a, b) of their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = shingles(x.as_py(), width), shingles(y.as_py(), width)
                both = len(a & b)
                keep.append(both >= least * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("ra", "rb", "x", "y").mapInArrow(run, "a long, b long")


def similar_links(texts: DataFrame, width: int, least: float) -> DataFrame:
    """(node, root) of the texts (node, text): the components of all pairs of similarity `least` or more.

    SimHash makes the groups first (near_duplicates): each text is compared with the one that names its group. Fingerprints
    do not find all pairs of such a similarity, so an exact search follows for what they have not brought together. Texts that
    share a shingle of their prefixes are in a bucket. In a few rounds each text is compared with one text of each of its
    buckets, so that large groups merge without meeting in pairs. Then all pairs of a bucket that no verified link has
    brought together are compared, as far as their sizes and places allow the similarity; so nothing is missed.
    """
    bodies = texts.dropDuplicates(["node"])
    grouped = written(near_duplicates(bodies, key="node").select("node", F.col("component_id").alias("group")), "similar_groups")
    roots = grouped.select("node", F.col("node").alias("root"))

    def rooted() -> DataFrame:
        """The keys of buckets that hold several components."""
        named = keys.join(roots, "node")
        open_ = named.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("s")
        return written(named.join(open_, "s", "left_semi"), "similar_open")

    def merged(pairs: DataFrame) -> bool:
        """Whether the pairs held links; roots are then those of all links so far."""
        nonlocal roots
        x, y = F.struct(F.col("x.node").alias("node"), F.col("x.root").alias("root")), F.struct(F.col("y.node").alias("node"), F.col("y.root").alias("root"))
        ends = pairs.select(F.least(x, y).alias("p"), F.greatest(x, y).alias("q")).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.root").alias("ra"), F.col("q.root").alias("rb"))
        new = written(_verified(written(ends.distinct(), "similar_pairs"), bodies, width, least), "similar_links")
        if new.isEmpty():
            return False
        joined = components(new).select(F.col("node").alias("root"), F.col("root").alias("least"))
        roots = written(roots.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")), "similar_roots")
        return True

    itself = lambda c: F.struct(F.col(c).alias("node"), F.col(c).alias("root"))
    merged(grouped.where("node <> group").select(itself("node").alias("x"), itself("group").alias("y")))
    keys = written(_prefixes(texts, width, least), "similar_keys")
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    alike = (F.col("x.root") != F.col("y.root")) & (small >= least * large - 1e-6)
    for number in range(STAR_ROUNDS):
        now = rooted()
        # first the text with the fewest rarer shingles, which is the one with the fewest words of its own; then any
        central = F.col("at") / F.col("n") if number == 0 else F.lit(0.0)
        hubs = now.groupBy("s").agg(F.min_by(F.struct("node", "n", "root"), F.struct(central, F.xxhash64("node", F.lit(number)))).alias("hub")).select("s", "hub.*")
        if not merged(now.alias("x").join(hubs.alias("y"), "s").where(alike)):
            break
    now = rooted()
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))  # shared at most, if this is the first that they share
    enough = rest >= least / (1 + least) * (F.col("x.n") + F.col("y.n")) - 1e-6
    merged(now.alias("x").join(now.alias("y"), "s").where((F.col("x.node") < F.col("y.node")) & alike & enough))
    return roots


def text_hash(body: Column) -> Column:
    """By which a text goes."""
    return F.xxhash64(body)


def first_of_similar(docs: DataFrame, width: int = 5, least: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each group of similar documents, the one with the smallest key; all columns of docs.

    Documents are similar if the Jaccard similarity of their shingles of `width` words is at least `least`; groups are the
    components of all such pairs (see similar_links).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    node, other, first, flag = (next(n for n in (c + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns) for c in ("__node", "__other", "__key", "__clash"))
    columns = docs.columns
    docs = docs.withColumn(node, text_hash(body)).withColumn(other, F.xxhash64(F.lit(1), body)).withColumn(first, F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)))
    texts = written(docs.groupBy(F.col(node).alias("node"), F.col(other).alias("other")).agg(F.min(first).alias("first")), "similar_texts")
    # different texts with one hash, which are some n * n / 2**65 of n texts, go by their other one
    clash = written(texts.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "similar_clashes")

    def told(df: DataFrame, node: str, other: str) -> DataFrame:
        """df with the hash by which a text goes as its node, without the other one."""
        met = df.join(F.broadcast(clash.select(F.col("node").alias(flag))), F.col(node) == F.col(flag), "left")
        return met.withColumn(node, F.when(F.col(flag).isNull(), F.col(node)).otherwise(F.xxhash64(F.col(other), F.col(node)))).drop(flag, other)

    docs, names = told(docs, node, other), told(texts, "node", "other")
    grown = similar_links(docs.select(F.col(node).alias("node"), body.alias("text")), width, least)
    named = names.join(grown, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = written(named.groupBy("root").agg(F.min(F.struct("first", "node")).alias("m")).select(F.col("m.first").alias(first), F.col("m.node").alias(node)), "similar_kept")
    return docs.join(kept, [first, node], "left_semi").dropDuplicates([first, node]).select(*columns)
