"""Discovery of a cut-based process tree from directly-follows pairs, level by level.

Every cut is decided by which pairs and activities occur at all, and a node's paths are the log's, with its activities alone. So one job
finds the distinct pairs of all nodes of a depth: nodes of a depth share no activity, and at most the square of the activities
comes back, however many paths there are. Where nodes of a depth have no cut, one more job finds their first paths.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.sources.scratch import written

MAX_DEPTH, MAX_PATHS = 24, 24


def collation_key(text: str) -> tuple:
    """Letters before accents before case, as in dictionaries."""
    plain = unicodedata.normalize("NFD", text)
    return "".join(c for c in plain if not unicodedata.combining(c)).casefold(), plain.casefold(), text.swapcase()


def leaf(activity: str) -> dict:
    return {"operator": "activity", "activity": activity}


def variants_in_order(traces: DataFrame) -> DataFrame:
    """Distinct paths with the collated smallest case id that has them."""
    case = F.struct(F.collate("case_id", "UNICODE").alias("c"), F.col("case_id"))
    return traces.groupBy("path_key").agg(F.any_value("path").alias("path"), F.min(case).alias("first_case"))


@dataclass
class Graph:
    activities: list[str]
    pairs: set[tuple[str, str]]

    @property
    def repeats(self) -> bool:
        return any(a == b for a, b in self.pairs)

    def neighbours(self, both_ways: bool) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {a: set() for a in self.activities}
        for a, b in self.pairs:
            out[a].add(b)
            if both_ways:
                out[b].add(a)
        return out


def _pairs(paths: DataFrame, *keys: str) -> DataFrame:
    """Distinct consecutive pairs of a column of paths, by keys; with null after the last activity."""
    told = F.explode(F.transform("path", lambda a, i: F.struct(a.alias("a"), F.get("path", i + 1).alias("b"))))
    return paths.select(*keys, told.alias("s")).select(*keys, "s.a", "s.b").distinct()


def _graph(rows: list) -> Graph:
    return Graph(sorted({r["a"] for r in rows}), {(r["a"], r["b"]) for r in rows if r["b"] is not None})


def graph(paths: DataFrame) -> Graph:
    """Activities and distinct consecutive pairs of a column of paths."""
    return _graph(_pairs(paths).collect())  # (activities + 1) ** 2 rows at most


def _reached(start: str, to: dict[str, set[str]]) -> set[str]:
    seen, open_ = {start}, [start]
    while open_:
        for other in to[open_.pop()] - seen:
            seen.add(other)
            open_.append(other)
    return seen


def components(g: Graph) -> list[list[str]]:
    """Parts that no pair links, each sorted, in the collated order of their first members."""
    to, left, out = g.neighbours(True), set(g.activities), []
    while left:
        part = _reached(min(left), to)
        out.append(sorted(part))
        left -= part
    return sorted(out, key=lambda p: collation_key(p[0]))


def layers(g: Graph) -> list[list[str]]:
    """Strongly connected parts, gathered by the length of the longest chain of parts before them."""
    to = g.neighbours(False)
    reach = {a: _reached(a, to) for a in g.activities}
    part = {a: frozenset(b for b in reach[a] if a in reach[b]) for a in g.activities}
    before: dict[frozenset, set[frozenset]] = {p: set() for p in part.values()}
    for a, b in g.pairs:
        if part[a] != part[b]:
            before[part[b]].add(part[a])
    level: dict[frozenset, int] = {}
    while len(level) < len(before):
        ready = [p for p in before if p not in level and before[p] <= level.keys()]
        for p in ready:
            level[p] = 1 + max((level[q] for q in before[p]), default=-1)
    out: list[list[str]] = [[] for _ in range(1 + max(level.values()))]
    for p, n in level.items():
        out[n].extend(p)
    return [sorted(x) for x in out]


def of_nodes(paths: DataFrame, nodes: dict[int, list[str]]) -> DataFrame:
    """node, path, first_case: for each node the paths with only its activities; paths without any go."""
    table = F.array(*(F.struct(F.lit(n).alias("node"), F.array(*map(F.lit, acts)).alias("acts")) for n, acts in nodes.items()))
    own = F.transform(table, lambda n: F.struct(n["node"].alias("node"), F.filter("path", lambda a: F.array_contains(n["acts"], a)).alias("path")))
    kept = F.explode(F.filter(own, lambda x: F.size(x["path"]) > 0))
    return paths.select(kept.alias("x"), "first_case").select("x.node", "x.path", "first_case")


def _first_paths(rows: DataFrame) -> dict[int, list[list[str]]]:
    """Of each node its MAX_PATHS first distinct paths."""
    first = rows.groupBy("node", "path").agg(F.min("first_case").alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("at", "path"))).where(F.col("n") <= MAX_PATHS)
    out: dict[int, list[list[str]]] = {}
    for r in sorted(ranked.collect(), key=lambda r: r["n"]):
        out.setdefault(r["node"], []).append(list(r["path"]))
    return out


def _cut(g: Graph, depth: int) -> tuple[dict, list[list[str]] | None]:
    """(node, activities of its children, if these are nodes of the next depth); None: there is no cut."""
    if not g.activities:
        return {"operator": "tau"}, []
    if len(g.activities) == 1:
        only = leaf(g.activities[0])
        return ({"operator": "loop", "children": [only, {"operator": "tau"}]} if g.repeats else only), []
    if depth > MAX_DEPTH:
        return {"operator": "xor", "children": [leaf(a) for a in g.activities]}, []
    if len(parts := components(g)) > 1:
        return {"operator": "xor", "children": []}, parts
    if not _strongly_connected(g):
        return {"operator": "sequence", "children": []}, layers(g)
    if all((a, b) in g.pairs for a in g.activities for b in g.activities if a != b):
        return {"operator": "parallel", "children": [leaf(a) for a in g.activities]}, []
    return {"operator": "xor", "children": []}, None


def tree(paths: DataFrame) -> tuple[dict, int]:
    """(tree, number of fallbacks). paths: path, first_case; read once or twice for each depth of the tree."""
    fallbacks, depth, names = 0, 0, itertools.count()
    made: dict[int, dict] = {}
    root = next(names)
    level: dict[int, tuple[Graph, dict | None]] = {root: (graph(paths), None)}
    while level:
        below, stuck = {}, {}
        for n, (g, parent) in level.items():
            made[n], parts = _cut(g, depth)
            fallbacks += depth > MAX_DEPTH and len(g.activities) > 1
            if parent is not None:
                parent["children"].append(made[n])
            if parts is None:
                stuck[n] = g.activities
            for part in parts or []:
                below[next(names)] = part, made[n]
        if stuck:
            for n, told in _first_paths(of_nodes(paths, stuck)).items():
                made[n]["children"] = [leaf(p[0]) if len(p) == 1 else {"operator": "sequence", "children": [leaf(a) for a in p]} for p in told]
                fallbacks += 1
        rows: dict[int, list] = {n: [] for n in below}
        if below:
            for r in _pairs(of_nodes(paths, {n: part for n, (part, _) in below.items()}), "node").collect():
                rows[r["node"]].append(r)
        level, depth = {n: (_graph(rows[n]), parent) for n, (_, parent) in below.items()}, depth + 1
    return made[root], fallbacks


def _strongly_connected(g: Graph) -> bool:
    there = g.neighbours(False)
    back: dict[str, set[str]] = {a: set() for a in g.activities}
    for a, b in g.pairs:
        back[b].add(a)
    return all(len(_reached(g.activities[0], to)) == len(g.activities) for to in (there, back))


def nodes(root: dict) -> list[tuple]:
    """(node_id, parent_id, ord, operator, activity, depth) in depth-first order."""
    out: list[tuple] = []

    def visit(node: dict, parent: int | None, ord_: int, depth: int) -> None:
        me = len(out)
        out.append((me, parent, ord_, node["operator"], node.get("activity"), depth))
        for i, child in enumerate(node.get("children", ())):
            visit(child, me, i, depth + 1)

    visit(root, None, 0, 0)
    return out


NODES = "node_id int, parent_id int, ord int, operator string, activity string, depth int"


def tree_table(spark: SparkSession, train: DataFrame) -> DataFrame:
    root, _ = tree(written(variants_in_order(train), "variants"))
    return spark.createDataFrame(nodes(root), NODES)


def components_table(spark: SparkSession, train: DataFrame) -> DataFrame:
    parts = components(graph(train.select("path_key", "path").dropDuplicates(["path_key"])))
    return spark.createDataFrame([(i, a) for i, part in enumerate(parts) for a in part], "component int, activity string")


def model(spark: SparkSession, train: DataFrame) -> DataFrame:
    """One row: threshold, ends, retained edges, tree as JSON, fallbacks."""
    from flowloom.functions.hashing import stable_hash_of
    from flowloom.operators.profile import retained_edges, start_end
    from flowloom.schema import SEPARATOR

    edges = retained_edges(train).collect()
    ends = start_end(train).collect()
    count = train.count()
    root, fallbacks = tree(written(variants_in_order(train), "variants"))
    pick = lambda kind: sorted(r["activity"] for r in ends if r["kind"] == kind)
    kept = sorted("edge:" + stable_hash_of(r["from_activity"] + SEPARATOR + r["to_activity"]) for r in edges if r["retained"])
    row = ("inductive-dfg", "2.0.0", max(1, -(-count // 100)), pick("start"), pick("end"), kept, len(kept), len(edges), json.dumps(root, ensure_ascii=False), fallbacks)
    schema = "algorithm string, algorithm_version string, min_edge_frequency long, start_activities array<string>, end_activities array<string>, retained_edge_ids array<string>, retained_edges int, total_edges int, process_tree string, fallback_count int"
    return spark.createDataFrame([row], schema)
