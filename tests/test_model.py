"""Trees and alignments against plain versions."""

import os
import random
import time
import tracemalloc

import pytest

from flowloom.operators import conformance, model, traces
from flowloom.sources import adapters


def plain_tree(paths, depth=0):
    """The tree by recursion over whole lists of (path, first case)."""
    g = model.Graph(sorted({a for p, _ in paths for a in p}), {x for p, _ in paths for x in zip(p, p[1:], strict=False)})
    if len(g.activities) <= 1 or depth > model.MAX_DEPTH:
        return model._cut(g, depth)[0]
    parts = model.components(g)
    operator = "xor" if len(parts) > 1 else "sequence"
    if len(parts) == 1 and not model._strongly_connected(g):
        parts = model.layers(g)
    if len(parts) > 1:
        return {"operator": operator, "children": [plain_tree([(q, c) for p, c in paths if (q := [a for a in p if a in part])], depth + 1) for part in parts]}
    if all((a, b) in g.pairs for a in g.activities for b in g.activities if a != b):
        return {"operator": "parallel", "children": [model.leaf(a) for a in g.activities]}
    first = {}
    for p, c in paths:
        first[tuple(p)] = min(first.get(tuple(p), c), c)
    told = sorted(first, key=lambda p: (first[p], p))[: model.MAX_PATHS]
    return {"operator": "xor", "children": [model.leaf(p[0]) if len(p) == 1 else {"operator": "sequence", "children": [model.leaf(a) for a in p]} for p in told]}


@pytest.mark.parametrize("seed", range(6))
def test_trees_against_recursion(make_log, seed):
    r = random.Random(seed)
    blocks = [["a"], ["b", "c"], ["d", "e", "f"], ["g"], ["h", "i"]]
    def path():
        out = []
        for b in blocks:
            kind = (seed + len(b)) % 3
            out += r.sample(b, len(b)) if kind == 0 else [r.choice(b)] * r.randint(1, 2) if kind == 1 else b[r.randrange(len(b)) :] + b[: r.randrange(len(b)) + 1]
        return out

    cases = [(f"c{i:03}", path(), []) for i in range(40)]
    root, _ = model.tree(model.variants_in_order(traces.traces(make_log(cases))))
    assert root == plain_tree([(p, c) for c, p, _ in cases])


def test_two_jobs_a_level_at_most(spark, make_log):
    log = make_log([("A", ["a", "b", "c", "d", "e"], []), ("B", ["a", "c", "b", "d", "f", "f"], []), ("C", ["a", "g", "h", "i", "g", "e"], []), ("D", ["a", "i", "g", "h", "d"], [])])
    paths = model.variants_in_order(traces.traces(log))
    calls = []
    real = type(paths).collect
    try:
        type(paths).collect = lambda self: calls.append(1) or real(self)
        root, fallbacks = model.tree(paths)
    finally:
        type(paths).collect = real

    def deep(n):
        return 1 + max(map(deep, n.get("children", ())), default=0)

    assert len(calls) <= 2 * deep(root)


def cost(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[j - 1]))
        row = new
    return row[-1]


def plain_moves(log, ref):
    """By the whole table."""
    far = [list(range(len(ref) + 1))]
    for i, a in enumerate(log, 1):
        row = [i]
        for j, b in enumerate(ref, 1):
            row.append(far[i - 1][j - 1] if a == b else 1 + min(far[i - 1][j], row[j - 1]))
        far.append(row)
    i, j, out = len(log), len(ref), []
    while i or j:
        if i and j and log[i - 1] == ref[j - 1]:
            i, j = i - 1, j - 1
            out.append("sync")
        elif i and (not j or far[i - 1][j] <= far[i][j - 1]):
            i -= 1
            out.append("log")
        else:
            j -= 1
            out.append("model")
    return out[::-1]


def test_moves_are_those_of_the_whole_table():
    r = random.Random(4)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 30))] for _ in range(2))
        moves = conformance.align(a, b)
        assert [m[0] for m in moves] == plain_moves(a, b) and sum(m[3] for m in moves) == cost(a, b)


def test_long_paths_align_in_little_memory():
    r = random.Random(1)
    a = [r.choice("abcdefgh") for _ in range(10_000)]
    b = [x for x in a if r.random() > 0.1]
    tracemalloc.start()
    begun = time.perf_counter()
    moves = conformance.align(a, b)
    took, peak = time.perf_counter() - begun, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(m[3] for m in moves) == len(a) - len(b)
    assert peak < 20e6 and took < 60


@pytest.mark.parametrize(("seed", "letters", "longest"), [(1, "abc", 6), (2, "abcdefghij", 12), (3, "ab", 20), (4, "abcdefghijklmnopqrstuvwxyz", 5)])
def test_nearest_variants_against_all_pairs(make_log, seed, letters, longest):
    r = random.Random(seed)
    path = lambda: [r.choice(letters) for _ in range(r.randint(1, longest))]
    held, train = [path() for _ in range(40)], [path() for _ in range(60)]
    log = make_log([(f"h{i}", p, []) for i, p in enumerate(held)] + [(f"t{i:02}", p, []) for i, p in enumerate(train)])
    cases = traces.traces(log)
    got = {r["path_key"]: r for r in conformance.nearest_variants(cases.where("case_id like 'h%'"), cases.where("case_id like 't%'")).collect()}
    assert set(got) == {"\u001f".join(p) for p in held}
    for p in held:
        row = got["\u001f".join(p)]
        best = min(cost(p, t) for t in train)
        # of equals the first in order: letters of one case are ordered alike by the collation
        ties = sorted((t for t in train if cost(p, t) == best), key=lambda t: "".join(t))
        assert row["cost"] == best and row["reference"] == ties[0]


def test_few_pairs_are_compared(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    cases = traces.split(traces.traces(adapters.session_log(spark, sf)))
    validation, train = cases.where("is_validation"), cases.where("not is_validation")
    n = conformance.nearest_variants(validation, train).agg({"verified": "sum"}).first()[0]
    asked = validation.select("path_key").distinct().join(train.select("path_key").distinct(), "path_key", "left_anti").count()
    assert n < 0.12 * asked * train.select("path_key").distinct().count()


def test_without_training_paths_there_is_none(make_log):
    cases = traces.traces(make_log([("a", ["x"], [])]))
    assert conformance.nearest_variants(cases, cases.limit(0)).collect() == []
