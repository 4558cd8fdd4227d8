"""Groups of similar documents against brute force over all pairs."""

import random

import pytest
from tests.llm.test_operators import prose

from flowloom.llm import simhash


def kept(rows, least=0.8):
    """The smallest doc_id of each component of the pairs with a similarity of at least `least`."""
    sets, root = [simhash.shingles(t, 5) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc_id), doc_id)
    return set(first.values())


def got(spark, rows):
    random.Random(3).shuffle(rows := list(rows))
    return {r["doc_id"] for r in simhash.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def own(n, seed):
    """n words of which no other text has any."""
    return [f"w{seed}x{i}" for i in range(n)]


def test_appended_and_cut_copies(spark):
    rows = []
    for i in range(40):
        words = own(120 + 3 * i, i)
        rows.append((4 * i, " ".join(words)))
        rows.append((4 * i + 1, " ".join(words + own(20 + i, f"a{i}"))))  # a passage added, about as much as the limit allows
        rows.append((4 * i + 2, " ".join(words[i % 9 : len(words) - 18 - i // 2])))
        rows.append((4 * i + 3, " ".join([*words[:50], "changed", *words[51:90], "again", *words[91:]])))
    want = kept(rows)
    assert 40 < len(want) < 120
    assert got(spark, rows) == want


@pytest.mark.parametrize("seed", range(3))
def test_hub_that_is_similar_to_neither(spark, seed):
    rows = []
    for i in range(30):
        shared = own(60, f"s{seed}x{i}")
        body = own(200, f"b{seed}x{i}")
        rows.append((3 * i, " ".join(shared + body)))
        rows.append((3 * i + 1, " ".join([*shared, *body[:100], "changed", *body[101:]])))
        rows.append((3 * i + 2, " ".join(shared + own(200, f"h{seed}x{i}"))))  # shares what the others share, and no more
    want = kept(rows)
    assert len(want) == 60
    assert got(spark, rows) == want


def test_chains_through_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(simhash, "STAR_ROUNDS", 1)
    r, rows, base = random.Random(5), [], prose(150, 1).split()
    for i in range(60):
        words = list(base)
        for at in r.sample(range(150), r.randrange(5)):
            words[at] = f"edit{i}"
        rows.append((i, " ".join(words)))
    assert got(spark, rows) == kept(rows)
    assert got(spark, [(1, "Ab c"), (2, "aB  C"), (3, "ab c d"), (4, None), (5, " \n"), (6, "ab")]) == {1, 3, 4, 6}


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "text_hash", lambda body: F.pmod(F.xxhash64(body), F.lit(5)))
    rows = [(i, " ".join(own(30, i % 20))) for i in range(60)] + [(100 + i, " ".join([*own(60, i), "end"])) for i in range(5)]
    assert got(spark, rows) == kept(rows)
