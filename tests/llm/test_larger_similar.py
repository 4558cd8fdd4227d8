"""The near-copy stage goes by SimHash; the prefix filter only adds to its groups."""

from tests.llm.test_operators import prose
from tests.llm.test_similar import kept

import corpus_pipeline
from flowloom.llm import simhash


def test_fingerprints_make_the_groups(spark, monkeypatch):
    """Long texts with one word changed have near fingerprints: these alone find them, all stay verified, and the whole stage misses none."""
    rows = []
    for i in range(30):
        words = prose(1500, i).split()
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join([*words[:700], "changed", *words[701:]])), (3 * i + 2, " ".join(words[:-250]))]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), kept(rows)
    ids = lambda: {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert want == set(range(0, 90, 3)) and ids() == want
    prefixes = simhash._prefixes
    monkeypatch.setattr(simhash, "_prefixes", lambda *a: prefixes(*a).limit(0))
    alone = ids()
    assert want < alone and len({i for i in alone if i % 3 == 1}) < 8
