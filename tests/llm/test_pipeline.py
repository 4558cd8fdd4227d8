"""The corpus pipeline, stage by stage, against plain versions on a small corpus."""

import random

import pytest
from tests.llm import brute
from tests.llm.test_operators import prose

import corpus_pipeline
from flowloom.llm import bpe, decontaminate, quality, simhash


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    top, r = tmp_path_factory.mktemp("corpus"), random.Random(8)
    item = "Wie viele Wege führen von der alten Brücke bis zum Markt, wenn keiner zweimal gegangen wird?"
    rows, labels = [], []
    for i in range(160):
        text, toxic, good = prose(200, i), 0, 1
        if i % 8 == 0:
            text, toxic = text + " awfulword", 1
        elif i % 8 == 1:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif i % 8 == 2:
            text = "A line that many of them share.\n" + text
        elif i % 8 == 3 and i > 8:
            words = prose(200, i - i % 40 + 4).split()  # a near copy of the document that has this seed
            text = " ".join([*words[:30], "changed", *words[31:]])
        elif i == 21:
            text += " " + item
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, good, toxic))
    rows += [(200, rows[4][1], "en", "s", 1), (201, None, None, None, None), (202, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows, item


def test_stages_against_plain_versions(spark, corpus, tmp_path):
    top, rows, item = corpus
    docs, names = spark.read.parquet(f"{top}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "bpe tokens"]
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], top).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < 4:
            assert tables[-1].columns == names
    texts = [{r["doc_id"]: r["text"] for r in t.select("doc_id", "text").collect()} for t in tables[:5]]
    model, features = quality.fit(docs, spark.read.parquet(f"{top}/labels.parquet")), quality.Features()
    assert texts[1] == {i: t for i, t in texts[0].items() if model.tails(features.of(t))[1] >= quality.LEAST}
    bad = {i for i, *_ in rows[:160] if i % 8 < 2}
    assert not bad & set(texts[1]) and len(texts[1]) >= 115
    kept = brute.kept_lines(sorted(texts[1].items()))
    assert texts[2] == {i: t for i, (_, n, t) in kept.items() if t.strip() or not n}
    ids = sorted(texts[2])
    sets = [simhash.shingles(texts[2][i], 5) for i in ids]
    first = {i: i for i in ids}
    for a, i in enumerate(ids):
        for b, j in enumerate(ids[:a]):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                first[i] = min(first[i], first[j])
    assert set(texts[3]) == {i for i in ids if first[i] == i} < set(texts[2])
    budget = int(decontaminate.ERROR_RATE * len(decontaminate.normalise(item)))
    assert set(texts[4]) == {i for i, t in texts[3].items() if brute.edits(decontaminate.normalise(item), decontaminate.normalise(t)) > budget}
    assert 21 in texts[3] and 21 not in texts[4]
    encoder = bpe.ChunkEncoder(bpe.tokenizer_path("word_bpe_49k.json"))
    assert {r["doc_id"]: bytes(r["ids"]) for r in tables[5].collect()} == {i: encoder.encode(t or "")[0] for i, t in texts[4].items()}


def test_whole_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.count() == out.select("doc_id").distinct().count() > 80


def test_similar_groups_of_repeats_and_nulls(spark):
    rows = [(5, prose(50, 1)), (5, prose(50, 1)), (3, prose(50, 1)), (None, prose(50, 1)), (None, prose(50, 2)), (9, None), (8, ""), (7, "one")]
    got = simhash.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in got) == sorted([("3", prose(50, 1)[:3]), ("None", prose(50, 2)[:3]), ("8", ""), ("7", "one")])
    assert simhash.first_of_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_with_names_of_the_stages_stay(spark):
    rows = [(1, prose(50, 1), "a", "b", 5, "c"), (2, prose(50, 1), "d", "e", 6, "f"), (3, prose(50, 3), "g", "h", 7, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __node string, root int, n string")
    got = sorted(map(tuple, simhash.first_of_similar(docs).collect()))
    assert got == [rows[0], rows[2]] and simhash.first_of_similar(docs).columns == docs.columns
