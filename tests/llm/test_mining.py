"""Hard negatives, licence scans and whitening against plain versions."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from flowloom.llm import licenses, negatives, whiten
from flowloom.llm.license_rules import BASE, RULES, STRENGTH, expanded, read_rules

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def vectors(n=260, dims=6, labels=4, seed=3):
    """Rows with ties, repeats, nulls, bad components, other lengths and columns that clash."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=dims), 1)], int(rng.integers(labels))) for i in range(n)]
    rows[50] = (50, rows[0][1], rows[0][2])  # two anchors that are alike
    rows += [(100_000 + i, rows[7][1], rows[7][2]) for i in range(n // 2)]  # a third are copies of one row
    rows += [(202000, None, 1), (202001, [1.0] * (dims - 1) + [None], 1), (202050, [math.nan] * dims, 1), (202002, [math.inf] * dims, 1), (202100, [1.0] * dims, None), (202150, [1.0], 1), (202003, [], 1), (202200, [0.0] * dims, 2)]
    return [(*r, 9, "x") for r in rows]


def good(rows, dims):
    return [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == dims and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_negatives(rows, dims, scale=256, k=5, m=3):
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label, *_ in good(rows, dims) if label is not None]
    out = []
    for a, x, own in usable:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b, label) for b, y, label in usable if b != a)
        for s, p, _ in [t for t in scored if t[2] == own][:k]:
            fit = [t for t in scored if t[2] != own and 50 * -s <= 100 * -t[0] <= 95 * -s][:m]
            out += [(a, p, i + 1, t[1], -s, -t[0]) for i, t in enumerate(fit)]
    return sorted(out)


def mined(df, **more):
    got = negatives.mine(df, F.col("vec_id") % 50 == 0, **more)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())


@pytest.mark.parametrize(("labels", "parts"), [(4, 1), (2, 7), (40, 3)])
def test_negatives_against_all_pairs(spark, labels, parts):
    rows = vectors(labels=labels)
    want = plain_negatives(rows, 6)
    assert len(want) > 20
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(parts)) == want


def test_negatives_in_many_blocks(spark, monkeypatch):
    """Anchors in several blocks, products in small pieces."""
    rows = vectors(n=4000, seed=5, labels=9)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 1)
    monkeypatch.setattr(negatives, "CELLS", 5000)
    assert mined(spark.createDataFrame(rows, VECTORS).repartition(3)) == plain_negatives(rows, 6)


def test_negatives_of_large_components_and_other_labels(spark):
    """Beyond what float64 sums exactly, and labels that are text."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 2.0**20], f"l{i % 3}") for i in range(120)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), F.col("vec_id") % 50 == 0)
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect()) == plain_negatives(rows, 4)
    too_large = spark.createDataFrame([(i, [3e9 * 2**8] * 4, 0) for i in (0, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        mined(too_large)


def test_negatives_of_repeated_rows(spark):
    """An anchor given twice is asked once; equal candidates are candidates each."""
    rows = [(0, [1.0, 1.0], 0), (0, [1.0, 1.0], 0), (1, [2.0, 2.0], 0), (1, [2.0, 2.0], 0), (2, [1.5, 1.5], 1), (2, [1.5, 1.5], 1)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 0).collect()
    assert sorted((r["positive_rank"], r["positive_id"], r["rank"], r["negative_id"]) for r in got) == [(1, 1, 1, 2), (1, 1, 2, 2), (2, 1, 1, 2), (2, 1, 2, 2)]


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert mined(none) == []
    assert mined(spark.createDataFrame([r for r in vectors() if r[0] % 50], VECTORS)) == []
    assert mined(spark.createDataFrame([(50, [1.0, 2.0], 1, 0, "")], VECTORS)) == []


def test_best_keeps_the_first_of_ties():
    best = negatives.Best(2, 2)
    for ids in ([9, 4], [7, 1], [8]):
        best.add(np.zeros(len(ids), np.int64), np.full(len(ids), 5), np.array(ids))
    assert best.id.tolist() == [1, 4]


# ---- licences


def plain_scan(text, rules=RULES):
    """(words, base starts, kept (first, last, label, priority, rule)), with all pairs of detections compared."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text))
    line = " ".join(words)
    starts = dict(zip(itertools.accumulate([0] + [len(w) + 1 for w in words]), range(len(words)), strict=False))
    ends = {s + len(w): i for (s, i), w in zip(starts.items(), words, strict=False)}
    found = []
    for r in rules:
        signature = expanded(r.signature).replace(r"[^\x00]+", "[^ ]+")
        found += [(starts[m.start()], ends[m.end()], r.label, r.priority, r.number) for m in re.finditer(f"(?<![^ ])(?:{signature})(?![^ ])", line)]

    def over(e, d):
        within = e[0] <= d[0] and e[1] >= d[1]
        same = e[:2] == d[:2]
        return within and (e[3] > d[3] or e[3] == d[3] and (not same or e[4] < d[4]))

    base = sorted(f[0] for f in found if any(r.number == f[4] and r.base for r in rules))
    labels = {f[2] for f in found if any(r.number == f[4] and r.base for r in rules)}
    return len(words), base, labels, sorted(d for d in found if not any(over(e, d) for e in found))


NOTICES = [
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "All rights reserved. Copyright (c) 2021",
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-2.0-only OR MIT", "under the GNU Lesser General Public License v2.1 or later", "cc by cc by CC-BY", "CC BY 4.0 International",
    "the Library General Public License version 2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided", "either version 3 of the License, or (at your option) any later version. See the GNU", "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "dual licensed under MIT License and Apache 2.0 license", "général public license", "all rights", "reserved all rights reserved all", "accuracy by accident", "Mozilla Public License 2.0", "3-clause BSD license", "placed in the public domain",
]


def scanned(spark, texts, **more):
    rows = [(i % 3 if i else None, t, "w", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, `__licenses_words` string, labels int")
    return licenses.scan(df.withColumn("at", F.monotonically_increasing_id()).coalesce(1), **more).orderBy("at").collect()


def test_licenses_against_plain_regexes(spark):
    many = " ".join(NOTICES[i % len(NOTICES)] + " filler words" for i in range(400))
    texts = [None, "", " .,- ", *NOTICES, "\n".join(NOTICES), many, "x " * 3000, NOTICES[0], NOTICES[0]]
    rows = scanned(spark, texts)
    assert len(rows) == len(texts)
    assert all(r["__licenses_words"] == "w" and r["labels"] == 5 for r in rows)
    seen = set()
    for text, row in zip(texts, rows, strict=True):
        n, base, base_labels, kept = plain_scan(text)
        got = row["licenses"]
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (n, len(base), min(base, default=None), max(base, default=None)), text
        assert got["base_labels"] == sorted(base_labels)
        assert got["labels"] == sorted(base_labels | {k[2] for k in kept}), text
        assert sorted(map(tuple, got["detections"])) == kept
        assert got["score"] == pytest.approx(1 - math.prod(1 - STRENGTH[p] for _, p in {(k[2], k[3]) for k in kept}))
        seen |= set(got["labels"])
    assert {"cc-by-nc-4.0", "gpl-3.0", "mit", "lgpl-2.1", "apache-2.0", "bsd", "cc-by-nc-sa-4.0", "mpl-2.0", "public-domain"} <= seen


def test_every_rule_matches_its_own_words(spark):
    """Of each signature, the shortest text: the rule finds it, and its keyword is in it."""
    def shortest(signature):
        s = expanded(signature)
        for _ in range(9):
            for _ in range(9):
                s = re.sub(r"\((?:\?:)?[^()]*\)(?:\?|\{0,\d+\}\??)", "", s)  # optional groups
            s = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)(?:\{1,\d+\})?", r"\1", s)  # first alternatives
        s = re.sub(r"[a-z]\?", "", s)
        return re.sub(r"\[(.)[^\]]*\]\+?", lambda m: "a" if m[1] == "^" else m[1], s)

    texts = [shortest(r.signature) for r in RULES]
    for r, t in zip(RULES, texts, strict=True):
        assert r.keyword in t.split(), (r, t)
        assert re.fullmatch(expanded(r.signature), t), (r, t)
    assert len(RULES) > 250
    assert sum(r.base for r in RULES) == len(BASE)
    # each text by all rules, against the plain version
    for t, row in zip(texts, scanned(spark, texts), strict=True):
        assert sorted(map(tuple, row["licenses"]["detections"])) == plain_scan(t)[3], t


def test_suppression_keeps_higher_priority_and_partial_overlaps(spark):
    rules = read_rules("long | 1 | c | a b c d\nmid | 2 | c | b c\nlate | 2 | c | c d e\nsame | 2 | c | b c\ninner | 1 | c | c")
    (row,) = scanned(spark, ["x a b c d e c"], rules=rules)
    assert [(d["label"], d["first"], d["last"]) for d in row["licenses"]["detections"]] == [("long", 1, 4), ("mid", 2, 3), ("late", 3, 5), ("inner", 6, 6)]


def test_licenses_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licenses_use_no_python(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "cc by")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- whitening


def plain_whitening(rows, dims, k):
    ids, x = [r[0] for r in rows], np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in rows], dtype=object).reshape(len(rows), dims)
    n, s = len(rows), x.sum(0)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
    centred = np.array([[float((n * a - b) / n) for a, b in zip(row, s, strict=True)] for row in x.tolist()]).reshape(n, dims)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    return ids, deviation, centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


@pytest.mark.parametrize(("dims", "parts", "n"), [(6, 1, 260), (40, 5, 300), (16, 3, 100)])
def test_whitening_against_numpy(spark, dims, parts, n):
    rows = [r for r in vectors(n, dims) if r[0] not in (202003, 202150)]
    df = spark.createDataFrame(rows + [(None, [0.5] * dims, 1, 0, "")], VECTORS).repartition(parts)
    usable = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])] + [(None, [0.5] * dims)]
    ids, deviation, white, explained = plain_whitening(usable, dims, 32)
    out, model, error = whiten.whiten(df)
    got = {r["vec_id"]: r for r in out.collect()}
    assert len(got) == len(ids) and model.n == len(ids) and error < 1e-9
    np.testing.assert_allclose(model.explained, explained, rtol=1e-9)
    signs = np.sign((np.array([got[i]["whitened"] for i in ids]) * white).sum(0))
    np.testing.assert_allclose(np.array([got[i]["whitened"] for i in ids]) * signs, white, atol=1e-7)
    assert [int(got[i]["deviation"]) for i in ids] == deviation


def test_the_fit_is_the_same_for_all_layouts(spark, monkeypatch):
    df = spark.createDataFrame(vectors(200, 20), VECTORS)
    first = whiten.whiten(df.coalesce(1))[1]
    monkeypatch.setattr(whiten, "BLOCK_CELLS", 100)
    other = whiten.whiten(df.repartition(9))[1]
    assert (first.covariance == other.covariance).all() and first.sums == other.sums


def test_large_entries_are_summed_exactly(spark):
    rows = [(i, [float(2**40 * (i + 1)), float(i * i), -float(2**39 * i)]) for i in range(7)]
    usable = [(i, v) for i, v in rows]
    out, model, _ = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    _, deviation, _, explained = plain_whitening(usable, 3, 3)
    assert [int(r["deviation"]) for r in out.orderBy("vec_id").collect()] == deviation
    np.testing.assert_allclose(model.explained, explained, rtol=1e-9, atol=1e-15)


def test_components_without_variance_have_no_value(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    out, model, error = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert model.live.tolist() == [True, False, False] and error < 1e-9
    assert all(r["whitened"][1:] == [None, None] and r["whitened"][0] is not None for r in out.collect())
    one, same, none = whiten.whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>"))
    assert not same.live.any() and none is None and one.collect()[0]["whitened"] == [None] * 3


def test_whitening_of_nothing(spark):
    for df in (spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, None, 1, 1, "")], VECTORS)):
        out, model, error = whiten.whiten(df)
        assert out.collect() == [] and model is None and error is None
