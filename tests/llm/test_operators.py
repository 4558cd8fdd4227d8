"""Each operator against a plain version, on small tables with nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from flowloom.llm import ann, bpe, chat_format, decontaminate, line_dedup, lm, quality, sharding, simhash, warc
from flowloom.llm.support import ship

random.seed(5)
PARTS = ["the", "tion", "he", "ing", "ou", "é", "ß", "st", "er"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(PARTS) for _ in range(r.randint(1, 3))) for _ in range(n))


def texts():
    base = prose(120, 1)
    words = base.split()
    out = [base, base, base.upper(), " ".join([*words[:60], "other", *words[61:]]), " ".join([*words[:-1], "last"]), None, "", " \n\t ", "one", "one two", prose(9000, 2), "a" * 5000]
    shared = "A shared line of some length.\n"
    out += [shared + prose(10, i) + "\n  a SHARED line of some length. \nshort" for i in range(3, 9)]
    return out + [prose(30, i) for i in range(20, 40)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en", i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def with_repeats(docs):
    """The table once more, and rows without an id."""
    return docs.unionByName(docs).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))


# ---- simhash


def test_simhash_components(docs, empty):
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    all_ = texts()
    fps = [brute.simhash(t) for t in all_]
    assert got == {i: (fps[i], c) for i, c in enumerate(brute.components(list(range(len(all_))), fps))}
    assert simhash.near_duplicates(empty).count() == 0
    twice = simhash.near_duplicates(with_repeats(docs)).collect()
    assert len(twice) == 2 * len(all_) + 2 and {(r["doc_id"], r["component_id"]) for r in twice if r["doc_id"] is not None} == {(i, c) for i, (_, c) in got.items()}


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_links_are_complete(spark, parts):
    ship(spark)
    r = random.Random(parts)
    fps = {r.getrandbits(64) for _ in range(60)}
    for x in list(fps):
        for _ in range(3):
            y = x
            for b in r.sample(range(64), r.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    got = {(a, b) for a, b in simhash.links(spark.createDataFrame(signed, "fp long"), 3, parts).collect()}
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_thresholds_keep_the_principle():
    r = np.random.default_rng(0)
    for parts in (2, 3, 4):
        widths = [64 // parts] * parts
        values = [r.integers(0, 1 << w, 50) for w in widths]
        histograms = [r.integers(0, 9, 1 << min(12, w)).astype(float) for w in widths]
        chosen = simhash.allocate(values, widths, 3, histograms, 1000)
        assert (chosen.sum(1) == 3 - parts + 1).all() and chosen.min() >= -1


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, simhash.components(pairs).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- bpe


ODD = ["", " ", "<|endoftext|>x<|startoftext|> y" * 30, "don't we'll " * 90, "é" * 3000, "a" * 7000, "İSTANBUL ΑΣ Σ" * 200, "'re'" * 900, "각" * 1500, "J̌J̌ " * 200, "x y z " * 300, "1234 56,7. " * 200]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("word_bpe_49k.json")
    own, library = bpe.ChunkEncoder(path), Tokenizer.from_file(path)
    r = random.Random(9)
    mixed = ["".join(r.choice("abcé ́\n ß日😀's1<|>$.,") for _ in range(4000)) for _ in range(4)]
    for t in [*ODD, *mixed, *(x or "" for x in texts()), *ODD]:
        ids = library.encode(t, add_special_tokens=False).ids
        got, decoded = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids and decoded == library.decode(ids, skip_special_tokens=False)


def test_vocabularies_that_keep_blanks_are_refused():
    with pytest.raises(ValueError, match="keeps blanks"):
        bpe.ChunkEncoder(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_stores_are_bounded_and_released():
    own = bpe.ChunkEncoder(bpe.tokenizer_path("word_bpe_49k.json"), store_bytes=20_000)
    for i in range(30):
        own.encode(prose(400, i))
    assert all(s.size <= s.limit for s in (own.chunks, own.pieces, own.seams))
    own.forget()
    assert not any(s.size or s.young or s.old for s in (own.chunks, own.pieces, own.seams))


def test_plain_words_are_encoded_by_the_model_alone():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("word_bpe_49k.json")
    own, library = bpe.ChunkEncoder(path), Tokenizer.from_file(path)
    r = np.random.default_rng(5)
    plain = sorted({t.removesuffix("</w>") for t in library.get_vocab() if re.fullmatch("[a-z]+(</w>)?", t)})[::7]
    plain += ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in r.integers(1, 60, 2000)]
    words = list(dict.fromkeys(w.encode() for w in plain))
    own.tokenizer = None  # no normalizing and splitting of what is plain
    for _ in range(2):  # new, and from the store
        for word, (ids, decoded) in zip(words, own._cached(words * 2, own.pieces), strict=False):
            want = library.encode(word.decode(), add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


def test_equal_passages_are_cut_alike():
    passage = prose(2000, 3).encode()
    a, b = (set(np.array(bpe.cut_points(p + passage)) - len(p)) for p in (b"", b"another beginning "))
    late = {x for x in a if x > 64}
    assert late and late <= b


def test_bpe_of_a_table(docs, empty):
    more = docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    got = bpe.encode_documents(more).collect()
    assert len(got) == len(texts()) and {type(r["ids"]) for r in got} <= {bytes, bytearray}
    assert bpe.encode_documents(with_repeats(docs), digests=True).count() == 2 * len(texts()) + 2
    assert bpe.encode_documents(empty).count() == 0


# ---- quality


def test_quality_learns_grades(spark):
    ship(spark)
    r = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        t, toxic, good = prose(40, 1000 + i), 0, 1
        if i % 5 == 0:
            t, toxic = t + " awfulword " + prose(5, i), 1
        elif i % 5 == 1:
            t, good = " ".join(w.upper() + "!!" for w in t.split()), 0
        rows.append((i, t, 1.0))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_ge1 double")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels.where("doc_id < 300"))
    assert model.thresholds[0] < model.thresholds[1]
    got = {x["doc_id"]: x for x in quality.score(docs, model).collect()}
    held = range(300, 400)
    assert sum((got[i]["p_ge2"] >= 0.7) == (i % 5 > 1) for i in held) >= 98
    assert all(0 <= got[i]["p_ge2"] <= got[i]["p_ge1"] <= 1 for i in held)
    means = [np.mean([got[i]["expected_grade"] for i in held if i % 5 == k]) for k in (0, 1, 2)]
    assert means[0] < means[1] < means[2]
    kept = quality.select_good(docs, labels).collect()
    assert {x["doc_id"] for x in kept} <= {i for i in range(400) if i % 5 > 1} | set(held) and r


def plain_features(text):
    """The names of a text's features, one by one."""
    shape = lambda w: "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or c > "\x7f" else "0" if c.isdigit() else c for c in w)
    squeezed = lambda s: "".join(c for i, c in enumerate(s) if not i or s[i - 1] != c)
    words, lines = text.split(), text.split("\n")
    n, size = len(words), max(1, len(text.encode()))
    octets = lambda t: t.encode().decode("latin-1")
    kinds = shape(octets(text))
    upper, lower, digit = kinds.count("A"), kinds.count("a"), kinds.count("0")
    distinct = sum(len(set(words[i : i + 1000])) for i in range(0, n, 1000)) / max(1, n)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n)
    bands = {
        "upper": upper / max(1, upper + lower), "digit": digit / size, "mark": 1 - (upper + lower + digit + text.count(" ") + text.count("\n")) / size, "distinct": distinct, "again": again,
        "lines": len(set(lines)) / len(lines), "words": n.bit_length() / 20, "length": (size / max(1, n)) / 20,
    }
    out = {w.strip(".,;:!?()[]{}\"'").lower() for w in words} | {"s:" + squeezed(shape(octets(w))) for w in words}
    return {x.encode("latin-1") if x.startswith("s:") else x.encode() for x in out} | {f"r:{k}:{min(20, int(20 * v))}".encode() for k, v in bands.items()}


def test_quality_features_and_tails_against_plain_ones():
    for t in ["", "One two  two.\nOne\n\nTHREE 44 (x)", prose(2600, 4), "again " * 1500 + prose(900, 5)]:
        assert quality.Features().of(t) == {quality._hash(f) for f in plain_features(t)}
    model = quality.Model({quality._hash(b"one"): 1.5, quality._hash(b"two"): -0.25}, (-0.5, 0.75))
    tails = model.tails(quality.Features().of("One two one"))
    assert np.allclose(tails, [1 / (1 + np.exp(-0.5 - 1.25)), 1 / (1 + np.exp(0.75 - 1.25))])


def test_quality_fit_is_at_the_best_likelihood():
    r = random.Random(2)
    rows = [(g, sorted({r.randrange(6), *([g + 6] if r.random() < 0.7 else [])})) for g in [0, 1, 2] * 60]

    def loss(w, t1, t2):
        total = 0.0
        for g, places in rows:
            f = sum(w[p] for p in places)
            a, b = (1 / (1 + np.exp(t - f)) for t in (t1, t2))
            total -= np.log([1 - a, a - b, b][g])
        return total / len(rows) + 2e-4 * float(np.square(w).sum()) / 2

    w, t1, t2 = quality.fit_ordinal(rows, 9, rounds=3000)
    at = np.array([*w, t1, t2])
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-4
        slope = (loss((at + step)[:9], *(at + step)[9:]) - loss((at - step)[:9], *(at - step)[9:])) / 2e-4
        assert abs(slope) < 2e-3


def test_quality_without_labels_or_texts(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.select_good(docs, none).count() == len(texts())
    odd = spark.createDataFrame([(None, 1, 1), (0, None, None), (1, None, 1), (1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert dict(map(tuple, quality.grades(odd).collect())) == {1: 0, 2: 2}
    assert quality.select_good(empty, odd).count() == 0
    assert quality.select_good(with_repeats(docs), odd).count() <= 2 * len(texts()) + 2


# ---- language model


def test_lm_counts_and_scores(docs, empty):
    got = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    own = {i: re.findall(rb"[^\x20\x09-\x0D]+", brute.lower(t).encode()) + [b""] for i, t in enumerate(texts())}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in own}
    c = Counter(w for i, ws in own.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in own.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert lm.score_documents(empty).count() == 0
    assert lm.score_documents(with_repeats(docs)).count() == 2 * len(own) + 2


# ---- lines


def test_lines_against_brute_force(docs, empty):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("x"))).collect()}
    assert got == brute.kept_lines(list(enumerate(texts())))
    assert sum(d for _, d, _ in got.values()) > 5
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_one_document_given_twice_stay(spark):
    ship(spark)
    rows = [(1, "A line that is here twice."), (1, "A line that is here twice."), (None, "A line that is here twice."), (None, "Another line of text.")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_dropped"], r["text"]) for r in got) == [(-1, 0, "Another line of text."), (-1, 1, ""), (1, 0, rows[0][1]), (1, 0, rows[0][1])]


def test_shards_asked_in_parts_and_many_documents_without_ids(spark, monkeypatch):
    """Frequent keys below the hot share, and rows without an id, which are one document that comes last."""
    ship(spark)
    monkeypatch.setattr(line_dedup, "SHARD_REFS", 20)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    rows = [(i, f"a line that many documents have\nown line number {i}\nline of some {i % 7} documents") for i in range(300)]
    rows += [(None, f"a line that many documents have\nown line number {i}\nonly in nameless {i % 3}") for i in range(250, 350)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute.kept_lines([(line_dedup.LAST_DOC if i is None else i, t) for i, t in rows[:300]])
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got if r["doc_id"] is not None} == want
    nameless = sorted(r["text"] for r in got if r["doc_id"] is None)
    assert nameless == sorted("\n".join(([] if i < 300 else [f"own line number {i}"]) + [f"only in nameless {i % 3}"]) for i in range(250, 350))


def test_perfect_hash_is_minimal_and_knows_strangers():
    r = np.random.default_rng(1)
    lo, hi = r.integers(-(2**63), 2**63, 5000), r.integers(-(2**31), 2**31, 5000).astype(np.int32)
    mph = line_dedup.PerfectHash.build(lo, hi)
    at = mph.index(lo, hi)
    assert sorted(at.tolist()) == list(range(5000))
    fingerprints = np.zeros(5000, np.uint64)
    fingerprints[at] = line_dedup._fingerprint(lo, hi)
    other, more = r.integers(-(2**63), 2**63, 5000), hi
    found = mph.index(other, more)
    assert not (fingerprints[found[found >= 0]] == line_dedup._fingerprint(other, more)[found >= 0]).any()


# ---- leaks


def test_leaks_with_edits(spark, docs, empty):
    ship(spark)
    item = "Das ist ein langer Satz aus einer Aufgabe, den kein Text enthalten soll; wirklich keiner davon."
    edited = item.replace("langer", "lamger").replace("Aufgabe", "Aufgbe").replace("wirklich", "wirklichh")
    far = item.replace("e", "X")
    rows = [(0, prose(40, 1) + " " + item + " " + prose(40, 2)), (1, prose(5, 1) + "\n" + edited.upper() + " x"), (2, far), (3, None), (4, item[:50]), (5, " ".join(item.split()[:-1])), (5, item)]
    items = spark.createDataFrame([(7, item, 1), (8, None, 2), (9, "short", 3)], "item_id long, text string, distance int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(table, items).collect())
    want = []
    for i, t in rows:
        d = brute.edits(decontaminate.normalise(item), decontaminate.normalise(t))
        if d <= int(0.08 * len(decontaminate.normalise(item))):
            want.append((i, 7, d))
    assert got == sorted(want) and (1, 7, 3) in got
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(table, items).collect()) == sorted(i for i, t in rows if (i, t) not in {rows[k] for k in (0, 1, 5, 6)})
    assert decontaminate.matches(empty, items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0


def test_item_ids_of_other_types(spark):
    ship(spark)
    item = "an item of the benchmark that is long enough to be found"
    found = decontaminate.matches(spark.createDataFrame([(1, f"before {item} after")], "doc_id long, text string"), spark.createDataFrame([("a", item), ("b", item[::-1])], "item_id string, text string"))
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()] == [(1, "a", 0)]


def test_myers_against_dynamic_programming():
    r = random.Random(3)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, 80))) for _ in range(2))
        assert decontaminate.myers(decontaminate.pattern_bits(p), len(p), t, 0, len(t))[0] == brute.edits(p, t)


# ---- shards


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards_are_even_and_gapless(docs, empty, law):
    many = docs.where("doc_id <> 10").withColumn("size", F.lit("x")).crossJoin(docs.sparkSession.range(20)).withColumn("doc_id", F.col("doc_id") * 100 + F.col("id")).drop("id")
    got = sharding.shard(many, shards=7, law=law).collect()
    assert len(got) == many.count()
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(7))
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    load = [sum(r["size"] if law == "bytes" else 1 for r in rows) for rows in by.values()]
    assert max(load) - min(load) <= (1 if law == "rows" else 0.25 * sum(load) / 7)
    assert sharding.shard(empty).count() == 0
    few = sharding.shard(with_repeats(docs), shards=24).collect()
    assert len(few) == 2 * len(texts()) + 2


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_24_shards_against_a_plain_sort(spark, law):
    r = random.Random(4)
    rows = [(i, prose(r.choice([1, 5, 20, 60]), i % 2600)) for i in range(3000)] + [(5000 + i, "a text of many copies " * 4) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x for x in sharding.shard(docs, shards=24, law=law).collect()}
    hashes = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    order = sorted(got, key=lambda i: (hashes[i] % 2**64, i))
    shards = [got[i]["shard"] for i in order]
    assert shards == sorted(shards) and set(shards) == set(range(24))
    weight = {i: len(t.encode()) + 8 if law == "bytes" else 1 for i, t in rows}
    loads, slots = [0] * 24, {}
    for i in order:
        assert got[i]["size"] == len(got[i]["text"].encode()) + 8
        loads[got[i]["shard"]] += weight[i]
        slots.setdefault(got[i]["shard"], []).append(got[i]["slot"])
    mean = sum(loads) / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(x - mean) <= (1 if law == "rows" else 0.03 * mean + max(weight.values())) for x in loads)


def test_slots_are_numbered_in_parts_that_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SUBS", 1)
    monkeypatch.setattr(sharding, "PART_ROWS", 7)
    out = sharding.shard(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text")), 3, "rows").collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (166, 167)


def test_shards_split_one_huge_group(spark):
    same = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same text for all").alias("text"))
    got = dict(map(tuple, sharding.shard(same, shards=8).groupBy("shard").count().collect()))
    assert len(got) == 8 and max(got.values()) - min(got.values()) <= 12


# ---- neighbours


def test_neighbours_recall_and_scores(spark):
    ship(spark)
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 32))
    x[100] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [1.0] * 31), (None, [1.0] * 32), (9004, [None] + [1.0] * 31)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for a in ann.search(vectors, vectors.where("vec_id % 50 = 0")).collect():
        got.setdefault(a["query_id"], []).append((a["rank"], a["vec_id"], a["score"]))
    norms, hits = np.linalg.norm(x, axis=1), 0
    assert set(got) == set(range(0, 3000, 50))
    for q, found in got.items():
        found.sort()
        s = x @ x[q] / norms / norms[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -s))[:5]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(score == pytest.approx(s[v], abs=1e-12) for _, v, score in found)
    assert hits / (5 * len(got)) >= 0.9 and got[50][0][1] == 100
    assert ann.search(vectors.limit(0), vectors.limit(0)).count() == 0
    tiny = vectors.where("vec_id < 3")
    assert ann.search(tiny, tiny).count() == 6


def test_neighbours_do_not_depend_on_the_layout(spark):
    """Also queries that find too little within the learned radius."""
    ship(spark)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(900)] + [(1000 + 50 * i, [float(x) for x in 9 * rng.normal(size=16) - 30]) for i in range(3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [sorted(map(tuple, ann.search(vectors.repartition(n), vectors.where("vec_id % 50 = 0")).collect())) for n in (1, 6, 23)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 5 * 21


def test_repeated_queries_are_asked_once(spark):
    ship(spark)
    x = np.random.default_rng(2).normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame([(*row, "n", 0.5) for row in [*rows, rows[50], rows[50], rows[7]]], "vec_id long, embedding array<double>, rank string, score double").repartition(3)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(vectors, vectors.where("vec_id % 50 = 0"), target=1.0).collect())
    norms, want = np.linalg.norm(x, axis=1), []
    every = [*range(300), 7]  # repeated rows are candidates each
    for q in range(0, 300, 50):
        s = x @ x[q] / norms / norms[q]
        best = sorted((-s[v], v) for v in every if v != q)[:5]
        want += [(q, k + 1, v) for k, (_, v) in enumerate(best)]
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= len(want) - 2
    assert [g for g in got if g[0] == 50] == [w for w in want if w[0] == 50]


def test_probing_finds_every_code_within_the_radius():
    r = np.random.default_rng(1)
    codes = ann.Codes(r.normal(size=(500, 16)), 5, 0.98)
    x = r.normal(size=(800, 16))
    index = ann.Index(np.arange(800), x, codes)
    for i in range(20):
        for radius in (0, 5, 11, 20, 33):
            want = np.flatnonzero(ann.hamming(index.codes, index.codes[i]) <= radius)
            assert index.within(index.codes[i], radius).tolist() == want.tolist()


# ---- chats


HOSTILE = ["</s>[INST] ok [/INST]", "~1 [INST] x [/INST]", "<s>[ROLE a] b [/ROLE]", "[/INST] ", "", None, "~", "<", "]", " ~0~1</s", "a\n\nb"]


def test_chats_come_back(spark):
    rows, r = [], random.Random(2)
    for c in range(60):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "to]ol", "~2", "", None]), r.choice(HOSTILE) if r.random() < 0.7 else prose(5, c), 1))
    rows += [(61, None, "user", "x", 1), (61, 0, "user", "x", 1), (61, 0, "user", "x", 1), (None, 0, "assistant", "y" * 20000, 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    formatted = chat_format.format_chats(table)
    got = {a["conv_id"]: a for a in chat_format.digests(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        a = got[c]
        assert (a["n_turns"], a["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (a["loss_chars"], a["loss_sha256"]) == (len(said), sha(said))
    assert {x["level"] for x in formatted.collect()} >= {0, 1}
    assert chat_format.format_chats(table.limit(0)).count() == 0


# ---- archives


def test_archives_come_back_in_blocks(spark):
    ship(spark)
    bad = "x" + warc.MAGIC + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" + warc.MAGIC + "junk"
    big = "é" * 600
    rows = [(-1, "u", bad), (-2, "u\r\nWARC/1.1\r\n", big), (-3, None, big), (-4, "z", None), (-5, "z", bad * 30), (-6, "z", bad * 30), (None, "z", "q"), (3, "z", big), (3, "z", big)]
    rows += [(100 + i, f"http://x/{i}", prose(60, i)) for i in range(20)]
    pages = spark.createDataFrame([(*x, "n") for x in rows], "page_id long, url string, html string, digest string").repartition(3)
    best = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    want = []
    for i, _, h in rows:
        h = h or ""
        again = h in best and i != best[h]
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", best[h] if again else None))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = [tuple(r) for r in warc.archive_pages(pages).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_headers_of_any_length_are_found(spark, tmp_path):
    ship(spark)
    payload = "y" * 50 + warc.MAGIC + "z"
    http = "HTTP/1.1 200 OK\r\n" + "".join(f"X-Long-{i}: {'v' * 90}\r\n" for i in range(200)) + f"Content-Length: {len(payload)}\r\n\r\n"
    block = http + payload
    head = f"{warc.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:4>\r\nWARC-Payload-Digest: sha1:x\r\nContent-Length: {len(block)}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((head + block + warc.END).encode() * 2)
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r["payload_bytes"], r["payload_sha1"]) for r in got] == [(len(payload), hashlib.sha1(payload.encode()).hexdigest())] * 2
