"""Planted signals: what each operator must find in small logs."""

import json
import statistics

import pytest
from pyspark.sql import functions as F

from flowloom.functions.hashing import hash_half, stable_hash, stable_hash_of, text_id
from flowloom.functions.text import attribute_kind, attribute_number, duration_pt, number_pt, timestamp_ms
from flowloom.operators import analysis, conformance, evidence, model, profile, quality, ranking, traces, waits

RAW = "seq long, case_id string, activity string, timestamp string, resource string, lifecycle string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_hash_is_that_of_utf16_units(spark):
    texts = ["", "PO-001", "Requisição criada", "😀x", "case-1234567890"]
    got = rows(spark.createDataFrame([(t,) for t in texts], "t string").select("t", stable_hash(F.col("t"))))
    assert dict(got) == {t: stable_hash_of(t) for t in texts}
    assert stable_hash_of("PO-001") == "8a68b35a13de683e"
    assert stable_hash_of("") == "811c9dc59e3779b9"


def test_numbers_times_and_attributes(spark):
    df = spark.createDataFrame([(1234.56, 0.25, 0.5)], "a double, b double, c double")
    assert rows(df.select(number_pt(F.col("a"), 1), number_pt(F.col("b"), 1), number_pt(F.col("c"), 2), duration_pt(F.col("c")), duration_pt(F.col("a")))) == [("1.234,6", "0,3", "0,5", "12 h", "1.234,6 dias")]
    times = {"2026-01-02T03:04:05Z": 1767323045000, "2026-01-02": 1767312000000, "1767323045": 1767323045000, "1767323045123": 1767323045123, "-5": None, "agora": None, "": None}
    got = dict(rows(spark.createDataFrame([(t,) for t in times], "t string").select("t", timestamp_ms(F.col("t")))))
    assert got == times
    cells = {"1200,50": ("number", 1200.5), "TRUE": ("bool", None), " ": ("null", None), "1.2.3": ("string", None)}
    got = {a: (b, c) for a, b, c in rows(spark.createDataFrame([(t,) for t in cells], "t string").select("t", attribute_kind(F.col("t")), attribute_number(F.col("t"))))}
    assert got == cells


def test_steps_edges_and_variants(make_log):
    log = make_log([("A", ["Request", "Approve", "Order"], [1, 2]), ("B", ["Request", "Approve", "Order"], [3, 4]), ("C", ["Request", "Revise", "Approve", "Order"], [])])
    steps, paths = traces.steps(log), traces.traces(log)
    edges = {(r["from_activity"], r["to_activity"]): r for r in profile.edge_stats(steps).collect()}
    assert edges["Request", "Approve"]["n"] == 2 and edges["Request", "Approve"]["mean"] == 2
    assert edges["Request", "Revise"]["sd"] == 0
    assert steps.where("next_activity is null and wait_days is null").count() == 3
    assert profile.variant_stats(paths).count() == 2
    m = profile.metrics(log, paths).first()
    assert (m["case_count"], m["event_count"], m["first_pass_rate"], m["transition_count"]) == (3, 10, 1.0, 7)
    assert profile.trend(paths).first()["month"] == "2026-01"


def test_ties_of_time_keep_the_order_of_input(spark):
    from flowloom.schema import LOG_SCHEMA

    log = spark.createDataFrame([(2, "A", "y", 5, "r", "unknown", None), (1, "A", "x", 5, "r", "unknown", None)], LOG_SCHEMA)
    assert traces.traces(log).first()["path"] == ["x", "y"]


def test_summary_of_a_long_tail(spark):
    from flowloom.functions.stats import summarise

    r = summarise(spark.createDataFrame([(v * 86_400_000,) for v in (1, 1, 1, 1, 20)], "v long"), "v").first()
    assert r["median"] == 1 and r["mean"] > 1 and r["max"] == 20 and r["p95"] > 1
    assert r["sd"] == pytest.approx(statistics.stdev([1, 1, 1, 1, 20]))
    none = summarise(spark.createDataFrame([], "v long"), "v").first()
    assert none["n"] == 0 and none["median"] == 0


@pytest.mark.parametrize("values", [[7], [5] * 40, [10**12 + i * 13 for i in range(300)], [(i * i * 7919) % 100_003 for i in range(2500)] + [None], [0, 0, 1, 4095, 4096, 4097, 8191, 8192, 10**15]])
def test_summaries_against_plain_ones(spark, values):
    from flowloom.functions.quantiles import CUTS, running, summaries

    df = spark.createDataFrame([(k, v) for v in values for k in ("a", "b")] + [("c", None)], "k string, v long").repartition(3)
    got, known = {r["k"]: r for r in summaries(df, "v", ["k"]).collect()}, sorted(v for v in values if v is not None)
    assert set(got) == {"a", "b"}
    for r in got.values():
        assert (r["n"], r["min"], r["max"]) == (len(known), known[0], known[-1])
        assert r["mean"] == pytest.approx(statistics.mean(known), rel=1e-12)
        if len(known) > 1:
            assert r["sd"] == pytest.approx(statistics.stdev(known), rel=1e-5)
        for name, p in CUTS.items():
            at = (len(known) - 1) * p
            low, part = int(at), at - int(at)
            assert r[name] == pytest.approx(known[low] * (1 - part) + known[min(low + 1, len(known) - 1)] * part, rel=1e-12)
    upto = {r["value"]: (r["upto"], r["of"]) for r in running(df.where("k = 'a'"), "v", ["k"]).collect()}
    assert upto == {v: (sum(w <= v for w in known), len(known)) for v in known}


def test_ranks_of_a_whole_table(spark):
    rows_ = [(f"id{i:04d}", i * 7919 % 5, i % 3) for i in range(900)]
    df = spark.createDataFrame(rows_, "id string, n long, w long").repartition(4)
    got = {r["id"]: (r["rank"], r["upto"], r["of"]) for r in ranking.ranked(df, F.struct((-F.col("n")).alias("n"), "id"), "w").collect()}
    upto, total = 0, sum(w for *_, w in rows_)
    for place, (i, _, w) in enumerate(sorted(rows_, key=lambda r: (-r[1], r[0])), 1):
        upto += w
        assert got[i] == (place, upto, total)
    assert ranking.ranked(df.limit(0), F.struct("n", "id"), "w").count() == 0


def test_whole_analysis(spark, make_log):
    log = make_log([(f"n-{i}", ["A", "B", "C"] if i % 4 else ["A", "C"], [1, 2]) for i in range(30)])
    a = analysis.analyse(spark, log)
    h, m = a.header.first(), a.metrics.first()
    assert (h["schema_version"], m["case_count"], m["event_count"]) == ("2.0", 30, 82)
    assert h["analysis_id"] == "analysis:" + stable_hash_of(f"{h['source_hash']}|2.0.0|30") and h["generated_at"].endswith("Z")
    assert analysis.analyse(spark, log.repartition(3), source_hash="0123456789abcdef").header.first()["source_hash"] == "0123456789abcdef"
    assert analysis.header(log.repartition(5)).first() == h
    assert (m["fitness"], m["deviation_rate"]) == (a.conformance.first()["fitness"], a.conformance.first()["deviation_rate"])
    assert a.quality.first()["completeness"] == 1 and {r["id"] for r in a.evidence.collect()} >= {"lead-time", "bottleneck", "variant-2"}
    with pytest.raises(ValueError, match="dois eventos"):
        analysis.analyse(spark, make_log([("A", ["x"], [])]))
    with pytest.raises(ValueError, match="casos"):
        analysis.analyse(spark, log.withColumn("activity", F.lit("")))


def test_snapshots_keep_their_bounds(spark, make_log):
    log = make_log([("A", ["x", "y", "z"], [1, 2]), ("B", ["x", "z"], [5])])
    a = analysis.analyse(spark, log)
    s = evidence.snapshot("analysis:1", "0123456789abcdef", a.evidence, a.edges, a.variants)
    assert (s.edges.count(), s.variants.count()) == (3, 2)
    with pytest.raises(ValueError, match="facts: rows"):
        evidence.snapshot("analysis:1", "0123456789abcdef", a.evidence.limit(0), a.edges, a.variants)
    with pytest.raises(ValueError, match="ids"):
        evidence.snapshot("analysis:1", "short", a.evidence, a.edges, a.variants)
    long = a.evidence.withColumn("label", F.repeat(F.lit("x"), 181))
    assert [(r["fault"], r["n"]) for r in evidence.snapshot_faults(evidence.Snapshot("a", "0123456789", long)).collect()] == [("facts: values", long.count())]
    old = evidence.legacy_snapshot(a.evidence.withColumn("kind", F.lit(None).cast("string")))
    assert {r["kind"] for r in old.facts.collect()} == {"metric"} and old.edges is None


def test_bottleneck_and_heat(make_log):
    log = make_log([(f"C{i}", ["Create", "Approve", "Pay"], [1, 8 + i]) for i in range(5)])
    edges = profile.edge_stats(traces.steps(log))
    top = profile.bottlenecks(edges, 1).first()
    assert (top["from_activity"], top["to_activity"], top["median"]) == ("Approve", "Pay", 10) and top["p90"] > top["median"]
    hot = {r["from_activity"] for r in profile.edge_heat(edges).where("is_hot").collect()}
    assert hot == {"Approve"}


def test_whole_cases_are_filtered(make_log):
    log = make_log([("A", ["x", "y"], [1]), ("B", ["y", "z"], [1])])
    assert {r["case_id"] for r in profile.filter_cases(log, "x-owner").collect()} == {"A"}
    assert profile.filter_cases(log, "x-owner").count() == 2
    assert profile.filter_cases(log, "nobody").count() == 4


def test_cleaning_and_report(spark):
    raw = spark.createDataFrame(
        [(0, "c1", "a", "2026-01-02", "r", "complete"), (1, "c1", "a", "2026-01-02", "r", "start"), (2, "c1", "b", "2026-01-01", "", None), (3, "", "b", "2026-01-01", "r", None), (4, "c2", "b", "gestern", "r", None), (5, "c2", "z", "2026-01-05", "r", "x")],
        RAW,
    )
    found = {r["code"]: (r["n"], r["sample_case_ids"]) for r in quality.issues(raw).collect()}
    assert found == {
        "missing_required_value": (1, ["desconhecido"]), "invalid_timestamp": (1, ["c2"]), "duplicate_event": (1, ["c1"]),
        "out_of_order_event": (1, ["c1"]), "single_event_case": (1, ["c2"]), "missing_resource": (1, ["c1"]),
    }
    r = quality.report(raw).first()
    assert (r["input_rows"], r["accepted_events"], r["rejected_rows"], r["case_count"], r["is_usable"]) == (6, 3, 2, 2, True)
    assert r["completeness"] == pytest.approx(12 / 18)


@pytest.mark.parametrize(
    "paths, expected",
    [
        ([["Create", "Approve", "Pay"]] * 3, "sequence"),
        ([["a"], ["b", "c"]], "xor"),
        ([["a", "b"], ["b", "a"]], "parallel"),
        ([["a", "a"]], "loop"),
        ([["a"]], "activity"),
    ],
)
def test_tree_roots(make_log, paths, expected):
    log = make_log([(f"C{i}", p, []) for i, p in enumerate(paths)])
    root, fallbacks = model.tree(model.variants_in_order(traces.traces(log)))
    assert root["operator"] == expected and fallbacks == 0


def test_tree_with_a_choice_inside_and_fallback(make_log):
    log = make_log([("A", ["Create", "Manual", "Pay"], []), ("B", ["Create", "Automatic", "Pay"], [])])
    root, _ = model.tree(model.variants_in_order(traces.traces(log)))
    assert [c["operator"] for c in root["children"]] == ["activity", "xor", "activity"]
    log = make_log([("A", ["a", "b", "c", "a"], []), ("B", ["c", "b"], [])])
    root, fallbacks = model.tree(model.variants_in_order(traces.traces(log)))
    assert root["operator"] == "xor" and fallbacks == 1 and len(root["children"]) == 2
    one = model.model(log.sparkSession, traces.traces(log)).first()
    assert json.loads(one["process_tree"]) == root and one["total_edges"] == 4


def dp_cost(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[j - 1]))
        row = new
    return row[-1]


def test_alignment_cost_and_moves():
    import random

    random.seed(4)
    for _ in range(300):
        a, b = ([random.choice("abcd") for _ in range(random.randint(1, 12))] for _ in range(2))
        cost = dp_cost(a, b)
        assert len(a) + len(b) - 2 * conformance.lcs_length(conformance.bit_masks(a), len(a), b) == cost
        moves = conformance.align(a, b)
        assert sum(m[3] for m in moves) == cost
        assert [m[1] for m in moves if m[1]] == a and [m[2] for m in moves if m[2]] == b


def test_deviation_is_found_in_the_holdout(make_log):
    held = next(f"case-{i}" for i in range(100) if int(stable_hash_of(f"case-{i}")[:8], 16) % 5 == 0)
    normal = [f"n-{i}" for i in range(60) if int(stable_hash_of(f"n-{i}")[:8], 16) % 5][:16]
    log = make_log([(c, ["A", "B", "C"], []) for c in normal] + [(held, ["A", "X", "C"], [])])
    cases = traces.split(traces.traces(log))
    got = conformance.alignments(cases).first()
    assert got["case_id"] == held and got["cost"] == 2 and got["is_deviation"]
    assert any(m["kind"] != "sync" for m in got["moves"])
    s = conformance.summary(cases).first()
    assert (s["train_cases"], s["validation_cases"], s["deviating_cases"]) == (16, 1, 1) and s["fitness"] == pytest.approx(4 / 6)


def test_split_has_both_sides(make_log):
    log = make_log([(f"n-{i}", ["A", "B"], []) for i in range(60) if int(stable_hash_of(f"n-{i}")[:8], 16) % 5][:10])
    sides = dict(rows(traces.split(traces.traces(log)).groupBy("is_validation").count()))
    assert sides == {False: 8, True: 2}
    assert rows(log.sparkSession.range(1).select(hash_half(F.lit("n-1"), 0))) == [(int(stable_hash_of("n-1")[:8], 16),)]


def calibrated(make_log, n=6):
    return make_log([(f"case-{i}", ["Create", "Approve", "Pay"], [0.8 + 0.05 * (i % 5), 1]) for i in range(n)])


def test_fits_of_events_and_of_summaries(spark, make_log):
    log = calibrated(make_log, 8)
    s, t = traces.steps(log), traces.traces(log)
    fits = {r["key"].replace("\u001f", ">"): r for r in waits.fits(waits.wait_samples(s)).collect()}
    assert fits["Approve>Pay"]["family"] == "constant" and fits["Create>Approve"]["family"] in ("lognormal", "exponential")
    told = waits.fits(waits.summary_samples(profile.edge_stats(s), profile.activity_stats(s)))
    by = {r["key"].replace("\u001f", ">"): r for r in told.collect()}
    assert by["Create>Approve"]["sample_count"] == 4 and by["Pay>*"]["parameter_1"] == 0.25
    assert t.count() == 8


def test_tools(spark, make_log):
    log = make_log([("A", ["x", "y", "z"], [1, 2]), ("B", ["x", "z"], [5])])
    edges = evidence.snapshot_edges(profile.edge_stats(traces.steps(log)))
    top = evidence.rank_bottlenecks(edges, 1).first()
    assert top["label"] == "x → z" and top["value"] == "mediana 5 dias" and len(top["id"]) <= 40
    with pytest.raises(ValueError):
        evidence.inspect_transition(edges, "edge:none")
    variants = evidence.snapshot_variants(profile.variant_stats(traces.traces(log)))
    a, b = (r["variant_id"] for r in variants.collect())
    assert evidence.compare_variants(variants, a, b).count() == 2
    with pytest.raises(ValueError):
        evidence.compare_variants(variants, a, a)


def test_facts_merge_keeps_place_and_takes_the_last_value(spark):
    part = lambda v: spark.createDataFrame([("a", "metric", "l", v, "d", "p")], "id string, kind string, label string, value string, detail string, source_path string")
    assert [r["value"] for r in evidence.merged_facts([part("1"), part("2")]).collect()] == ["2"]


def test_map_search_and_ids(make_log):
    log = make_log([("A", ["x", "y"], []), ("B", ["x", "y"], []), ("C", ["x", "q"], [])])
    v = profile.variant_stats(traces.traces(log))
    shown = rows(profile.flow_map(profile.edge_stats(traces.steps(log)), v))
    assert shown == [("x", "y", 2, 1, 2)]
    assert [r["path"] for r in profile.search_variants(v, "X Q").collect()] == [["x", "q"]]
    assert rows(v.sparkSession.range(1).select(text_id("edge", F.lit("x"), F.lit("y")))) == [("edge:" + stable_hash_of("x\u001fy"),)]


def test_headers_know_the_order_of_events(make_log):
    log = make_log([("A", ["x", "y"], []), ("B", ["x", "z", "y"], [])])
    told = lambda df: analysis.header(df).first()["source_hash"]
    swapped = log.withColumn("seq", F.when(F.col("seq") == 1, 2).when(F.col("seq") == 2, 1).otherwise(F.col("seq")).cast("long"))
    assert told(log) != told(swapped)
    # gaps in the numbers and the layout of the table mean nothing
    assert told(log) == told(log.withColumn("seq", F.col("seq") * 1000 + 7).repartition(3)) == told(log.coalesce(1))
