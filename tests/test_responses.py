"""Responses and tool calls, judged strictly and all at once."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom.functions.strict_json import parsed, string, whole
from flowloom.operators import evidence, profile, responses, traces

FINE = {"text": "Talvez a fila explique a demora.", "citations": ["a"], "type": "hipotese"}
ILL = (0, 1, evidence.ILL_FORMED)


def judged(spark, bodies, facts=("a",)):
    df = spark.createDataFrame([(i, b, list(facts)) for i, b in enumerate(bodies)], "id int, body string, facts array<string>")
    out = responses.gated(df, "body", "facts").orderBy("id").collect()
    return [(len(r["claims"]), r["rejected"], r["message"]) for r in out]


@pytest.mark.parametrize(
    ("claims", "expected"),
    [
        ([FINE], (1, 0, None)), ([], (0, 0, evidence.ALL_REJECTED)), ([FINE] * 6, (4, 0, None)), ([FINE] * 8, (4, 0, None)), ([FINE] * 9, ILL), ([FINE, "text"], ILL), ([FINE, None], ILL),
        ([FINE | {"text": "Foram 3 casos na semana."}, FINE], (1, 1, None)), ([FINE | {"text": "O total é zero, ao que parece."}], (0, 1, evidence.ALL_REJECTED)),
        ([FINE | {"text": "curto"}], ILL), ([FINE | {"text": "x" * 360}], (1, 0, None)), ([FINE | {"text": "x" * 361}], ILL), ([FINE | {"text": "😀" * 180}], (1, 0, None)), ([FINE | {"text": "😀" * 181}], ILL), ([FINE | {"text": 123456789012}], ILL),
        ([FINE | {"type": "fato"}], ILL), ([FINE | {"type": None}], ILL), ([FINE | {"score": 1}], ILL), ([{k: v for k, v in FINE.items() if k != "type"}], ILL),
        ([FINE | {"citations": []}], ILL), ([FINE | {"citations": ["a"] * 5}], ILL), ([FINE | {"citations": "a"}], ILL), ([FINE | {"citations": [1]}], ILL), ([FINE | {"citations": [""]}], ILL), ([FINE | {"citations": ["a" * 41]}], ILL),
        ([FINE | {"citations": ["b"]}, FINE], (1, 1, None)), ([FINE | {"citations": ["a", "a"]}, FINE], (1, 1, None)), ([FINE | {"text": "Há um único caminho aqui."}], (0, 1, evidence.ALL_REJECTED)),
        ([FINE | {"text": "O émil não conta números."}], (0, 1, evidence.ALL_REJECTED)), ([FINE | {"text": "Família estável de tudo."}], (1, 0, None)),
    ],
)
def test_claims_of_a_response(spark, claims, expected):
    assert judged(spark, [json.dumps({"claims": claims})]) == [expected]


def test_whole_responses(spark):
    body = json.dumps({"claims": [FINE]})
    bad = [None, "", "{", body + "}", body + ",1", "[]", "1", json.dumps([FINE]), json.dumps({"claims": [FINE], "x": 1}), json.dumps({"claims": FINE}), "null", body, " " + body + "\n"]
    none, text = (0, 1, responses.NO_TEXT), (0, 1, responses.NO_JSON)
    assert judged(spark, bad) == [none, none, text, text, text, ILL, ILL, ILL, ILL, ILL, ILL, (1, 0, None), (1, 0, None)]
    assert judged(spark, []) == []
    assert judged(spark, [body], facts=()) == [(0, 1, evidence.ALL_REJECTED)]


def test_values_of_json(spark):
    df = spark.createDataFrame([(x,) for x in ("3", "3.0", "3e0", "3.5", '"3"', "true", "null", "9", '"abc"', '"abcd"', "3 3", None)], "j string")
    v = parsed(F.col("j"))
    assert [tuple(r) for r in df.select(whole(v, 1, 5), string(v, 1, 3)).collect()] == [(3, None), (3, None), (3, None), (None, None), (None, "3"), (None, None), (None, None), (None, None), (None, "abc"), (None, None), (None, None), (None, None)]


CALLS = "response string, place int, name string, arguments string"


@pytest.fixture(scope="module")
def snapshot(make_log):
    log = make_log([("A", ["x", "y", "z"], [1, 2]), ("B", ["x", "z"], [5])])
    return evidence.snapshot_edges(profile.edge_stats(traces.steps(log))), evidence.snapshot_variants(profile.variant_stats(traces.traces(log)))


def test_a_table_of_calls(spark, snapshot):
    edges, variants = snapshot
    top = evidence.rank_bottlenecks(edges, 5).collect()
    edge = edges.where("from_activity = 'y'").first()["edge_id"]
    a, b = (r["variant_id"] for r in variants.orderBy("variant_id").collect())
    rank, inspect, compare = responses.RANK, responses.INSPECT, responses.COMPARE
    calls = [
        ("one", 9, rank, '{"limit": 2}'), ("one", 3, inspect, json.dumps({"edgeId": edge})), ("one", 5, compare, json.dumps({"leftId": a, "rightId": b})), ("one", 10, rank, '{"limit": 1}'),
        ("two", 1, rank, '{"limit": 0}'), ("two", 2, rank, "{"), ("two", 3, inspect, '{"edgeId": "edge:none"}'),
        ("three", 1, compare, json.dumps({"leftId": a, "rightId": a})), ("three", 2, compare, json.dumps({"leftId": a, "rightId": "variant:none"})), ("three", 3, "sql", "{}"),
        ("four", 1, compare, json.dumps({"leftId": a})), ("four", 2, rank, '{"limit": 3.0}'), ("four", 3, rank, '{"limit": 3, "x": 1}'), ("five", 1, inspect, json.dumps({"edgeId": "x" * 81})), ("five", 2, None, None),
    ]
    audit = responses.answered(spark.createDataFrame(calls, CALLS).repartition(3), edges, variants)
    got = {(r["response"], r["sequence"]): r for r in audit.collect()}
    assert len(got) == 14 and {k[1] for k in got} == {1, 2, 3}
    ids = lambda k: [f["id"] for f in got[k]["facts"]]
    assert ids(("one", 1)) == [f"tool-{edge}"[:40]] and ids(("one", 2)) == [f"tool-left-{a}"[:40], f"tool-right-{b}"[:40]]
    assert got["one", 1]["facts"][0]["value"] == "mediana 2 dias"
    assert ids(("one", 3)) == [r["id"] for r in top[:2]] and ids(("four", 2)) == [r["id"] for r in top[:3]]
    why = {k: r["reason"] for k, r in got.items() if r["status"] == "rejected"}
    unfit = "{} does not take these arguments".format
    assert why == {
        ("two", 1): unfit(rank), ("two", 2): responses.NO_ARGUMENTS, ("two", 3): responses.NO_EDGE, ("three", 1): responses.SAME_VARIANT, ("three", 2): responses.NO_VARIANT, ("three", 3): unfit("sql"),
        ("four", 1): unfit(compare), ("four", 3): unfit(rank), ("five", 1): unfit(inspect), ("five", 2): responses.NO_ARGUMENTS,
    }
    assert all(r["facts"] == [] for k, r in got.items() if k in why)
    known = spark.createDataFrame([("lead-time", "metric", "l", "1", "d", "p"), (top[0]["id"], "metric", "l", "antes", "d", "p")], "id string, kind string, label string, value string, detail string, source_path string")
    facts = {r["response"]: {f["id"]: f["value"] for f in r["facts"]} for r in responses.authorized(audit, known).collect()}
    assert set(facts) == {"one", "two", "three", "four", "five"} and facts["two"] == {"lead-time": "1", top[0]["id"]: "antes"}
    assert facts["four"][top[0]["id"]] == top[0]["value"] and list(facts["four"])[:2] == ["lead-time", top[0]["id"]]


def test_no_calls_and_no_snapshot(spark, snapshot):
    edges, variants = snapshot
    assert responses.answered(spark.createDataFrame([], CALLS), edges, variants).collect() == []
    (r,) = responses.answered(spark.createDataFrame([("a", 1, responses.RANK, '{"limit": 2}')], CALLS), edges.limit(0), variants.limit(0)).collect()
    assert (r["status"], r["facts"]) == ("accepted", [])
