"""Tables of model responses: tool calls answered from a snapshot, and claims that pass the evidence gate.

Both take one row for each call or response and judge all of them in one plan. JSON is judged strictly (functions/strict_json):
a field too many or too few, another type or a text out of bounds refuses a call, and a whole response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.strict_json import fields, has_exactly, items, parsed, string, whole
from flowloom.operators import evidence
from flowloom.operators.evidence import ALL_REJECTED, FACT, ILL_FORMED, MAX_CLAIMS, MAX_FACTS, MAX_TOOL_CALLS

# Messages that results must show as they are.
NO_TEXT = "A resposta do modelo não continha texto estruturado."
NO_JSON = "A resposta do modelo não passou pelo parser estruturado."
NO_ARGUMENTS = "Argumentos da ferramenta não são JSON válido."
NO_EDGE = "Transição fora do escopo autorizado."
NO_VARIANT = "Variante fora do escopo autorizado."
SAME_VARIANT = "A comparação exige duas variantes distintas."
INSPECT, COMPARE, RANK = "inspect_transition_distribution", "compare_variants", "rank_bottlenecks"
MAX_RESPONSE, MAX_RANK = 8, 5


# ---- claims


def _claim(value: Column) -> Column:
    """A claim as text, citations, type; null if it breaks its form."""
    f = fields(value)
    cited = F.transform(items(f["citations"]), lambda c: string(c, 1, 40))
    text, kind = string(f["text"], 12, 360), string(f["type"], 1, 20)
    sound = has_exactly(f, "text", "citations", "type") & text.isNotNull() & kind.isin("observacao", "hipotese") & F.size(cited).between(1, 4) & ~F.exists(cited, lambda c: c.isNull())
    return F.when(sound, F.struct(text.alias("text"), cited.alias("citations"), kind.alias("type")))


def claims(body: Column) -> Column:
    """The claims of a parsed response, an array of text, citations, type; null if it breaks its form anywhere."""
    f = fields(body)
    told = F.transform(items(f["claims"]), _claim)
    return F.when(has_exactly(f, "claims") & (F.size(told) <= MAX_RESPONSE) & ~F.exists(told, lambda c: c.isNull()), told)


def gated(responses: DataFrame, body: str, facts: str) -> DataFrame:
    """responses with claims (the first four that nothing speaks against), rejected and message.

    body: the response as text; facts: the ids that it may cite, an array. A null or empty text, one that is no JSON and one
    that breaks the form anywhere is rejected as a whole, and counts as one rejection.
    """
    out = responses.withColumn("_value", parsed(F.col(body))).withColumn("_told", claims(F.col("_value")))
    ids = F.coalesce(F.col(facts), F.array().cast("array<string>"))
    fine = F.filter("_told", lambda c: (F.size(F.array_except(c["citations"], ids)) == 0) & (F.size(F.array_distinct(c["citations"])) == F.size(c["citations"])) & ~evidence.has_number(c["text"]))
    out = out.withColumn("_fine", fine)
    none = F.array().cast(out.schema["_told"].dataType)
    reason = (
        F.when(F.coalesce(F.col(body), F.lit("")) == "", NO_TEXT).when(F.col("_value").isNull(), NO_JSON).when(F.col("_told").isNull(), ILL_FORMED)
        .when(F.size("_fine") == 0, ALL_REJECTED)
    )
    return out.select(
        *responses.columns, F.coalesce(F.slice("_fine", 1, MAX_CLAIMS), none).alias("claims"),
        F.coalesce(F.size("_told") - F.size("_fine"), F.lit(1)).cast("long").alias("rejected"), reason.alias("message"),
    )


# ---- tool calls


def _judged(calls: DataFrame) -> DataFrame:
    """calls with edge_id, left_id, right_id, top and reason: what the tool is given, or why it is not run."""
    value = parsed(F.col("arguments"))
    f = F.col("_f")
    out = calls.withColumn("_value", value).withColumn("_f", fields(F.col("_value")))
    text = lambda tool, key, *all_: F.when((F.col("name") == tool) & has_exactly(f, *(all_ or (key,))), string(f[key], 1, 80))
    out = out.select(
        *calls.columns, "_value", text(INSPECT, "edgeId").alias("edge_id"), text(COMPARE, "leftId", "leftId", "rightId").alias("left_id"), text(COMPARE, "rightId", "leftId", "rightId").alias("right_id"),
        F.when((F.col("name") == RANK) & has_exactly(f, "limit"), whole(f["limit"], 1, MAX_RANK)).alias("top"),
    )
    given = F.col("edge_id").isNotNull() | F.col("top").isNotNull() | (F.col("left_id").isNotNull() & F.col("right_id").isNotNull())
    unfit = F.concat(F.coalesce("name", F.lit("?")), F.lit(" does not take these arguments"))
    return out.withColumn("reason", F.when(F.col("_value").isNull(), NO_ARGUMENTS).when(~given, unfit).when(F.col("left_id") == F.col("right_id"), SAME_VARIANT)).drop("_value")


def answered(calls: DataFrame, edges: DataFrame, variants: DataFrame) -> DataFrame:
    """The audit of all calls that are run: response, sequence, tool, status, reason, facts (an array, in order).

    calls: response, place, name, arguments (JSON text). Of each response the first three calls by place are run; what comes
    after them is not, and has no row. edges: edge_id and the columns of edge_facts; variants: variant_id and those of
    compare_variants. A call that breaks its form or asks for what is not there is refused with a reason and has no facts.
    """
    order = Window.partitionBy("response").orderBy("place", "name", "arguments")
    run = calls.select("response", "place", "name", "arguments").withColumn("sequence", F.row_number().over(order)).where(F.col("sequence") <= MAX_TOOL_CALLS)
    run = _judged(run)
    fact = F.struct(*FACT).alias("fact")
    by_edge = evidence.edge_facts(edges.withColumn("_id", F.col("edge_id")), "_id").select(F.col("_id").alias("edge_id"), fact)
    sided = lambda side: evidence.variant_facts(variants.withColumn("_id", F.col("variant_id")), side, "_id").select(F.col("_id").alias(f"{side}_id"), F.struct(*FACT).alias(f"{side}_fact"))
    # five rows, so they may go to every task
    first = evidence.edge_facts(edges.orderBy(F.desc("median"), F.desc("n"), "edge_id").limit(MAX_RANK), "median", "n", "edge_id")
    slowest = first.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("median")).alias("a"), (-F.col("n")).alias("b"), "edge_id", fact))), lambda x: x["fact"]).alias("slowest"))
    out = run.join(by_edge, "edge_id", "left").join(sided("left"), "left_id", "left").join(sided("right"), "right_id", "left")
    out = out.crossJoin(F.broadcast(slowest))
    missing = F.when(F.col("edge_id").isNotNull() & F.col("fact").isNull(), NO_EDGE).when(F.col("left_id").isNotNull() & (F.col("left_fact").isNull() | F.col("right_fact").isNull()), NO_VARIANT)
    out = out.withColumn("reason", F.coalesce("reason", missing))
    told = (
        F.when(F.col("edge_id").isNotNull(), F.array("fact")).when(F.col("left_id").isNotNull(), F.array("left_fact", "right_fact"))
        .when(F.col("top").isNotNull(), F.slice("slowest", F.lit(1), F.col("top")))
    )
    nothing = F.array().cast("array<struct<%s>>" % ",".join(f"{n}:string" for n in FACT))
    return out.select(
        "response", F.col("sequence").cast("long").alias("sequence"), F.col("name").alias("tool"), F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "reason",
        F.when(F.col("reason").isNull(), told).otherwise(nothing).alias("facts"),
    )


def authorized(audit: DataFrame, facts: DataFrame) -> DataFrame:
    """response, facts: those of the snapshot and then those of the calls; an id keeps its first place and takes its last value; the first forty.

    facts: the snapshot's, the same for all responses, MAX_FACTS at most; in the order of their ids.
    """
    known = facts.select(F.struct(*FACT).alias("f")).agg(F.slice(F.array_sort(F.collect_list("f")), 1, MAX_FACTS).alias("known"))
    by = audit.groupBy("response").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "facts"))), lambda x: x["facts"])).alias("told"))  # three calls at most
    both = by.crossJoin(F.broadcast(known)).withColumn("all", F.concat("known", "told"))
    ids = F.array_distinct(F.transform("all", lambda f: f["id"]))
    last = F.transform(F.slice(ids, 1, MAX_FACTS), lambda i: F.element_at(F.filter("all", lambda f: f["id"] == i), -1))
    return both.select("response", last.alias("facts"))
