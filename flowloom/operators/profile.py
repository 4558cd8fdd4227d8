"""Statistics of edges, activities, variants, months and the whole log, and rankings of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.hashing import text_id
from flowloom.functions.quantiles import summaries, summary_columns
from flowloom.operators.ranking import ranked
from flowloom.schema import DAY_MS, NO_RESOURCE
from flowloom.sources.scratch import written

_DAY = float(DAY_MS)


def edge_stats(steps: DataFrame) -> DataFrame:
    """By transition: count, cases, share of all transitions, and the waits' distribution."""
    moves = steps.where("next_activity is not null").select("case_id", "wait_ms", F.col("activity").alias("from_activity"), F.col("next_activity").alias("to_activity"))
    keys = ["from_activity", "to_activity"]
    cases = moves.groupBy(*keys).agg(F.count_distinct("case_id").alias("case_count"))
    by = summaries(moves, "wait_ms", keys, _DAY).join(cases, keys)
    total = by.agg(F.sum("n").alias("total"))  # of one row for each pair of activities
    return by.crossJoin(F.broadcast(total)).select(*keys, "case_count", (F.col("n") / F.greatest("total", F.lit(1))).alias("frequency"), *summary_columns())


def activity_stats(steps: DataFrame) -> DataFrame:
    """By activity: events, cases, resources, and the distribution of waits to the next event."""
    named = F.array_sort(F.collect_set(F.when(F.col("resource") != NO_RESOURCE, F.col("resource"))))
    by = steps.groupBy("activity").agg(F.count("*").alias("events"), F.count_distinct("case_id").alias("case_count"), named.alias("resources"))
    return by.join(summaries(steps, "wait_ms", ["activity"], _DAY), "activity", "left").select("activity", "events", "case_count", "resources", *summary_columns("wait_"))


def variant_stats(traces: DataFrame) -> DataFrame:
    """By exact path: count, share, the lead times' distribution, and its median against that of all cases."""
    traces = written(traces.select("path_key", "lead_ms"), "leads")  # read for the variants and for all cases
    by = summaries(traces, "lead_ms", ["path_key"], _DAY)
    paths = F.split("path_key", "\u001f")
    all_ = summaries(traces, "lead_ms", [], _DAY, {"overall": 0.5}).select(F.col("n").alias("total"), "overall")
    out = by.select("path_key", paths.alias("path"), F.col("n").alias("cases"), *summary_columns("lead_"))
    return out.crossJoin(F.broadcast(all_)).withColumn("n", F.col("cases")).withColumn("share", F.col("n") / F.col("total")).withColumn("impact", F.col("lead_median") - F.col("overall")).drop("total", "overall", "cases")


def trend(traces: DataFrame) -> DataFrame:
    """By month (UTC) of the last event: cases and median lead time."""
    month = F.date_format(F.timestamp_millis("end_ms"), "yyyy-MM")
    return summaries(traces.withColumn("month", month), "lead_ms", ["month"], _DAY, {"median_lead_days": 0.5}).select("month", F.col("n").alias("cases"), "median_lead_days")


def metrics(log: DataFrame, traces: DataFrame, conformance: DataFrame | None = None) -> DataFrame:
    """One row for the whole log. event_count counts all input events. With the conformance summary: deviation_rate, fitness, precision."""
    first_pass = F.avg((F.size(F.array_distinct("path")) == F.size("path")).cast("double"))
    counts = traces.agg(F.count("*").alias("case_count"), F.coalesce(first_pass, F.lit(0.0)).alias("first_pass_rate"), F.coalesce(F.sum(F.col("n_events") - 1), F.lit(0)).cast("long").alias("transition_count"))
    lead = summaries(traces, "lead_ms", [], _DAY, {"median": 0.5, "p90": 0.9}).select(F.col("mean").alias("avg"), "median", "p90")
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    whole = counts.join(F.broadcast(lead), F.lit(True), "left").select(
        "case_count", zero("avg", "avg_lead_days"), zero("median", "median_lead_days"), zero("p90", "p90_lead_days"), "first_pass_rate", "transition_count",
    )
    out = whole.crossJoin(log.agg(F.count("*").alias("event_count")))
    return out if conformance is None else out.crossJoin(conformance.select("deviation_rate", "fitness", "precision"))


def start_end(traces: DataFrame) -> DataFrame:
    """Distinct first and last activities."""
    ends = F.explode(F.array(F.struct(F.lit("start").alias("kind"), F.col("path")[0].alias("activity")), F.struct(F.lit("end").alias("kind"), F.element_at("path", -1).alias("activity"))))
    return traces.select(ends.alias("e")).select("e.kind", "e.activity").distinct()


def follows(traces: DataFrame) -> DataFrame:
    """Directly-follows pairs of paths with their counts."""
    pairs = F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b")))
    both = traces.where(F.size("path") > 1).select(pairs.alias("p"))
    return both.groupBy(F.col("p.a").alias("from_activity"), F.col("p.b").alias("to_activity")).agg(F.count("*").alias("n"))


def retained_edges(traces: DataFrame, least_share: float = 0.01) -> DataFrame:
    """Pairs with whether they occur in at least one in a hundred traces, and once."""
    bound = traces.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * least_share)).alias("bound"))
    return follows(traces).crossJoin(F.broadcast(bound)).select("from_activity", "to_activity", "n", (F.col("n") >= F.col("bound")).alias("retained"))


def bottlenecks(edges: DataFrame, limit: int) -> DataFrame:
    """The transitions with the longest median waits; ties by count, then by id."""
    named = edges.withColumn("edge_id", text_id("edge", F.col("from_activity"), F.col("to_activity")))
    return named.orderBy(F.desc("median"), F.desc("n"), "edge_id").limit(limit)


def variant_order(variants: DataFrame) -> list:
    return [F.desc("n"), F.desc("impact"), text_id("variant", F.col("path_key"))]


def edge_heat(edges: DataFrame, share: float = 0.7) -> DataFrame:
    """Transitions with is_hot: a median of at least the value at place floor(share * n) of the sorted medians."""
    sorted_ = edges.agg(F.array_sort(F.collect_list("median")).alias("m"))  # one value for each pair of activities
    place = F.least(F.size("m"), F.floor(F.size("m") * share) + 1).cast("int")
    return edges.crossJoin(F.broadcast(sorted_.select(F.element_at("m", place).alias("bound")))).withColumn("is_hot", F.col("median") >= F.col("bound")).drop("bound")


def edges_of(edges: DataFrame, activity: str, limit: int = 3) -> DataFrame:
    """The commonest transitions from or to an activity."""
    touching = edges.where((F.col("from_activity") == activity) | (F.col("to_activity") == activity))
    return touching.orderBy(F.desc("n"), text_id("edge", F.col("from_activity"), F.col("to_activity"))).limit(limit)


def flow_map(edges: DataFrame, variants: DataFrame, limit: int = 26) -> DataFrame:
    """The commonest transitions between activities of the top variant, with the activities' stages along it."""
    top = variants.orderBy(*variant_order(variants)).limit(1).select(F.array_distinct("path").alias("stages"))
    shown = edges.crossJoin(F.broadcast(top)).where(F.array_contains("stages", F.col("from_activity")) & F.array_contains("stages", F.col("to_activity")))
    stage = lambda c: F.array_position(F.col("stages"), F.col(c)).cast("int")
    out = shown.select("from_activity", "to_activity", "n", stage("from_activity").alias("from_stage"), stage("to_activity").alias("to_stage"))
    return out.orderBy(F.desc("n"), text_id("edge", F.col("from_activity"), F.col("to_activity"))).limit(limit)


def filter_cases(log: DataFrame, resource: str | None = None, last_days: int | None = None) -> DataFrame:
    """All events of the cases with an event that has the resource and lies in the last days; everything if these are less than two."""
    end = log.agg(F.max("ts_ms").alias("end"))
    test = F.lit(True) if resource is None else F.col("resource") == resource
    if last_days is not None:
        test &= F.col("ts_ms") >= F.col("end") - last_days * 86_400_000
    cases = log.crossJoin(F.broadcast(end)).where(test).select("case_id").distinct()
    shown = log.join(cases, "case_id", "left_semi")
    return shown if shown.limit(2).count() == 2 else log


def search_variants(variants: DataFrame, text: str) -> DataFrame:
    """Variants whose path or id holds the text, in any case."""
    body = F.concat_ws(" ", F.array_join("path", " "), text_id("variant", F.col("path_key")))
    return variants.where(F.lower(body).contains(text.lower()))


def resources(log: DataFrame) -> DataFrame:
    return log.where("resource <> ''").select("resource").distinct()


def case_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("case_id").alias("cases"))


def variant_cdf(variants: DataFrame) -> DataFrame:
    """Variants in their order with the rank and the share up to each."""
    named = variants.withColumn("variant_id", text_id("variant", F.col("path_key")))
    out = ranked(named.select("variant_id", "n", "share", "impact"), F.struct(-F.col("n"), -F.col("impact"), F.col("variant_id")), "n")
    return out.select("variant_id", "n", "share", "rank", (F.col("upto") / F.col("of")).alias("upto"))


def variant_diversity(traces: DataFrame) -> DataFrame:
    """One row: how many distinct paths there are, and how many cases."""
    return traces.agg(F.count_distinct("path_key").alias("variants"), F.count("*").alias("cases"))
