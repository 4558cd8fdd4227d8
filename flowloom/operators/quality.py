"""Cleaning of raw rows and the data-quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.text import lifecycle_name, timestamp_ms, trim_all
from flowloom.schema import NO_CASE, NO_RESOURCE

# Codes, severities and messages of the report.
ISSUES = {
    "missing_required_value": ("error", "Linhas sem case_id ou atividade foram rejeitadas."),
    "invalid_timestamp": ("error", "Linhas com timestamp inválido foram rejeitadas."),
    "duplicate_event": ("warning", "Eventos duplicados foram removidos."),
    "out_of_order_event": ("warning", "Eventos fora de ordem foram reordenados por caso."),
    "single_event_case": ("warning", "Casos com um único evento não geram transições."),
    "missing_resource": ("warning", "Eventos sem recurso limitam a análise de capacidade."),
}
SAMPLES = 5


def tagged(raw: DataFrame) -> DataFrame:
    """raw (seq, case_id, activity, timestamp, resource, lifecycle: text) as events, with reject_reason.

    A row without case or activity is rejected for that before its timestamp is looked at.
    """
    resource = trim_all(F.col("resource"))
    nothing = F.lit(None).cast("map<string,string>")
    attributes = F.col("attributes") if "attributes" in raw.columns else nothing
    rows = raw.select(
        "seq", F.coalesce(trim_all(F.col("case_id")), F.lit("")).alias("case_id"), F.coalesce(trim_all(F.col("activity")), F.lit("")).alias("activity"), timestamp_ms(F.col("timestamp")).alias("ts_ms"),
        F.when(resource.isNull() | (resource == ""), NO_RESOURCE).otherwise(resource).alias("resource"), lifecycle_name(F.col("lifecycle")).alias("lifecycle"), attributes.alias("attributes"),
    )
    reason = F.when((F.col("case_id") == "") | (F.col("activity") == ""), "missing_required_value").when(F.col("ts_ms").isNull(), "invalid_timestamp")
    return rows.withColumn("reject_reason", reason)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reject_reason is null").drop("reject_reason")


def _numbered(events: DataFrame) -> DataFrame:
    key = Window.partitionBy("case_id", "activity", "ts_ms", "resource").orderBy("seq")
    return events.withColumn("_nth", F.row_number().over(key))


def deduplicated(events: DataFrame) -> DataFrame:
    """The first of events with the same case, activity, time and resource."""
    return _numbered(events).where("_nth = 1").drop("_nth")


def duplicates(events: DataFrame) -> DataFrame:
    return _numbered(events).where("_nth > 1").drop("_nth")


def out_of_order(events: DataFrame) -> DataFrame:
    """Events earlier than the one before them of their case, in the order of input after duplicates have gone."""
    before = F.lag("ts_ms").over(Window.partitionBy("case_id").orderBy("seq"))
    return events.withColumn("previous_ms", before).where("ts_ms < previous_ms")


def clean(raw: DataFrame) -> DataFrame:
    """The event log: accepted rows, each once. The order of time is left to the operators, which sort by ts_ms and seq."""
    return deduplicated(accepted(tagged(raw)))


def in_order(log: DataFrame) -> DataFrame:
    """The log in the order of time, then of collated case, then of input."""
    return log.orderBy("ts_ms", F.collate("case_id", "UNICODE"), "seq")


def findings(raw: DataFrame) -> DataFrame:
    """(code, case_id, at): one row for each fault, with what orders the faults of a code. One pass over two windows."""
    rows = tagged(raw)
    fine = F.col("reject_reason").isNull()
    # rows that are out are partitions of their own, so that blank cases do not meet
    alone = F.when(~fine, F.col("seq"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("case_id", "activity", "ts_ms", "resource", alone).orderBy("seq")))
    kept = fine & (F.col("_nth") == 1)
    case = Window.partitionBy("case_id", F.when(~kept, F.col("seq")))
    rows = rows.withColumn("_before", F.lag("ts_ms").over(case.orderBy("seq"))).withColumn("_size", F.count("*").over(case))
    first = F.struct(F.lit(0).cast("long").alias("ts_ms"), F.lit("").alias("case"), F.col("seq"))
    later = F.struct(F.col("ts_ms"), F.collate("case_id", "UNICODE").cast("string").alias("case"), F.col("seq"))
    found = lambda test, code, at: F.when(test, F.struct(code.alias("code"), at.alias("at")))
    faults = F.array_compact(F.array(
        found(~fine, F.col("reject_reason"), first), found(fine & (F.col("_nth") > 1), F.lit("duplicate_event"), first), found(kept & (F.col("ts_ms") < F.col("_before")), F.lit("out_of_order_event"), first),
        found(kept & (F.col("_size") == 1), F.lit("single_event_case"), later), found(kept & (F.col("resource") == NO_RESOURCE), F.lit("missing_resource"), later),
    ))
    name = F.when(F.col("case_id") == "", NO_CASE).otherwise(F.col("case_id"))
    return rows.select(name.alias("case_id"), F.explode(faults).alias("f")).select("f.code", "case_id", "f.at")


def issues(raw: DataFrame) -> DataFrame:
    """By code: severity, count, up to five case ids in the order met, message."""
    by_case = findings(raw).groupBy("code", "case_id").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    counts = by_case.groupBy("code").agg(F.sum("n").alias("n"))
    # Spark keeps five rows of a code in each task before it brings a code's rows together
    nth = F.row_number().over(Window.partitionBy("code").orderBy("at"))
    tops = by_case.select("code", "case_id", "at", nth.alias("nth")).where(F.col("nth") <= SAMPLES)
    samples = tops.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "case_id"))), lambda x: x["case_id"]).alias("sample_case_ids"))
    names = F.create_map(*(F.lit(x) for c, (s, _) in ISSUES.items() for x in (c, s)))
    texts = F.create_map(*(F.lit(x) for c, (_, m) in ISSUES.items() for x in (c, m)))
    return counts.join(samples, "code").select("code", names[F.col("code")].alias("severity"), "n", "sample_case_ids", texts[F.col("code")].alias("message"))


def report(raw: DataFrame) -> DataFrame:
    """One row: rows, events, rejects, cases, completeness of required cells, usability."""
    rows = tagged(raw)
    counted = rows.agg(
        F.count("*").alias("input_rows"), F.count("reject_reason").alias("rejected_rows"),
        F.count_if(F.col("reject_reason") == "missing_required_value").alias("_missing"), F.count_if(F.col("reject_reason") == "invalid_timestamp").alias("_invalid"),
    )
    log = deduplicated(accepted(rows)).agg(F.count("*").alias("accepted_events"), F.count_distinct("case_id").alias("case_count"))
    cells = F.greatest(F.lit(1), F.col("input_rows") * 3)
    all_wrong = (F.col("input_rows") > 0) & ((F.col("_missing") == F.col("input_rows")) | (F.col("_invalid") == F.col("input_rows")))
    return counted.crossJoin(log).select(
        "input_rows", "accepted_events", "rejected_rows", "case_count",
        F.greatest(F.lit(0.0), (cells - F.col("rejected_rows") * 3) / cells).alias("completeness"),
        ((F.col("accepted_events") >= 2) & (F.col("case_count") >= 1) & ~all_wrong).alias("is_usable"),
    )
