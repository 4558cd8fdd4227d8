"""Traces and directly-follows steps: the base of all further operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.hashing import hash_half
from flowloom.schema import DAY_MS, SEPARATOR
from flowloom.sources.scratch import written

VALIDATION_MODULO = 5


def valid(log: DataFrame) -> DataFrame:
    return log.where("case_id <> '' and activity <> '' and ts_ms is not null")


def steps(log: DataFrame) -> DataFrame:
    """Each event with the next one of its case, in the order of time and then of input."""
    order = Window.partitionBy("case_id").orderBy("ts_ms", "seq")
    out = valid(log).select("case_id", "seq", "activity", "resource", "ts_ms", F.lead("activity").over(order).alias("next_activity"), F.lead("ts_ms").over(order).alias("next_ts_ms"))
    gap = F.col("next_ts_ms") - F.col("ts_ms")
    # both null for the last event of a case
    return out.withColumn("wait_ms", F.when(gap < 0, 0).otherwise(gap)).withColumn("wait_days", F.col("wait_ms") / F.lit(float(DAY_MS)))


def edge_rollup(log: DataFrame) -> DataFrame:
    """As steps, but in the order of input alone."""
    order = Window.partitionBy("case_id").orderBy("seq")
    return log.select(
        "case_id", "seq", F.col("activity").alias("from_activity"), F.lead("activity").over(order).alias("to_activity"),
        F.col("ts_ms").alias("event_ms"), F.lead("ts_ms").over(order).alias("next_event_ms"),
    )


def traces(log: DataFrame) -> DataFrame:
    """One row for each case: its path, number of events, first and last time, lead time in milliseconds and in days."""
    return _told(_paths(log))


def _paths(log: DataFrame) -> DataFrame:
    """What a trace is made of: its case, path, first and last time."""
    ordered = F.array_sort(F.collect_list(F.struct("ts_ms", "seq", "activity")))
    cases = valid(log).groupBy("case_id").agg(ordered.alias("e"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    return cases.select("case_id", F.transform("e", lambda x: x["activity"]).alias("path"), "start_ms", "end_ms")


def _told(paths: DataFrame, *more: str) -> DataFrame:
    lead = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")).cast("long")
    told = paths.select("case_id", "path", F.size("path").alias("n_events"), "start_ms", "end_ms", lead.alias("lead_ms"), *more)
    return told.withColumn("lead_days", F.col("lead_ms") / F.lit(float(DAY_MS))).withColumn("path_key", F.array_join("path", SEPARATOR))


def split(cases: DataFrame, modulo: int = VALIDATION_MODULO) -> DataFrame:
    """Cases with is_validation, by the first half of the id's hash.

    Should one side be empty, the first four fifths of the cases in collated order train; a single case does both.
    """
    return _two_sides(cases.withColumn("is_validation", _bit(modulo)))


def stored(log: DataFrame, modulo: int = VALIDATION_MODULO) -> DataFrame:
    """split(traces(log)), read from the shared folder: the log is read once, and what follows from a stored column is not stored."""
    return _two_sides(_told(written(_paths(log).withColumn("is_validation", _bit(modulo)), "cases"), "is_validation"))


def _bit(modulo: int) -> Column:
    return hash_half(F.col("case_id"), 0) % max(3, modulo) == 0


def _two_sides(marked: DataFrame) -> DataFrame:
    sides = marked.agg(F.count("*").alias("n"), F.count_if("is_validation").alias("v")).first()
    if sides["v"] not in (0, sides["n"]):
        return marked
    # reached only where all hashes fall on one side, that is, with a handful of cases
    rank = F.row_number().over(Window.orderBy(F.collate("case_id", "UNICODE"), "case_id"))
    train, cases = max(1, int(0.8 * sides["n"])), marked.drop("is_validation")
    out = cases.withColumn("is_validation", rank > train)
    return out if sides["n"] > train else out.union(cases.withColumn("is_validation", F.lit(True)))
