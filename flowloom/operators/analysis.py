"""The analysis of a log in one call: every statistic, the model, conformance and evidence, as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.hashing import hash_half, text_id
from flowloom.operators import conformance, evidence, model, profile
from flowloom.operators import traces as base
from flowloom.operators.ranking import ranked
from flowloom.sources.scratch import written

# Versions and refusals.
SCHEMA_VERSION, MODEL_VERSION = "2.0", "2.0.0"
TOO_FEW = "São necessários ao menos dois eventos para analisar o processo."
NO_CASES = "O log não contém casos válidos."


def default_quality(log: DataFrame) -> DataFrame:
    """The quality of a log that comes without a report: nothing rejected, usable with two events or more."""
    rows = base.valid(log).agg(F.count_distinct("case_id").alias("case_count")).crossJoin(log.agg(F.count("*").alias("input_rows")))
    return rows.select(
        "input_rows", F.col("input_rows").alias("accepted_events"), F.lit(0).cast("long").alias("rejected_rows"), "case_count", F.lit(1.0).alias("completeness"),
        F.lit(0).cast("long").alias("issue_types"), (F.col("input_rows") >= 2).alias("is_usable"),
    )


def header(log: DataFrame, source_hash: str | None = None) -> DataFrame:
    """One row: schema_version, analysis_id, source_hash, generated_at (time of the last event).

    Unless a hash of the source is given, it is made of the sums of the hashes of the events with their places in the order of
    input, so that tasks can share the work, and two events that change places change it.
    """
    log = ranked(log.select("seq", "case_id", "activity", "ts_ms", "resource"), F.struct("seq", "case_id", "activity", "ts_ms", "resource"), "seq")
    line = F.concat_ws("|", "rank", "case_id", "activity", "ts_ms", "resource")
    half = lambda i: F.lower(F.lpad(F.hex(F.pmod(F.sum(hash_half(line, i)), F.lit(1 << 32))), 8, "0"))
    told = log.agg(F.concat(half(0), half(1)).alias("own"), F.max("ts_ms").alias("last"))
    cases = base.valid(log).agg(F.count_distinct("case_id").alias("cases"))
    used = F.col("own") if source_hash is None else F.lit(source_hash)
    named = told.crossJoin(cases).withColumn("source_hash", used)
    key = F.concat_ws("|", "source_hash", F.lit(MODEL_VERSION), F.col("cases").cast("string"))
    return named.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), text_id("analysis", key).alias("analysis_id"), "source_hash",
        F.concat(F.date_format(F.timestamp_millis("last"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("generated_at"),
    )


class Analysis:
    """All parts of an analysis, each made when it is first asked for: some store tables, and what nobody reads takes no disk."""

    def __init__(self, spark: SparkSession, log: DataFrame, cases: DataFrame, quality: DataFrame | None, source_hash: str | None) -> None:
        self._spark, self._given, self._cases, self._quality, self._source_hash = spark, log, cases, quality, source_hash

    @cached_property
    def _log(self) -> DataFrame:
        """The log for the parts that read its events: stored, so that what makes it is done once."""
        return written(self._given.select("seq", "case_id", "activity", "ts_ms", "resource"), "log")

    @cached_property
    def header(self) -> DataFrame:
        return header(self._log, self._source_hash)

    @cached_property
    def metrics(self) -> DataFrame:
        return profile.metrics(self._given, self._cases, self.conformance)

    @cached_property
    def quality(self) -> DataFrame:
        return default_quality(self._log) if self._quality is None else self._quality

    @cached_property
    def activities(self) -> DataFrame:
        return profile.activity_stats(base.steps(self._log))

    @cached_property
    def edges(self) -> DataFrame:
        return profile.edge_stats(base.steps(self._log))

    @cached_property
    def variants(self) -> DataFrame:
        return profile.variant_stats(self._cases)

    @cached_property
    def trend(self) -> DataFrame:
        return profile.trend(self._cases)

    @cached_property
    def model(self) -> DataFrame:
        return model.model(self._spark, self._cases.where("not is_validation"))

    @cached_property
    def conformance(self) -> DataFrame:
        return conformance.summary(self._cases)

    @cached_property
    def evidence(self) -> DataFrame:
        return evidence.facts(self.metrics, self.edges, self.activities, self.variants, self.conformance, self.quality)


def analyse(spark: SparkSession, log: DataFrame, quality: DataFrame | None = None, source_hash: str | None = None, modulo: int = base.VALIDATION_MODULO) -> Analysis:
    """All parts of an analysis. quality: completeness, rejected_rows, issue_types; the default one if there is none."""
    if log.limit(2).count() < 2:
        raise ValueError(TOO_FEW)
    cases = base.stored(log, modulo)
    if cases.isEmpty():
        raise ValueError(NO_CASES)
    return Analysis(spark, log, cases, quality, source_hash)
