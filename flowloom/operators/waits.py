"""Waiting times: samples, fitted distributions, capacities and arrival rate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.quantiles import running
from flowloom.functions.stats import normal_cdf
from flowloom.schema import ONE_MINUTE_IN_DAYS, SEPARATOR

# Bounds and texts of fits.
FEW = "Amostra insuficiente para comparar famílias; distribuição constante usada."
WEAK = "A aderência é fraca (KS > 0,20); valide com mais dados."
ANY, MINUTE_MS, UNKNOWN_WAIT = "*", 60_000, 0.25


def wait_samples(steps: DataFrame) -> DataFrame:
    """key, value, ms: each wait (a minute at least) in days and milliseconds, under its transition and under its activity alone."""
    moves = steps.where("next_activity is not null").withColumn("ms", F.greatest(F.lit(MINUTE_MS), F.col("next_ts_ms") - F.col("ts_ms")).cast("long")).withColumn("value", F.col("ms") / F.lit(86_400_000.0))
    keys = F.explode(F.array(F.concat_ws(SEPARATOR, "activity", "next_activity"), F.concat_ws(SEPARATOR, "activity", F.lit(ANY))))
    return moves.select(keys.alias("key"), "value", "ms")


def summary_samples(edges: DataFrame, activities: DataFrame) -> DataFrame:
    """Samples where raw events are missing: four quantiles of each transition's waits, and the median of each activity's.

    Quantiles of zero do not count; an activity without a median waits a quarter of a day.
    """
    told = F.filter(F.array("p25", "median", "p75", "p90"), lambda x: x > 0)
    of_edges = edges.select(F.concat_ws(SEPARATOR, "from_activity", "to_activity").alias("key"), F.explode(told).alias("value"))
    median = F.when(F.col("wait_median") > 0, F.col("wait_median")).otherwise(UNKNOWN_WAIT)
    of_activities = activities.select(F.concat_ws(SEPARATOR, "activity", F.lit(ANY)).alias("key"), median.alias("value"))
    return of_edges.unionByName(of_activities).withColumn("ms", F.round(F.col("value") * 86_400_000).cast("long"))


def sufficient(samples: DataFrame) -> DataFrame:
    """By key: n, mean, mean and deviation of logarithms, number of distinct values at eight decimals."""
    log = F.ln("value")
    return samples.where("value > 0").groupBy("key").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum(log).alias("sum_log"), F.avg(log).alias("mu"), F.coalesce(F.stddev_samp(log), F.lit(0.0)).alias("sd_log"),
        F.min(F.round("value", 8)).alias("lo"), F.max(F.round("value", 8)).alias("hi"),
    )


def ks_statistics(samples: DataFrame, facts: DataFrame) -> DataFrame:
    """By key, the largest distance of the empirical distribution from the fitted exponential and lognormal one.

    Equal values are merged and ranked within buckets of near values, so no key meets in one task.
    """
    values = running(samples, "ms", ["key"]).withColumn("value", F.col("value") / F.lit(86_400_000.0))
    x = values.join(F.broadcast(facts.select("key", "n", "mean", "mu", "sigma")), "key")
    steps_ = [(F.col("upto") - F.col("times")) / F.col("n"), (F.col("upto") - 1) / F.col("n"), (F.col("upto") - F.col("times") + 1) / F.col("n"), F.col("upto") / F.col("n")]
    far = lambda cdf: F.max(F.greatest(*(F.abs(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cdf)) - s) for s in steps_)))
    exponential = 1 - F.exp(-F.col("value") / F.col("mean"))
    lognormal = normal_cdf((F.ln("value") - F.col("mu")) / F.col("sigma"))
    return x.groupBy("key").agg(far(exponential).alias("ks_exponential"), far(lognormal).alias("ks_lognormal"))


def fits(samples: DataFrame) -> DataFrame:
    """By key: family with the lower BIC, its parameters, KS statistic and BIC; constant where there is too little to tell."""
    c = F.col
    facts = sufficient(samples).withColumn("sigma", F.greatest(F.lit(1e-6), c("sd_log"))).withColumn("mean", F.greatest(F.lit(1e-9), c("mean")))
    exp_ll = c("n") * F.ln(1 / c("mean")) - c("n")
    log_ll = -c("sum_log") - c("n") * F.ln(c("sigma") * math.sqrt(2 * math.pi)) - (c("n") - 1) * c("sd_log") ** 2 / (2 * c("sigma") ** 2)
    facts = facts.withColumn("bic_e", F.ln("n") - 2 * exp_ll).withColumn("bic_l", 2 * F.ln("n") - 2 * log_ll)
    family = F.when((c("n") < 4) | (c("lo") == c("hi")), "constant").when(c("bic_l") <= c("bic_e"), "lognormal").otherwise("exponential")
    both = facts.join(ks_statistics(samples, facts), "key").withColumn("family", family)
    pick = lambda constant, exponential, lognormal: F.when(c("family") == "constant", constant).when(c("family") == "exponential", exponential).otherwise(lognormal)
    told = both.select(
        "key", "family", c("n").alias("sample_count"), pick(F.greatest(F.lit(ONE_MINUTE_IN_DAYS), c("mean")), c("mean"), c("mu")).alias("parameter_1"),
        pick(F.lit(None), F.lit(None), c("sigma")).alias("parameter_2"), pick(F.lit(0.0), c("ks_exponential"), c("ks_lognormal")).alias("ks"), pick(F.lit(0.0), c("bic_e"), c("bic_l")).alias("bic"),
    )
    return told.withColumn("warning", F.when(c("family") == "constant", FEW).when(c("ks") > 0.2, WEAK))


def capacities(activities: DataFrame, resource_loss: bool = False) -> DataFrame:
    """Servers of each activity: its resources, one at least; one less at the longest median wait if a resource is lost."""
    own = activities.select("activity", "events", "wait_median", F.greatest(F.lit(1), F.size("resources")).alias("capacity"))
    if not resource_loss:
        return own.select("activity", "capacity")
    slowest = own.orderBy(F.desc("wait_median"), F.desc("events"), "activity").limit(1).select(F.col("activity").alias("slowest"))
    less = F.when(F.col("activity") == F.col("slowest"), F.greatest(F.lit(1), F.col("capacity") - 1)).otherwise(F.col("capacity"))
    return own.crossJoin(F.broadcast(slowest)).select("activity", less.alias("capacity"))


def arrival_rate(traces: DataFrame) -> DataFrame:
    """Cases a day between the first and the last start."""
    n, span = F.col("cases"), (F.col("last") - F.col("first")) / F.lit(86_400_000.0)
    rate = F.when(n < 2, F.greatest(F.lit(0.1), n / 90)).otherwise(n / F.greatest(F.lit(1.0), span))
    return traces.agg(F.count("*").alias("cases"), F.min("start_ms").alias("first"), F.max("start_ms").alias("last")).select("cases", rate.alias("arrival_rate"))
