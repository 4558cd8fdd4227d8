"""Exact distribution summaries of large groups, by rank over counted values.

A built-in exact percentile holds all distinct values of a group in one task. Here, equal values (whole numbers) are
counted first; counts by coarse bucket tell which buckets hold the wanted ranks, and only those are ranked. A bucket spans
1/4096 of its values' magnitude, so neither the buckets of a group nor the values of a bucket grow without bound. Mean and
deviation come from sums within buckets, which lose no digits to large values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.sources.scratch import written

MANTISSA_BITS = 12
CUTS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
SUMMARY = ["n", "mean", "sd", "min", "p25", "median", "p75", "p90", "p95", "max", "iqr"]


def _wide(value: Column) -> Column:
    """How many low bits a bucket of this value leaves open."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int") - MANTISSA_BITS)


def bucket(value: Column) -> Column:
    """Buckets in the order of their values (zero or more): the highest bit's place and the bits after it."""
    wide = _wide(value)
    return wide.cast("long") * (1 << (MANTISSA_BITS + 2)) + F.call_function("shiftright", value, wide)


def _lowest(value: Column) -> Column:
    """The smallest value of the same bucket."""
    return F.call_function("shiftleft", F.call_function("shiftright", value, _wide(value)), _wide(value))


def summaries(df: DataFrame, value: str, keys: list[str], unit: float = 1.0, cuts: dict[str, float] | None = None) -> DataFrame:
    """keys, n, mean, sd, min, max and a double for each cut, interpolated between neighbours. value: BIGINT of zero or more.

    The counts are written to the shared folder at once. Nulls do not count, and groups without values have no row. Results are divided by `unit`; keys must not be null.
    """
    cuts = CUTS if cuts is None else cuts
    if not keys:
        return summaries(df.withColumn("_all", F.lit(0)), value, ["_all"], unit, cuts).drop("_all")
    # read twice below, and by whoever reads the result again: the input is read once
    counted = written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k")).withColumn("_b", bucket(F.col("_v"))), "counted")
    above = (F.col("_v") - _lowest(F.col("_v"))).cast("double")
    coarse = counted.groupBy(*keys, "_b").agg(
        F.sum("_k").alias("_k"), F.sum(F.col("_k") * F.col("_v").cast("double")).alias("_s"), F.sum(F.col("_k") * above).alias("_d1"), F.sum(F.col("_k") * above * above).alias("_d2"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
    )
    whole = Window.partitionBy(*keys)
    placed = coarse.withColumn("upto", F.sum("_k").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_k").over(whole)).withColumn("mean", F.sum("_s").over(whole) / F.col("n"))
    spread = F.col("_d2") - F.col("_d1") ** 2 / F.col("_k") + F.col("_k") * (F.col("_s") / F.col("_k") - F.col("mean")) ** 2
    sd = F.when(F.max("n") > 1, F.sqrt(F.greatest(F.lit(0.0), F.sum(spread)) / (F.max("n") - 1)))
    moments = placed.groupBy(*keys).agg(F.max("n").alias("n"), (F.max("mean") / unit).alias("mean"), (sd / unit).alias("sd"), (F.min("_lo") / unit).alias("min"), (F.max("_hi") / unit).alias("max"))
    at = [F.struct(F.lit(c).alias("cut"), ((F.col("n") - 1) * p).alias("at")) for c, p in cuts.items()]
    wanted = placed.withColumn("c", F.explode(F.array(*at))).withColumn("before", F.col("upto") - F.col("_k"))
    # a bucket is wanted for the rank below the cut, for the one above, or for both
    sides = wanted.withColumn("side", F.explode(F.array(F.struct(F.lit(0).alias("s"), F.floor("c.at").alias("rank")), F.struct(F.lit(1).alias("s"), F.ceil("c.at").alias("rank")))))
    hit = sides.where("side.rank >= before and side.rank < upto").select(*keys, "_b", "before", F.col("c.cut").alias("cut"), F.col("c.at").alias("at"), F.col("side.s").alias("_s"), F.col("side.rank").alias("rank"))
    needed = hit.groupBy(*keys, "_b").agg(F.any_value("before").alias("before"), F.collect_list(F.struct("cut", "at", F.col("_s").alias("s"), "rank")).alias("ranks"))  # two for each cut at most
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    fine = counted.join(needed, [*keys, "_b"]).withColumn("upto", F.col("before") + F.sum("_k").over(inside))
    found = fine.withColumn("r", F.explode(F.filter("ranks", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("_k")))))
    part = F.col("r.at") - F.floor("r.at")
    weight = F.when(F.col("r.s") == 0, 1 - part).otherwise(part)
    value_of = lambda c: (F.sum(F.when(F.col("r.cut") == c, F.col("_v") * weight)) / unit).alias(c)
    return moments.join(found.groupBy(*keys).agg(*(value_of(c) for c in cuts)), keys)


def summary_columns(prefix: str = "", n: Column | None = None) -> list[Column]:
    """The columns of summaries() and iqr under a prefix; zero where there is nothing to tell."""
    told = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in SUMMARY if k not in ("n", "iqr")}
    told |= {"n": F.coalesce(F.col("n"), F.lit(0)).cast("long") if n is None else n, "iqr": told["p75"] - told["p25"]}
    return [told[k].alias(f"{prefix}{k}") for k in SUMMARY]


def running(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, value, times, upto, of: each distinct value of a group with its count, the count up to it, and that of the group."""
    counted = written(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_k")).withColumn("_b", bucket(F.col("_v"))), "counted")
    whole = Window.partitionBy(*keys)
    coarse = counted.groupBy(*keys, "_b").agg(F.sum("_k").alias("in_b"))
    before = coarse.select(*keys, "_b", (F.sum("in_b").over(whole.orderBy("_b")) - F.col("in_b")).alias("before"), F.sum("in_b").over(whole).alias("of"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return counted.join(before, [*keys, "_b"]).select(*keys, F.col("_v").alias("value"), F.col("_k").alias("times"), (F.col("before") + F.sum("_k").over(inside)).alias("upto"), "of")
