"""Statistics of fits, as column expressions, and the summary of a column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.quantiles import summaries, summary_columns
from flowloom.schema import DAY_MS


def summarise(df: DataFrame, value_ms: str, *keys: str) -> DataFrame:
    """The summary in days of a column of milliseconds, by keys; without keys one row, of zeros if there are no values."""
    told = summaries(df, value_ms, list(keys), float(DAY_MS))
    if not keys:
        told = df.sparkSession.range(1).join(F.broadcast(told), F.lit(True), "left")
    return told.select(*keys, *summary_columns())


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by the published rational approximation 7.1.26 of the error function."""
    # Coefficients of the approximation.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * x)
    tail = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5)))) * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -1).otherwise(1) * (1 - tail))
