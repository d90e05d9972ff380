"""Comparing two evaluated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.operators.evaluate import mean

EPS, DIGITS = 1e-9, 6


def paired(base: DataFrame, other: DataFrame, key: str, metric: str) -> DataFrame:
    """(key, base, other, delta).  A key that only one run has is an error."""
    both = base.select(key, F.col(metric).alias("base"), F.lit(True).alias("in_base")).join(other.select(key, F.col(metric).alias("other"), F.lit(True).alias("in_other")), key, "full")
    alone = F.col("in_base").isNull() | F.col("in_other").isNull()
    checked = F.when(alone, F.raise_error(F.concat(F.lit("only one run has the query "), F.col(key).cast("string"))).cast("double")).otherwise(F.col("base"))
    both = both.select(key, checked.alias("base"), "other")
    return both.withColumn("delta", F.round(F.col("other") - F.col("base"), DIGITS) + 0.0)


def wins(deltas: DataFrame, *by: str) -> DataFrame:
    d = F.col("delta")
    return deltas.groupBy(*by).agg(F.count_if(d > EPS).alias("win"), F.count_if(F.abs(d) <= EPS).alias("tie"), F.count_if(d < -EPS).alias("loss"), (mean(d) + 0.0).alias("mean_delta"))


def extremes(deltas: DataFrame, by: str, n: int, key: str = "query") -> DataFrame:
    """The n largest and n smallest changes of each group."""
    out = []
    for kind, order in (("win", F.col("delta").desc()), ("loss", F.col("delta").asc())):
        place = F.row_number().over(W.partitionBy(by).orderBy(order, key))
        out.append(deltas.withColumn("place", place).filter(F.col("place") <= n).select(by, F.lit(kind).alias("kind"), "place", key, "delta"))
    return out[0].unionByName(out[1])
