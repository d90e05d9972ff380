"""As-of look-ups and shaping of (series, period_end, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.dates import break_note, period_end


def as_of_date(rows: DataFrame, key: str, day: Column) -> DataFrame:
    """The last row of each series up to a day, that day included."""
    return rows.filter(F.col("period_end") <= day).groupBy(key).agg(F.max("period_end").alias("period_end"), F.max_by("value", "period_end").alias("value"))


def as_of_join(left: DataFrame, right: DataFrame, key: str, time: str, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """For each left row the right row of the same key with the last time up to its own; null where there is none.

    One exchange: both sides are stacked and the last right value is carried forward.
    """
    value = F.struct(*(F.col(c) for c in right_cols))
    stacked = left.select(key, time, *left_cols, F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("v"), F.lit(1).alias("side"))
    stacked = stacked.unionByName(right.select(key, time, value.alias("v"), F.lit(0).alias("side")), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(time, "side").rowsBetween(W.unboundedPreceding, 0)
    out = stacked.withColumn("found", F.last("v", ignorenulls=True).over(w)).filter("side = 1")
    return out.select(*left_cols, *(F.col(f"found.{c}").alias(c) for c in right_cols))


def aligned(rows: DataFrame) -> DataFrame:
    """(period_end, series, value, n_points): every series on every date of the union, gaps null."""
    days = rows.select("period_end").distinct()
    grid = days.join(F.broadcast(rows.select("series").distinct()), how="cross").join(F.broadcast(days.agg(F.count(F.lit(1)).alias("n_points"))), how="cross")
    return grid.join(rows, ["period_end", "series"], "left").select("period_end", "series", "value", "n_points")


def envelope(rows: DataFrame, key: str, period: str, today: Column, source: str, investor: bool = True) -> DataFrame:
    """What a series tool answers: value, its date, the period asked for, and a citation, annotated where it must be."""
    day = period_end(F.lit(period), today)
    found = as_of_date(rows, key, day)
    cite = F.concat(F.lit(f"{source}, "), F.col("period_end").cast("string"))
    return found.select(key, F.lit(period).alias("queried_period"), day.alias("resolved_date"), F.col("period_end").alias("as_of"), "value", (break_note(cite, F.col("period_end")) if investor else cite).alias("citation"))
