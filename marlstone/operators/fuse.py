"""Fusion and re-ranking of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.money import cents, half_away

RRF_K, SHORTLIST, DIGITS = 60, 50, 6


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, k: int = 10, shortlist: int = SHORTLIST) -> DataFrame:
    """(query, doc, score, dense_rank, sparse_rank, rank) from two (query, doc, rank) lists; ties keep the dense order, then the sparse."""
    d = dense.filter(F.col("rank") <= shortlist).filter("doc IS NOT NULL").select("query", "doc", F.col("rank").alias("dense_rank"))
    s = sparse.filter(F.col("rank") <= shortlist).filter("doc IS NOT NULL").select("query", "doc", F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    both = d.join(s, ["query", "doc"], "full").withColumn("score", half_away(part("dense_rank") + part("sparse_rank"), 9))
    w = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def boosted(hits: DataFrame, boosts: DataFrame, facet: str, cap: int = 8, neutral: Column | None = None) -> DataFrame:
    """Hits (query, doc, score, rank, facet) by score times the facet's boost (1 if it has none), ``cap`` of each query.

    Where ``neutral`` holds the order stays as it was.
    """
    flat = F.lit(False) if neutral is None else neutral
    out = hits.join(boosts, facet, "left").withColumn("boosted", F.when(flat, F.col("score")).otherwise(cents(F.col("score") * F.coalesce("boost", F.lit(1.0)), DIGITS)))
    order = [F.when(flat, F.lit(0.0)).otherwise(F.col("boosted")).desc(), F.col("rank")]
    return out.withColumn("new_rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("new_rank") <= cap)


def rerank(hits: DataFrame, scorer, k: int = 5, pool: int = 30) -> DataFrame:
    """Score the first ``pool`` hits of each query with a column function and keep the best ``k``."""
    out = hits.filter(F.col("rank") <= pool).withColumn("rerank_score", scorer)
    w = W.partitionBy("query").orderBy(F.col("rerank_score").desc(), F.col("rank"))
    return out.withColumn("new_rank", F.row_number().over(w)).filter(F.col("new_rank") <= k)


def first_of_each(df: DataFrame, key: str, pos: str, within: str | None = None) -> DataFrame:
    """First occurrence of each key by position; rows of an empty or null key all stay."""
    parts = ([within] if within else []) + [key]
    n = F.row_number().over(W.partitionBy(*parts).orderBy(pos))
    return df.withColumn("_n", n).filter((F.col("_n") == 1) | F.coalesce(F.col(key).cast("string") == "", F.lit(True))).drop("_n")
