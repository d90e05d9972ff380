"""Retrieval and agent metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.money import half_away

DIGITS = 6
#: Added to means before they are rounded, so that those halfway between two digits go up in every engine.
TIE = 1e-10


def mean(value) -> Column:
    return F.round(F.avg(value) + TIE, DIGITS)


def per_query(hits: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query, n_gold, recall_k..., mrr_10, ndcg_10): hits (query, doc, rank), gold (query, doc).  No gold counts 0."""
    n = gold.groupBy("query").agg(F.count(F.lit(1)).alias("n_gold"))
    got = hits.join(gold, ["query", "doc"], "left_semi").groupBy("query").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"hits_{k}") for k in ks),
        F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.coalesce("n_gold", F.lit(1)), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = queries.select("query").join(n, "query", "left").join(got, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "query",
        F.coalesce("n_gold", F.lit(0)).cast("long").alias("n_gold"),
        *(half_away(zero(F.col(f"hits_{k}") / F.col("n_gold")), DIGITS).alias(f"recall_{k}") for k in ks),
        half_away(zero(1 / F.col("first")), DIGITS).alias("mrr_10"),
        half_away(zero(F.col("dcg") / ideal), DIGITS).alias("ndcg_10"),
    )


METRICS = ("recall_5", "recall_10", "mrr_10", "ndcg_10")


def means(rows: DataFrame, *by: str) -> DataFrame:
    """Macro means and n; zeros for no rows."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(mean(m).alias(m) for m in METRICS))
    return out.select(*by, "n", *(F.coalesce(m, F.lit(0.0)).alias(m) for m in METRICS))


def latency(df: DataFrame, value: str, *by: str, parts: int = 256) -> DataFrame:
    """Mean, upper median, p95 at the half-even rounded place, and maximum; the places are exact.

    Equal values are counted first.  Approximate quantiles cut each group into ``parts``, the parts' counts
    tell which hold the two places, and only their values are put in order.
    """
    from pyspark.sql.window import Window as W

    counts = df.select(F.to_json(F.struct(F.lit(0), *by)).alias("k"), *by, F.col(value).alias("v")).filter("v IS NOT NULL").groupBy("k", *by, "v").agg(F.count(F.lit(1)).alias("c"))
    whole = counts.groupBy("k", *by).agg(
        F.sum("c").alias("n"),
        F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), DIGITS).alias("mean_ms"),
        F.max("v").alias("max_ms"),
        F.percentile_approx("v", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts"),
    )
    places = whole.select("k", F.floor(F.col("n") / 2).alias("mid"), F.bround(0.95 * (F.col("n") - 1)).cast("long").alias("late"))
    dealt = counts.join(whole.select("k", "cuts"), "k").select("k", "v", "c", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("part"))
    sizes = dealt.groupBy("k", "part").agg(F.sum("c").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(W.partitionBy("k").orderBy("part")) - F.col("size")).join(places, "k")
    holds = lambda i: (F.col(i) >= F.col("before")) & (F.col(i) < F.col("before") + F.col("size"))
    asked = before.filter(holds("mid") | holds("late")).drop("size")
    inside = dealt.join(asked, ["k", "part"]).withColumn("end", F.col("before") + F.sum("c").over(W.partitionBy("k", "part").orderBy("v")))
    at = lambda i: F.max(F.when((F.col("end") > F.col(i)) & (F.col("end") - F.col("c") <= F.col(i)), F.col("v")))
    found = inside.groupBy("k").agg(at("mid").alias("median_ms"), at("late").alias("p95_ms"))
    return whole.join(found, "k").select(*by, "n", "mean_ms", "median_ms", "p95_ms", "max_ms")


def recall_curve(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(k, recall): the mean over the queries that have gold, for each k."""
    n = gold.groupBy("query").agg(F.count(F.lit(1)).alias("n_gold"))
    found = hits.join(gold, ["query", "doc"], "left_semi").select("query", "rank")
    grid = n.select("query", "n_gold", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"))
    got = grid.join(found, (grid["query"] == found["query"]) & (found["rank"] <= grid["k"]), "left").groupBy(grid["query"], "k", "n_gold").agg(F.count(found["rank"]).alias("h"))
    return got.groupBy("k").agg(F.round(F.avg(F.col("h") / F.col("n_gold")), DIGITS).alias("recall"))


# --- agents --------------------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def tool_recall(actual: Column, expected: Column) -> Column:
    some = F.size(F.array_intersect(actual, expected)) / F.size(F.array_distinct(expected))
    return F.when(F.size(expected) == 0, F.when(F.size(actual) == 0, 1.0).otherwise(0.0)).otherwise(some)


def tool_precision(actual: Column, expected: Column) -> Column:
    return tool_recall(expected, actual)


def publisher_recall(actual: Column, expected: Column) -> Column:
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(actual, expected)) / F.size(F.array_distinct(expected)))


def trajectory(iterations: Column, actual: Column, expected: Column) -> Column:
    return 1 / (1 + F.greatest(F.lit(0), iterations - 1) + F.size(F.array_except(actual, expected)))


def faithfulness(supported: Column, claims: Column) -> Column:
    """Null without a judge; 1 without claims."""
    return F.when(claims == 0, 1.0).otherwise(F.try_divide(supported, claims))


def next_step(iteration: Column, complete: Column, refined: Column, cap: int = 2) -> Column:
    again = (iteration < cap) & ~F.coalesce(complete, F.lit(True)) & (F.trim(F.coalesce(refined, F.lit(""))) != "")
    return F.when(again, "retrieve").otherwise("answer")
