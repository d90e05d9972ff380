"""Training-data mining: look-ups, exclusions, samples, splits, negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def checked_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which a left key without a right row is an error."""
    both = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    first = [c for c in right.columns if c != key][0]
    kind = right.schema[first].dataType
    missing = F.raise_error(F.concat(F.lit("no row has the key "), F.col(key).cast("string"))).cast(kind)
    return both.withColumn(first, F.when(F.col("_found").isNull(), missing).otherwise(F.col(first))).drop("_found")


def hash_order(key: Column, seed: str) -> Column:
    """A fixed shuffle that any engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def eligible(pool: DataFrame, key: str, size: str, least: int, *excluded: DataFrame) -> DataFrame:
    out = pool.filter(F.col(size) >= least)
    for e in excluded:
        out = out.join(e.select(key).distinct(), key, "left_anti")
    return out


def stratified(df: DataFrame, key: str, stratum: str, quotas: DataFrame, total: int, seed: str = "0") -> DataFrame:
    """Up to its quota of rows of each stratum by hash order, topped up from the rest to ``total``; column ``pick`` says which."""
    w = W.partitionBy(stratum).orderBy(hash_order(F.col(key), seed))
    ranked = df.withColumn("n", F.row_number().over(w)).join(quotas, stratum, "left")
    chosen = ranked.filter(F.col("n") <= F.coalesce("quota", F.lit(0))).select(key, stratum, F.lit("quota").alias("pick"))
    rest = df.join(chosen.select(key), key, "left_anti").select(key, stratum).withColumn("h", hash_order(F.col(key), seed))
    n = chosen.agg(F.greatest(F.lit(0), F.lit(total) - F.count(F.lit(1))).alias("short"))
    more = rest.orderBy("h", key).limit(total).withColumn("i", F.row_number().over(W.orderBy("h", key)))
    more = more.join(F.broadcast(n), how="cross").filter("i <= short").select(key, stratum, F.lit("top_up").alias("pick"))
    return chosen.unionByName(more)


def split(df: DataFrame, key: str, fraction: float, seed: str = "0") -> DataFrame:
    """Marks dev rows: those of least hash, max(1, floor(n * fraction)) of them.

    Rows are counted by the first digits of their hash; only those of the digits that hold the bound are ranked.
    """
    keyed = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_d", F.substring("_h", 1, 4))
    counts = keyed.groupBy("_d").agg(F.count(F.lit(1)).alias("c"))  # 65,536 rows at most
    ends = counts.withColumn("end", F.sum("c").over(W.orderBy("_d")))
    n = counts.agg(F.greatest(F.lit(1), F.floor(F.sum("c") * fraction)).alias("n"))
    bound = ends.join(F.broadcast(n), how="cross").filter("end >= n").orderBy("_d").limit(1).select(F.col("_d").alias("_at"), (F.col("n") - (F.col("end") - F.col("c"))).alias("_in"))
    marked = keyed.join(F.broadcast(bound), how="cross")
    edge = marked.filter("_d = _at").withColumn("_i", F.row_number().over(W.orderBy("_h", key)))
    edge = edge.withColumn("part", F.when(F.col("_i") <= F.col("_in"), "dev").otherwise("train")).drop("_i")
    rest = marked.filter("_d <> _at").withColumn("part", F.when(F.col("_d") < F.col("_at"), "dev").otherwise("train"))
    return rest.unionByName(edge).drop("_h", "_d", "_at", "_in")


def hard_negatives(hits: DataFrame, positives: DataFrame, group_of: DataFrame, pool: int = 50, keep: int = 20) -> DataFrame:
    """(query, doc, score, place): of the first ``pool`` hits those that share no group with a positive of the query, ``keep`` of them.

    hits (query, doc, score, rank), positives (query, doc), group_of (doc, group).
    """
    own = positives.join(group_of, "doc").select("query", "group").distinct()
    out = hits.filter(F.col("rank") <= pool).join(group_of, "doc").join(own, ["query", "group"], "left_anti")
    place = F.row_number().over(W.partitionBy("query").orderBy("rank"))
    return out.withColumn("place", place).filter(F.col("place") <= keep).select("query", "doc", "score", "place")


def triplets(positives: DataFrame, negatives: DataFrame, texts: DataFrame, n: int = 4) -> DataFrame:
    """(query, positive, negatives array): the n hardest with a text, in order; the last is repeated to fill; rows without any go."""
    neg = negatives.join(texts.filter("text IS NOT NULL AND text <> ''").select("doc"), "doc", "left_semi")
    lists = neg.filter(F.col("place") <= 4 * n).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "doc"))).alias("l")).select("query", F.slice(F.transform("l", lambda x: x["doc"]), 1, n).alias("l"))
    full = F.slice(F.concat("l", F.array_repeat(F.element_at("l", -1), n)), 1, n)
    return positives.join(lists, "query").select("query", F.col("doc").alias("positive"), full.alias("negatives"))
