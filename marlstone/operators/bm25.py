"""Lexical retrieval: term statistics, a persisted index of them, and two BM25 variants.

A document is scored where it is scanned: the terms of the queries, with their weights, go to each task,
which keeps the k best documents of each query, so k rows a task and query are exchanged and no posting is.
Query terms beyond ``MAX_BROADCAST`` are joined to postings by term instead.  Ties in the rounded score
are broken by the document's key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions.text import terms
from marlstone.operators.encode import term_list

K1, B, FLOOR, DIGITS = 1.5, 0.75, 0.25, 6


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, tf)."""
    return docs.select(F.col(key).alias("doc"), F.explode(terms(F.col(text))).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.size(terms(F.col(text))).cast("long").alias("dl"))


def corpus_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: number of documents and mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(terms(F.col(text))).cast("double")).alias("avgdl"))


def doc_freq(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df): how many documents have a term."""
    return docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_script(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def idf_okapi(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


MAX_BROADCAST = 1_000_000  # rows of query terms that are sent to the tasks at most
FLUSH = 200_000  # terms that a task counts before it hands them on


def statistics(docs: DataFrame, text: str, wanted: frozenset[str] | None = None) -> DataFrame:
    """(term, df) of the wanted terms, or all, and under the term '' the number of documents as df and of their terms as total: one scan."""
    share = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep, n, total, df = share.value, 0, 0, Counter()
        for f in frames:
            for t in f[text]:
                w = term_list(t)
                n, total = n + 1, total + len(w)
                own = set(w)
                df.update(own if keep is None else own & keep)
            if len(df) > FLUSH:
                yield pd.DataFrame({"term": list(df), "df": list(df.values()), "total": 0})
                df.clear()
        yield pd.DataFrame({"term": ["", *df], "df": [n, *df.values()], "total": [total, *[0] * len(df)]})

    return docs.select(text).mapInPandas(run, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def build_index(docs: DataFrame, text: str, path: str) -> None:
    """Write the statistics of a corpus; ``load_index`` reads them for searches that need not count again."""
    statistics(docs, text).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, key: str, text: str, k: int = 10, okapi: bool = False, index: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query with a score over 0.

    ``index`` has the statistics of the corpus; without it they are counted first, of the queries' terms alone
    unless the floor of the Okapi variant needs all.  A null text has no terms.
    """
    spark = docs.sparkSession
    asked = postings(queries, query_key, query_text).select(F.col("doc").alias("query"), "term", F.col("tf").alias("qtf"))
    if asked.count() > MAX_BROADCAST:
        return _joined(asked, docs, key, text, k, okapi)
    rows = [tuple(r) for r in asked.sort("query", "term").toLocalIterator()]
    terms_asked = frozenset(r[1] for r in rows)
    stats = statistics(docs, text, None if okapi else terms_asked) if index is None else index
    if okapi and index is None:
        stats = stats.cache()
    own = stats.join(F.broadcast(asked.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))), "term", "left_semi")
    df = {r["term"]: (r["df"], r["total"]) for r in own.toLocalIterator()}
    n, total = df.pop("", (0, 0))
    if not n:
        return _typed(spark, queries, query_key, docs, key)
    if okapi:
        low = stats.filter("term <> ''").agg(F.avg(idf_okapi(F.lit(n), F.col("df")))).first()[0]
        if index is None:
            stats.unpersist()
        raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, (x, _) in df.items()}
        idf = {t: FLOOR * low if x < 0 else x for t, x in raw.items()}
    else:
        idf = {t: math.log(1 + (n - x + 0.5) / (x + 0.5)) for t, (x, _) in df.items()}
    names = sorted({r[0] for r in rows})
    place = {q: i for i, q in enumerate(names)}
    weights: dict[str, tuple[list, list]] = {}
    for q, t, qtf in rows:
        if t in idf:
            at = weights.setdefault(t, ([], []))
            at[0].append(place[q])
            at[1].append(qtf * idf[t])
    share = spark.sparkContext.broadcast((names, {t: (np.array(i), np.array(w)) for t, (i, w) in weights.items()}, total / n))
    kinds = f"query {queries.schema[query_key].dataType.simpleString()}, doc {docs.schema[key].dataType.simpleString()}, score double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weights, avgdl = share.value
        best: pd.DataFrame | None = None
        for f in frames:
            at, docs_, scores = [], [], []
            for doc, t in zip(f[key], f[text], strict=True):
                w = term_list(t)
                tf = Counter(x for x in w if x in weights)
                if not tf:
                    continue
                score = np.zeros(len(names))
                norm = K1 * (1 - B + B * len(w) / avgdl)
                for x, c in tf.items():
                    i, weight = weights[x]
                    score[i] += weight * c * (K1 + 1) / (c + norm)
                own = np.flatnonzero(score)
                at.append(own)
                docs_ += [doc] * len(own)
                scores.append(score[own])
            if not at:
                continue
            new = pd.DataFrame({"at": np.concatenate(at), "doc": docs_, "score": np.round(np.concatenate(scores), DIGITS)})
            both = new if best is None else pd.concat([best, new])
            best = both.sort_values(["score", "doc"], ascending=[False, True]).groupby("at").head(k)
        if best is not None:
            yield pd.DataFrame({"query": [names[i] for i in best["at"]], "doc": best["doc"], "score": best["score"]})

    return top_k(docs.filter(F.col(key).isNotNull()).select(key, text).mapInPandas(run, kinds), k).filter("score > 0")


def _typed(spark: SparkSession, queries: DataFrame, query_key: str, docs: DataFrame, key: str) -> DataFrame:
    return spark.createDataFrame([], f"query {queries.schema[query_key].dataType.simpleString()}, doc {docs.schema[key].dataType.simpleString()}, score double, rank int")


def _joined(asked: DataFrame, docs: DataFrame, key: str, text: str, k: int, okapi: bool) -> DataFrame:
    """The same for more query terms than are sent: postings of the asked terms, joined by term."""
    known = asked.select("term").distinct()
    words = docs.select(F.col(key).alias("doc"), terms(F.col(text)).alias("w"))
    tf = words.select("doc", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).join(known, "term", "left_semi").groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    stats = words.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("w").cast("double")).alias("avgdl"))
    if okapi:
        raw = doc_freq(docs, key, text).join(F.broadcast(stats), how="cross").withColumn("raw", idf_okapi(F.col("n_docs"), F.col("df")))
        floor = raw.agg((F.avg("raw") * FLOOR).alias("floor"))  # one row each: stats and floor
        idf = raw.join(known, "term", "left_semi").join(F.broadcast(floor), how="cross")
        idf = idf.select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), "avgdl")
    else:
        freq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        idf = freq.join(F.broadcast(stats), how="cross").select("term", idf_script(F.col("n_docs"), F.col("df")).alias("idf"), "avgdl")
    found = tf.join(asked.join(idf, "term"), "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.groupBy("query", "doc").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return top_k(scored, k).filter("score > 0")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, by score then document; cut before the exchange by the window's group limit."""
    w = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
