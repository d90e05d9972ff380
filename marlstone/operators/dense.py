"""Vector retrieval: exact cosine over unit vectors, a block of queries at a time against all rows.

Scores are rounded half away from zero, and those that are no number come first, as in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.bm25 import DIGITS, top_k

BLOCK = 2048  # query vectors on the driver at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def rounded(x: np.ndarray) -> np.ndarray:
    """To DIGITS digits, halves away from zero; no negative zero."""
    x = x * 10.0**DIGITS
    whole = np.trunc(x)
    return (whole + np.where(np.abs(x - whole) >= 0.5, np.sign(x), 0.0)) / 10.0**DIGITS + 0.0


def search(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 10, scores: Callable[[np.ndarray, np.ndarray], np.ndarray] = products) -> DataFrame:
    """(query, doc, score, rank).  Each task keeps the k best of each query, so k rows a task and query are exchanged.

    ``scores`` gives the matrix of scores of two matrices of row vectors.
    """
    spark = corpus.sparkSession
    blocks, ids, vectors = [], [], []

    def flush() -> None:
        if ids:
            blocks.append(_block(corpus, key, vector, spark.sparkContext.broadcast((np.array(ids), np.array(vectors, np.float64))), k, scores))
            ids.clear()
            vectors.clear()

    for row in queries.select(key, vector).orderBy(key).toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == BLOCK:
            flush()
    flush()
    if not blocks:
        return spark.createDataFrame([], "query long, doc long, score double, rank int")
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return top_k(out, k)


def _block(corpus: DataFrame, key: str, vector: str, share, k: int, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = share.value
        best: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            docs = frame[key].to_numpy()
            scores = rounded(of(q, np.stack(frame[vector].to_numpy()).astype(np.float64)))
            first = np.where(np.isnan(scores), np.inf, scores)
            order = np.lexsort((np.broadcast_to(docs, scores.shape), -first), axis=1)[:, :k]
            new = pd.DataFrame({"query": np.repeat(ids, order.shape[1]), "doc": docs[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel(), "first": np.take_along_axis(first, order, 1).ravel()})
            both = new if best is None else pd.concat([best, new])
            best = both.sort_values(["first", "doc"], ascending=[False, True]).groupby("query").head(k)
        if best is not None:
            yield best[["query", "doc", "score"]]

    # pandas hands on what is no number as null
    out = corpus.select(key, vector).mapInPandas(run, "query long, doc long, score double")
    return out.withColumn("score", F.coalesce("score", F.lit(float("nan"))))
