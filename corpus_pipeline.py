"""The corpus pipeline: documents through quality, near-duplicates, repeats, benchmark leaks and tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame;
``run`` writes each one's rows as Parquet in the shared folder and reads them again for the next.  All
stages but the last return the columns of documents.  Rows with a null id pass the stages that decide by
id; empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base, fm, minhash, recompress, spaced, tokens

#: The first stage is a trained model, which SQL cannot say: tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts; it learns from the labelled rows that are not held out."""
    table = _base.table
    machine = fm.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=("n_chars",))
    return fm.accepted(docs, machine, metadata=("n_chars",))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of smallest id."""
    found = minhash.near_duplicates(docs)
    gone = _base.written(found.filter("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(_base.held(gone), "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word windows that a smaller document has; those with no word left go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = recompress.remove_repeats(docs, keep=others, outputs=("clean_text",)).filter("n_removed < n_words OR n_words = 0")
    size = F.when(F.col("n_removed") > 0, F.length("clean_text").cast("long"))
    cols = {"text": F.col("clean_text").alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.coalesce(size, F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*(cols.get(c, F.col(c)) for c in docs.columns))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = spaced.find_leaks(docs, _base.table(spark, sf_dir, "benchmark"))
    gone = _base.written(found.select("doc_id").distinct(), "gone")
    return docs.join(_base.held(gone), "doc_id", "left_anti").select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded bytes of each document, as counts and digests."""
    import public_tokenizers as P

    ranks = tokens.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    both = tokens.decode(tokens.encode(docs, ranks, P.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", leaks),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = _base.written(docs, f"stage{i + 1}")
    return docs
