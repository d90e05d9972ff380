"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed, each host counts the distinct documents that hold a line, lines above
the limits are removed, and documents that lose too much are rejected.

Defined results: a null text counts as empty; a null host as the host ''; a null or repeated id keeps
one result row for each input row.  Rows with the same text on one host count as one document, so exact
copies do not make a line frequent.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base as B

WINDOW = 8
SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is bound, a repeated expression is not."""
    return F.transform(F.array(value), body)[0]


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), B.SPACE, " ")), "[0-9]+", "0")


def _covered(places: Column) -> Column:
    """Words under windows that start at the sorted places."""
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
    return F.aggregate(places, zero, step)["n"]


def _repeated(windows: Column) -> Column:
    """Starts of windows found twice or more: sort (hash, place), keep those with an equal neighbour."""
    n = F.size(windows)
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return _let(
        ordered,
        lambda s: F.array_sort(
            F.transform(
                F.filter(
                    F.transform(s, lambda e, i: F.struct(e["p"].alias("p"), (((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == e["h"]))).alias("d"))),
                    lambda e: F.coalesce(e["d"], F.lit(False)),
                ),
                lambda e: e["p"],
            )
        ),
    )


def repeat_words(word_array: Column) -> Column:
    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    windows = _let(hashes, lambda h: F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    return _let(windows, lambda v: F.when(F.size(v) == F.size(F.array_distinct(v)), F.lit(0).cast("long")).otherwise(_covered(_repeated(v))))


def line_quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 20,
    max_share: float = 0.002,
    min_words: int = 20,
    max_removed: float = 0.5,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """One row for each input row: the base counts, the places of removed lines, the text without them, and the verdict.

    A line goes if more than ``max_docs`` distinct documents of its host hold it and they are more than
    ``max_share`` of the host's documents.  A document is kept if it passes the base rule, has
    ``min_words`` words left and lost no more than ``max_removed`` of them.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")).withColumn("digest", F.xxhash64("text"))
    lines = (
        docs.select("id", "host", "digest", F.posexplode(F.split("text", "\n")).alias("place", "line"))
        .select("id", "host", "digest", "place", F.size(B.words(F.col("line"))).alias("line_words"), normalised(F.col("line")).alias("line"))
        .filter("line_words > 0")
        .select("id", "host", "digest", "place", "line_words", F.xxhash64("line").alias("line"))
    )
    counts = lines.select("host", "line", "digest").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > max_docs)
    hosts = docs.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = counts.join(hosts, "host").filter(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line")
    lost = (
        lines.join(frequent, ["host", "line"])
        .groupBy(F.col("id").alias("id_"), F.col("host").alias("host_"), F.col("digest").alias("digest_"))
        .agg(F.collect_set(F.struct("place", "line_words")).alias("lost"))
    )
    base = docs.withColumn("w", B.words(F.col("text"))).select(
        "id", "host", "digest", "text",
        F.size("w").cast("long").alias("n_words"),
        F.array_join("w", "").alias("joined"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        _let(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    base = base.select("id", "host", "digest", "text", "n_words", F.length("joined").cast("long").alias("word_chars"), F.length(F.regexp_replace("joined", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words")
    both = base.join(lost, F.col("id").eqNullSafe(F.col("id_")) & (F.col("host") == F.col("host_")) & (F.col("digest") == F.col("digest_")), "left")
    n_lost = F.aggregate(F.coalesce(F.col("lost"), F.array().cast("array<struct<place:int,line_words:int>>")), F.lit(0).cast("long"), lambda a, x: a + x["line_words"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    gone = F.transform(F.col("lost"), lambda x: x["place"])
    left = _let(F.split("text", "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"))
    return both.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        n_lost.alias("n_removed_words"),
        F.array_sort(F.coalesce(gone, F.array().cast("array<int>"))).alias("removed_lines"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(left).alias("clean_text"),
        (~failed & (F.col("n_words") - n_lost >= min_words) & (n_lost <= max_removed * F.col("n_words"))).alias("kept"),
    )


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality(B.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i+7] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, i - coalesce(prev, -100)))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM dup) GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, host, text, line, len(regexp_extract_all(line, '[^ \t\n\x0B\x0C\r]+')) AS nw,
              regexp_replace(trim(regexp_replace(lower(line), '[ \t\n\x0B\x0C\r]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g') AS norm FROM raw),
lw AS (SELECT * FROM ln WHERE nw > 0),
dl AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lw GROUP BY doc_id),
cnt AS (SELECT host, norm, count(DISTINCT text) AS n FROM lw GROUP BY host, norm),
hs AS (SELECT host, count(DISTINCT text) AS hn FROM d GROUP BY host),
fr AS (SELECT cnt.host, norm FROM cnt JOIN hs USING (host) WHERE n > 20 AND n > 0.002 * hn),
lost AS (SELECT doc_id, sum(nw)::BIGINT AS lost FROM lw JOIN fr USING (host, norm) GROUP BY doc_id),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_removed_words
      FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words - n_removed_words >= 20 AND n_removed_words <= 0.5 * n_words) AS kept, n_removed_words
FROM f
"""
