"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a fixed mask over consecutive tokens; the tokens under its ones are hashed, the others may be
anything.  The seeds of benchmark items and documents are joined, and around each hit the whole item is
laid over the document on the hit's diagonal: the share of its tokens that agree is the overlap, so
substituted tokens cost no more than themselves.  Where no diagonal has enough, what agrees on diagonals
of at most ``SHIFT`` words to either side is added (each token of the item counts once), so inserted and
dropped words cost no more than themselves; and a stretch of ``RUN`` tokens of the item of which ``RUN_LEAST``
agree counts whatever the item's length.

The seeds are light: an overlap of half an item of 13 tokens or more is always hit (see ``MASKS``).

Tokens are lower-cased words without their punctuation.  Defined results: null and empty texts have no
tokens and match nothing; items of fewer than five tokens are sought as a whole, exactly at their length;
rows that share a document id are one document, rows that share an item id are tried each; a null
document id is reported as null.  Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _base as B

#: 1: a token that must agree, 0: one that may differ.  All ways to agree in three of five neighbouring tokens.
#: An item of n tokens of which half agree has such a five if (n + 1) // 2 > 2 * (n // 5) + min(n % 5, 2): a hit
#: is certain from 13 tokens on, and at 5, 9, 10 and 11.  At the least count for 6, 7, 8 or 12 tokens, its places
#: drawn at random, the chance is 0.80, 0.97, 0.91 and 0.999; one more token makes it certain there too.
MASKS = ("111", "1101", "1011", "11001", "10101", "10011")
SPAN = 5
#: What the second engine's statement lays; its texts are unchanged.
SQL_MASKS = ("110110010111", "111010011011", "101101110011")
#: Diagonals to either side that are added, and the stretch of an item that is a leak by itself.
SHIFT, RUN, RUN_LEAST = 4, 20, 16
#: Seeds of the benchmark that are broadcast at most; beyond, the join shuffles both sides.
MAX_BROADCAST = 2_000_000


def tokens(text: Column) -> Column:
    return B.words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def _keys(hashes: str, at: str, masks: list[str]) -> Column:
    """The key of each mask laid at a place, null where it does not fit."""
    arr, i, n = F.col(hashes), F.col(at), F.size(F.col(hashes))
    of = lambda k, m: F.when(i + len(m) <= n, F.xxhash64(F.lit(int(k, 2)), *(F.get(arr, i + j) for j, c in enumerate(m) if c == "1")))
    return F.array(*(of(f"{m}", m) for m in masks))


def _placed(df: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    least = min(map(len, masks))
    df = df.filter(F.size("h") >= least).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.size("h") - least)).alias("at"))
    return df.select(*keep, "h", "at", F.explode(_keys("h", "at", masks)).alias("key")).filter("key IS NOT NULL")


def find_leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", min_overlap: float = 0.5, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Rows (document, item, n_match long, item_words long, overlap double, start long) for overlaps of ``min_overlap`` or more, or a stretch.

    ``start`` is the token place in the document under the item's first token (negative if the document
    starts inside the item); of several places the one with most agreement, then the first, is given.
    A place that has the overlap on its own diagonal comes before one that has it with its neighbours
    (``n_match`` is then their sum), and that before a stretch, whose overlap may be less than ``min_overlap``.
    """
    hashed = lambda c: F.transform(tokens(c), lambda w: F.xxhash64(w))
    bench = items.select(F.col(item_col).alias("item"), hashed(F.col(text_col)).alias("h")).filter(F.size("h") > 0).distinct()
    # lengths below the masks' span: at most SPAN - 1 numbers
    short = sorted(r[0] for r in bench.filter(F.size("h") < SPAN).select(F.size("h")).distinct().collect())
    bench = bench.select("item", F.xxhash64("item", "h").alias("unit"), "h")
    masks = list(dict.fromkeys([*MASKS, *("1" * n for n in short)]))
    whole = F.size("h")
    seeds = _placed(bench.filter(whole >= SPAN), list(MASKS), "unit").select("key", "unit", "at")
    for n in short:
        seeds = seeds.unionByName(_placed(bench.filter(whole == n), ["1" * n], "unit").select("key", "unit", "at"))
    seeds = seeds.toDF("key", "unit", "item_at")
    small = seeds.count() <= max_broadcast
    hold = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    # part: rows that share an id are laid one by one
    text = docs.select(F.col(doc_col).alias("doc"), hashed(F.col(text_col)).alias("h")).withColumn("part", F.xxhash64("h"))
    units = bench.select("unit", "item", F.col("h").alias("g"))
    if small:
        hits = _placed(text, masks, "doc", "part").join(hold(seeds), "key").select("doc", "part", "h", "unit", (F.col("at") - F.col("item_at")).alias("start"))
    else:
        hits = _placed(text, masks, "doc", "part").select("doc", "part", "at", "key").join(seeds, "key").select("doc", "part", "unit", (F.col("at") - F.col("item_at")).alias("start")).distinct()
        hits = hits.join(text, hits["doc"].eqNullSafe(text["doc"]) & (hits["part"] == text["part"])).select(hits["doc"], hits["part"], "h", "unit", "start")
    hits = hits.join(hold(units), "unit")
    agree = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.get("h", F.col("start") + i) == F.get("g", i))
    # the item's places that agree: how many, and those with two more within a seed's span
    near = lambda a: F.filter(a, lambda x, k: F.coalesce(F.get(a, k + 2) - x < SPAN, F.lit(False)) | F.coalesce(F.get(a, k + 1) - F.get(a, k - 1) < SPAN, F.lit(False)) | F.coalesce(x - F.get(a, k - 2) < SPAN, F.lit(False)))
    laid = F.transform(F.array(agree), lambda a: F.struct(F.col("start").alias("start"), F.size(a).alias("own"), near(a).alias("near")))[0]
    laid = hits.select("doc", "part", "unit", "item", F.size("g").alias("words"), laid.alias("d")).groupBy("doc", "part", "unit", "item", "words").agg(F.array_sort(F.collect_set("d")).alias("ds"))
    # starts differ, so neighbours within SHIFT words are within SHIFT places of the sorted diagonals
    beside = lambda d, k: F.filter(F.slice("ds", F.greatest(k + 1 - SHIFT, F.lit(1)), F.lit(2 * SHIFT + 1)), lambda e: F.abs(e["start"] - d["start"]) <= SHIFT)
    both = F.transform("ds", lambda d, k: F.struct(d["start"].alias("start"), d["own"].alias("own"), F.array_sort(F.array_distinct(F.flatten(F.transform(beside(d, k), lambda e: e["near"])))).alias("u")))
    laid = laid.select("doc", "item", "words", F.explode(both).alias("d")).select("doc", "item", "words", "d.*")
    run = F.exists(F.transform("u", lambda x, k: F.coalesce(F.get("u", k + (RUN_LEAST - 1)) - x < RUN, F.lit(False))), lambda x: x)
    enough, summed = min_overlap * F.col("words"), F.greatest("own", F.size("u"))
    scored = laid.withColumn("kind", F.when(F.col("own") >= enough, 2).when(summed >= enough, 1).when(run, 0)).filter("kind IS NOT NULL")
    scored = scored.select("doc", "item", "kind", F.when(F.col("kind") < 2, F.col("own")).alias("own"), F.col("start").cast("long").alias("start"), F.when(F.col("kind") == 2, F.col("own")).otherwise(summed).cast("long").alias("n_match"), F.col("words").cast("long").alias("item_words"))
    best = scored.groupBy("doc", "item").agg(F.max(F.struct("kind", (F.col("n_match") / F.col("item_words")).alias("overlap"), "own", (-F.col("start")).alias("back"), "n_match", "item_words")).alias("b"))
    return best.select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), "b.n_match", "b.item_words", "b.overlap", (-F.col("b.back")).alias("start"))


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(B.table(spark, sf_dir, "documents"), B.table(spark, sf_dir, "benchmark"))


def _sql_keys(masks: tuple[str, ...]) -> str:
    lists = (f"CASE WHEN i + {len(m) - 1} <= len(w) THEN ['{m}', " + ", ".join(f"w[i+{j}]" for j, c in enumerate(m) if c == "1") + "] END" for m in masks)
    return "[" + ", ".join(lists) + "]"


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}} \t\n\x0B\x0C\r]+', '', 'g'), '[^ \t\n\x0B\x0C\r]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}} \t\n\x0B\x0C\r]+', '', 'g'), '[^ \t\n\x0B\x0C\r]+') AS w FROM benchmark),
dk AS (SELECT doc_id, i, k FROM (SELECT doc_id, i, unnest({_sql_keys(SQL_MASKS)}) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)) WHERE k IS NOT NULL),
bk AS (SELECT item_id, i, k FROM (SELECT item_id, i, unnest({_sql_keys(SQL_MASKS)}) AS k FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b)) WHERE k IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, item_id, dk.i - bk.i AS start FROM dk JOIN bk USING (k)),
laid AS (SELECT doc_id, item_id, start, len(b.w) AS n, d.w AS dw, b.w AS bw, unnest(range(1, len(b.w) + 1)) AS j FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
sc AS (SELECT doc_id, item_id, start, n, sum(CASE WHEN start + j >= 1 AND dw[start + j] = bw[j] THEN 1 ELSE 0 END)::BIGINT AS m FROM laid GROUP BY doc_id, item_id, start, n),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY m DESC, start) AS rn FROM sc WHERE m >= 0.5 * n)
SELECT doc_id, item_id, m AS n_match, n::BIGINT AS item_words, m / n AS overlap, start::BIGINT AS start FROM r WHERE rn = 1
"""
