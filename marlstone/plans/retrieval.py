"""Queries of retrieval and its evaluation over documents, benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions import text as X
from marlstone.operators import bm25, dense, encode, evaluate, fuse
from marlstone.plans.registry import query
from marlstone.sources.tables import scratch, spread, table

STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(X.STOPWORDS))) + "]"


def terms_sql(col: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({col}, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: NOT list_contains({STOP}, x))"


TOK = f"tok AS (SELECT doc_id, {terms_sql('text')} AS w FROM documents)"
POST = "post AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM tok) GROUP BY ALL)"
BASE = f"""{TOK}, {POST},
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok), dl AS (SELECT doc_id, len(w) AS dl FROM tok),
fr AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT item_id, t AS term, count(*) AS qtf FROM (SELECT item_id, unnest({terms_sql('text')}) AS t FROM benchmark) GROUP BY ALL)"""
IDF = {"script": "SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM fr, st", "okapi": "SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM fr, st)"}


def hits_sql(kind: str, k: int, name: str) -> str:
    return f"""{name}_idf AS ({IDF[kind]}),
{name}_sc AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN {name}_idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), st GROUP BY item_id, doc_id),
{name} AS (SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {name}_sc) WHERE rank <= {k} AND score > 0)"""


def bm25_hits(spark: SparkSession, sf_dir: str, k: int, okapi: bool = False) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "benchmark"), spread(table(spark, sf_dir, "documents")), "item_id", "text", "doc_id", "text", k, okapi)


@query("tokenize_terms", f"WITH {TOK} SELECT doc_id, len(w)::BIGINT AS n_terms, md5(array_to_string(w, ' ')) AS terms_md5 FROM tok")
def tokenize_terms(spark, sf_dir):
    w = X.terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_terms"), F.md5(F.array_join(w, " ")).alias("terms_md5"))


@query("term_frequency", f"WITH {TOK}, {POST} SELECT doc_id, term, tf::BIGINT AS tf FROM post")
def term_frequency(spark, sf_dir):
    return bm25.postings(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


@query("doc_freq", f"WITH {TOK}, {POST} SELECT term, count(*)::BIGINT AS df FROM post GROUP BY term")
def doc_freq(spark, sf_dir):
    return bm25.doc_freq(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("corpus_stats", f"WITH {TOK} SELECT count(*)::BIGINT AS n_docs, round(avg(len(w)), 6) AS avgdl FROM tok")
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(table(spark, sf_dir, "documents"), "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query("bm25_topk", f"WITH {BASE}, {hits_sql('script', 10, 'h')} SELECT item_id, doc_id, score, rank FROM h")
def bm25_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir, 10).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query("bm25_okapi_topk", f"WITH {BASE}, {hits_sql('okapi', 10, 'h')} SELECT item_id, doc_id, score, rank FROM h")
def bm25_okapi_topk(spark, sf_dir):
    return bm25_hits(spark, sf_dir, 10, True).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


DENSE = """q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT query, vec_id AS doc, round(list_dot_product(q.e, embeddings.embedding::DOUBLE[]), 6) + 0.0 AS score FROM q, embeddings),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank FROM ds) WHERE rank <= {k})"""


def dense_hits(spark, sf_dir, k):
    emb = table(spark, sf_dir, "embeddings")
    return dense.search(emb.filter("vec_id % 50 = 0"), emb, "vec_id", "embedding", k)


@query("dense_topk", f"WITH {DENSE.format(k=10)} SELECT query, doc, score, rank FROM dn")
def dense_topk(spark, sf_dir):
    return dense_hits(spark, sf_dir, 10)


@query(
    "cosine_range_filter",
    """WITH p AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(c, 6) + 0.0 AS cosine, CASE WHEN c IS NULL THEN 'missing' WHEN c < 0.3 THEN 'low' WHEN c > 0.95 THEN 'high' ELSE 'kept' END AS verdict FROM p""",
)
def cosine_range_filter(spark, sf_dir):
    """Each vector against its successor: kept from 0.30 to 0.95, and why not."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    both = a.join(b, "vec_id", "left").select("vec_id", F.when(F.col("y").isNotNull(), dense.dot(F.col("x"), F.col("y"))).alias("c"))
    verdict = F.when(F.col("c").isNull(), "missing").when(F.col("c") < 0.30, "low").when(F.col("c") > 0.95, "high").otherwise("kept")
    return both.select("vec_id", (F.round("c", 6) + 0.0).alias("cosine"), verdict.alias("verdict"))


@query(
    "cosine_funnel",
    """WITH p AS (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT count(*)::BIGINT AS n_in, count(*) FILTER (c BETWEEN 0.3 AND 0.95)::BIGINT AS kept, count(*) FILTER (c IS NULL)::BIGINT AS drop_missing, count(*) FILTER (c < 0.3)::BIGINT AS drop_low, count(*) FILTER (c > 0.95)::BIGINT AS drop_high FROM p""",
)
def cosine_funnel(spark, sf_dir):
    v = cosine_range_filter(spark, sf_dir)
    n = lambda x: F.count_if(F.col("verdict") == x)
    return v.agg(F.count(F.lit(1)).alias("n_in"), n("kept").alias("kept"), n("missing").alias("drop_missing"), n("low").alias("drop_low"), n("high").alias("drop_high"))


VECTORS = f"""vt AS (SELECT 'd' AS kind, doc_id AS id, unnest(w) AS t FROM tok UNION ALL SELECT 'q', item_id, unnest({terms_sql('text')}) FROM benchmark),
vv AS (SELECT kind, id, ('0x' || substr(md5(t), 1, 2))::INTEGER % 64 AS dim, sum(CASE WHEN substr(md5(t), 3, 1) >= '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM vt GROUP BY ALL),
vn AS (SELECT kind, id, sum(v * v) AS n FROM vv GROUP BY kind, id),
vd AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.v * d.v) AS dot FROM vv q JOIN vv d ON q.kind = 'q' AND d.kind = 'd' AND q.dim = d.dim GROUP BY 1, 2)"""
NEAREST = f"""{VECTORS},
vs AS (SELECT item_id, doc_id, round(coalesce(dot / (sqrt(q.n) * sqrt(d.n)), 0), 6) + 0.0 AS score FROM (SELECT item_id FROM benchmark) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN vd USING (item_id, doc_id) LEFT JOIN vn q ON q.kind = 'q' AND q.id = item_id LEFT JOIN vn d ON d.kind = 'd' AND d.id = doc_id),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM vs) WHERE rank <= 50)"""
FUSED = """fu AS (SELECT item_id, doc_id, coalesce(1.0 / (60 + d.rank), 0) AS a, coalesce(1.0 / (60 + s.rank), 0) AS b, d.rank AS dense_rank, s.rank AS sparse_rank FROM o d FULL JOIN s USING (item_id, doc_id)),
fr2 AS (SELECT item_id, doc_id, round((a::DOUBLE + b::DOUBLE), 9) AS score, dense_rank, sparse_rank FROM fu),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST)::INTEGER AS rank FROM fr2) WHERE rank <= 10)"""
HYBRID = f"{BASE}, {NEAREST}, {hits_sql('script', 50, 's')}, {FUSED.replace('1.0', '1e0')}"


def encoded_hits(spark, sf_dir, k):
    """Vector hits of benchmark items among documents, both encoded alike; by whole counts, so that ties are ties."""
    vectors = lambda name, key: encode.embed(spread(table(spark, sf_dir, name)).select(F.col(key).alias("id"), "text"), "id", "text", encode.counted)
    return dense.search(vectors("benchmark", "item_id"), vectors("documents", "doc_id"), "id", "embedding", k, encode.cosine)


def hybrid_hits(spark, sf_dir):
    """The vector list and the lexical list of each item, fused."""
    return fuse.reciprocal_rank(encoded_hits(spark, sf_dir, 50), bm25_hits(spark, sf_dir, 50))


@query("encoded_topk", f"WITH {TOK}, {NEAREST} SELECT item_id, doc_id, score, rank FROM o WHERE rank <= 10")
def encoded_topk(spark, sf_dir):
    return encoded_hits(spark, sf_dir, 10).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query("bm25_index", f"WITH {BASE}, {hits_sql('okapi', 10, 'h')} SELECT item_id, doc_id, score, rank FROM h")
def bm25_index(spark, sf_dir):
    """The Okapi variant over an index that is written and read again."""
    path = scratch(spark, "index")
    docs = spread(table(spark, sf_dir, "documents"))
    bm25.build_index(docs, "text", path)
    out = bm25.search(table(spark, sf_dir, "benchmark"), docs, "item_id", "text", "doc_id", "text", 10, True, bm25.load_index(spark, path))
    return out.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


@query("rrf_fusion", f"WITH {HYBRID} SELECT item_id, doc_id, score, dense_rank, sparse_rank, rank FROM f")
def rrf_fusion(spark, sf_dir):
    return hybrid_hits(spark, sf_dir).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "dense_rank", "sparse_rank", "rank")


GOLD = "gold AS (SELECT item_id, doc_id, lang FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def gold_pairs(spark, sf_dir, width: int = 8) -> DataFrame:
    """(query, doc, lang): documents that contain an item's whole text, found by its inner words, then verified.

    An item's first and last word may be parts of a document's words, those between are whole; the first ``width``
    of them are the key.  Items without inner words are looked for in every document.
    """
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("item"), split(F.col("text")).alias("w")).filter("item IS NOT NULL")
    items = items.select("query", "item", F.filter("w", lambda _, i: (i > 0) & (i < F.size("w") - 1) & (i <= width)).alias("inner"))
    items = items.select("query", "item", F.size("inner").alias("n"), F.xxhash64("inner").alias("key"))
    # lengths of keys: at most width numbers
    sizes = sorted(r["n"] for r in items.filter("n > 0").select("n").distinct().collect())
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("doc"), "lang", "text", split(F.col("text")).alias("w"))
    keys = F.array(*(F.when(F.col("i") + n - 1 <= F.size("w"), F.xxhash64(F.slice("w", F.col("i"), n))) for n in sizes)).cast("array<bigint>")
    at = docs.filter(F.size("w") > 0).select("doc", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i")).select("doc", F.explode(keys).alias("key")).filter("key IS NOT NULL")
    found = at.join(items.filter("n > 0").select("query", "item", "key"), "key").select("doc", "query", "item").distinct()
    found = found.join(docs.select("doc", "lang", "text"), "doc").filter(F.contains("text", F.col("item"))).select("query", "doc", "lang")
    brief = docs.select("doc", "lang", "text").join(items.filter("n = 0").select("query", "item"), F.contains("text", F.col("item"))).select("query", "doc", "lang")
    return found.unionByName(brief)


@query("gold_pairs", f"WITH {GOLD} SELECT item_id, doc_id, lang FROM gold")
def gold_pairs_query(spark, sf_dir):
    return gold_pairs(spark, sf_dir).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "lang")


PERQ = """gn AS (SELECT item_id, count(*) AS n FROM gold GROUP BY item_id),
hg AS (SELECT f.item_id, f.rank FROM f JOIN gold USING (item_id, doc_id)),
ag AS (SELECT item_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM hg GROUP BY item_id),
pq AS (SELECT b.item_id, coalesce(n, 0)::BIGINT AS n_gold, round(coalesce(h5 / n, 0), 6) AS recall_5, round(coalesce(h10 / n, 0), 6) AS recall_10, round(coalesce(1 / first, 0), 6) AS mrr_10,
       round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg_10
       FROM benchmark b LEFT JOIN gn USING (item_id) LEFT JOIN ag USING (item_id))"""


def run_metrics(spark, sf_dir, hits):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    return evaluate.per_query(hits, gold_pairs(spark, sf_dir), items)


@query("eval_recall_mrr_ndcg", f"WITH {HYBRID}, {GOLD}, {PERQ} SELECT item_id, n_gold, recall_5, recall_10, mrr_10, ndcg_10 FROM pq")
def eval_per_query(spark, sf_dir):
    return run_metrics(spark, sf_dir, hybrid_hits(spark, sf_dir)).withColumnRenamed("query", "item_id")


MEANS = "count(*)::BIGINT AS n, " + ", ".join(f"coalesce(round(avg({m}) + {evaluate.TIE}, 6), 0) AS {m}" for m in evaluate.METRICS)


@query("hybrid_eval_report", f"WITH {HYBRID}, {GOLD}, {PERQ} SELECT {MEANS} FROM pq")
def hybrid_eval_report(spark, sf_dir):
    return evaluate.means(run_metrics(spark, sf_dir, hybrid_hits(spark, sf_dir)))


TAG = "tg AS (SELECT pq.*, CASE WHEN item_id % 4 = 0 THEN 'pre_2026_reform' ELSE 'regime_neutral' END AS regime, CASE item_id % 3 WHEN 0 THEN 'homebuyer' WHEN 1 THEN 'investor' ELSE 'researcher' END AS persona FROM pq)"


def tagged(rows: DataFrame) -> DataFrame:
    """Every query with a regime and a persona by its id, as the tables have none."""
    persona = F.when(F.col("query") % 3 == 0, "homebuyer").when(F.col("query") % 3 == 1, "investor").otherwise("researcher")
    return rows.withColumn("regime", F.when(F.col("query") % 4 == 0, "pre_2026_reform").otherwise("regime_neutral")).withColumn("persona", persona)


@query(
    "eval_grouping_sets",
    f"""WITH {HYBRID}, {GOLD}, {PERQ}, {TAG}, g AS (SELECT *, regime <> 'pre_2026_reform' AS headline FROM tg)
SELECT 'overall' AS slice, 'all' AS value, {MEANS} FROM g UNION ALL SELECT 'headline', CASE WHEN headline THEN 'true' ELSE 'false' END, {MEANS} FROM g GROUP BY headline
UNION ALL SELECT 'regime', regime, {MEANS} FROM g GROUP BY regime UNION ALL SELECT 'persona', persona, {MEANS} FROM g WHERE headline GROUP BY persona""",
)
def eval_grouping_sets(spark, sf_dir):
    """Overall, headline, regime and (headline rows only) persona means from one pass of grouping sets."""
    rows = tagged(run_metrics(spark, sf_dir, hybrid_hits(spark, sf_dir))).withColumn("headline", F.col("regime") != "pre_2026_reform")
    sets = [[], [F.col("headline")], [F.col("regime")], [F.col("headline"), F.col("persona")]]
    out = rows.groupingSets(sets, "headline", "regime", "persona").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *(F.coalesce(evaluate.mean(m), F.lit(0.0)).alias(m) for m in evaluate.METRICS))
    # bits, high to low: headline, regime, persona rolled up
    out = out.filter((F.col("gid") != 0b010) | F.col("headline"))
    kind = F.when(F.col("gid") == 0b111, "overall").when(F.col("gid") == 0b011, "headline").when(F.col("gid") == 0b101, "regime").otherwise("persona")
    value = F.when(F.col("gid") == 0b111, "all").when(F.col("gid") == 0b011, F.col("headline").cast("string")).when(F.col("gid") == 0b101, F.col("regime")).otherwise(F.col("persona"))
    return out.select(kind.alias("slice"), value.alias("value"), "n", *evaluate.METRICS)


@query(
    "recall_curve",
    f"""WITH {HYBRID}, {GOLD}, gn AS (SELECT item_id, count(*) AS n FROM gold GROUP BY item_id), hg AS (SELECT f.item_id, f.rank FROM f JOIN gold USING (item_id, doc_id)),
g AS (SELECT item_id, n, unnest(range(1, 11))::INTEGER AS k FROM gn)
SELECT k, round(avg((SELECT count(*) FROM hg WHERE hg.item_id = g.item_id AND hg.rank <= g.k) / n), 6) AS recall FROM g GROUP BY k""",
)
def recall_curve(spark, sf_dir):
    return evaluate.recall_curve(hybrid_hits(spark, sf_dir), gold_pairs(spark, sf_dir))


@query(
    "latency_stats",
    """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n)::BIGINT AS n, round(avg(v), 6) AS mean_ms, max(v) FILTER (i = n // 2) AS median_ms, max(v) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95_ms, max(v) AS max_ms FROM r GROUP BY event_type""",
)
def latency_stats(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), "value", "event_type")


# --- comparing runs ------------------------------------------------------------------------------

TWO = f"""{BASE}, {hits_sql('okapi', 10, 'o')}, {hits_sql('script', 10, 's')}, {GOLD},
pa AS (SELECT item_id, doc_id, rank FROM o), pb AS (SELECT item_id, doc_id, rank FROM s), gn AS (SELECT item_id, count(*) AS n FROM gold GROUP BY item_id),
ma AS (SELECT b.item_id, coalesce(1 / min(pa.rank), 0) AS m FROM benchmark b LEFT JOIN (pa JOIN gold USING (item_id, doc_id)) pa ON pa.item_id = b.item_id GROUP BY b.item_id),
mb AS (SELECT b.item_id, coalesce(1 / min(pb.rank), 0) AS m FROM benchmark b LEFT JOIN (pb JOIN gold USING (item_id, doc_id)) pb ON pb.item_id = b.item_id GROUP BY b.item_id),
dd AS (SELECT item_id, round(ma.m, 6) AS base, round(mb.m, 6) AS other, round(round(mb.m, 6) - round(ma.m, 6), 6) + 0.0 AS delta, CASE item_id % 3 WHEN 0 THEN 'homebuyer' WHEN 1 THEN 'investor' ELSE 'researcher' END AS persona FROM ma JOIN mb USING (item_id))"""


def two_runs(spark, sf_dir) -> DataFrame:
    """(query, persona, base, other, delta): MRR of two runs; both must have the same queries."""
    from marlstone.operators.compare import paired

    a = run_metrics(spark, sf_dir, bm25_hits(spark, sf_dir, 10, True)).select("query", "mrr_10")
    b = run_metrics(spark, sf_dir, bm25_hits(spark, sf_dir, 10)).select("query", "mrr_10")
    return tagged(paired(a, b, "query", "mrr_10")).drop("regime")


@query("run_deltas", f"WITH {TWO} SELECT item_id, persona, base, other, delta FROM dd")
def run_deltas(spark, sf_dir):
    return two_runs(spark, sf_dir).select(F.col("query").alias("item_id"), "persona", "base", "other", "delta")


@query("run_compare_wtl", f"WITH {TWO} SELECT persona, count(*) FILTER (delta > 1e-9)::BIGINT AS win, count(*) FILTER (abs(delta) <= 1e-9)::BIGINT AS tie, count(*) FILTER (delta < -1e-9)::BIGINT AS loss, round(avg(delta) + {evaluate.TIE}, 6) + 0.0 AS mean_delta FROM dd GROUP BY persona")
def run_compare_wtl(spark, sf_dir):
    from marlstone.operators.compare import wins

    return wins(two_runs(spark, sf_dir), "persona")


@query(
    "top_wins_losses",
    f"""WITH {TWO}, r AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY delta DESC, item_id) AS w, row_number() OVER (PARTITION BY persona ORDER BY delta, item_id) AS l FROM dd)
SELECT persona, 'win' AS kind, w::INTEGER AS place, item_id, delta FROM r WHERE w <= 3 UNION ALL SELECT persona, 'loss', l::INTEGER, item_id, delta FROM r WHERE l <= 3""",
)
def top_wins_losses(spark, sf_dir):
    from marlstone.operators.compare import extremes

    return extremes(two_runs(spark, sf_dir), "persona", 3).withColumnRenamed("query", "item_id")


@query("biggest_lift", f"WITH {TWO}, m AS (SELECT persona, round(avg(delta) + {evaluate.TIE}, 6) + 0.0 AS lift FROM dd GROUP BY persona) SELECT persona, lift FROM m ORDER BY lift DESC, persona LIMIT 1")
def biggest_lift(spark, sf_dir):
    m = two_runs(spark, sf_dir).groupBy("persona").agg((evaluate.mean("delta") + 0.0).alias("lift"))
    return m.agg(F.min_by("persona", F.struct((-F.col("lift")).alias("l"), "persona")).alias("persona"), F.max("lift").alias("lift"))


@query(
    "best_per_metric",
    f"""WITH {TWO}, v AS (SELECT 'okapi' AS variant, round(avg(base) + {evaluate.TIE}, 6) AS mrr_10 FROM dd UNION ALL SELECT 'script', round(avg(other) + {evaluate.TIE}, 6) FROM dd)
SELECT variant, mrr_10, mrr_10 >= max(mrr_10) OVER () - 1e-9 AS best, round(mrr_10 - first_value(mrr_10) OVER (ORDER BY variant), 6) + 0.0 AS delta_first FROM v""",
)
def best_per_metric(spark, sf_dir):
    """Variants with the best marked (ties all), and the change from the first."""
    d = two_runs(spark, sf_dir).agg(evaluate.mean("base").alias("okapi"), evaluate.mean("other").alias("script"))
    v = d.select(F.expr("stack(2, 'okapi', okapi, 'script', script) AS (variant, mrr_10)"), F.greatest("okapi", "script").alias("top"), F.col("okapi").alias("first"))
    return v.select("variant", "mrr_10", (F.col("mrr_10") >= F.col("top") - 1e-9).alias("best"), (F.round(F.col("mrr_10") - F.col("first"), 6) + 0.0).alias("delta_first"))


# --- re-ranking ----------------------------------------------------------------------------------

BOOSTS = [("src0", 1.2), ("src3", 1.15), ("src5", 0.9), ("src13", 0.95)]


@query(
    "publisher_boost_rerank",
    f"""WITH {BASE}, {hits_sql('script', 50, 's')}, bo(source, boost) AS (VALUES {", ".join(f"('{a}', {b})" for a, b in BOOSTS)}),
h AS (SELECT item_id, doc_id, score, rank, item_id % 5 = 0 AS neutral, floor(score * coalesce(boost::DOUBLE, 1) * 1000000 + 0.5) / 1000000 AS bs FROM s JOIN documents USING (doc_id) LEFT JOIN bo USING (source)),
r AS (SELECT *, CASE WHEN neutral THEN score ELSE bs END AS boosted, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN neutral THEN 0 ELSE bs END DESC, rank)::INTEGER AS new_rank FROM h)
SELECT item_id, doc_id, boosted, new_rank FROM r WHERE new_rank <= 8""",
)
def publisher_boost_rerank(spark, sf_dir):
    """Scores times the source's boost, eight a query; queries of the general persona keep their order."""
    boosts = spark.createDataFrame(BOOSTS, "source string, boost double")
    hits = bm25_hits(spark, sf_dir, 50).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    out = fuse.boosted(hits, boosts, "source", 8, F.col("query") % 5 == 0)
    return out.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "boosted", "new_rank")


@query(
    "rerank_shortlist",
    f"""WITH {BASE}, {hits_sql('script', 30, 's')}, bt AS (SELECT item_id, list_distinct({terms_sql('text')}) AS q FROM benchmark), dt AS (SELECT doc_id, list_distinct(w) AS d FROM tok),
c AS (SELECT item_id, doc_id, rank, round(len(list_intersect(q, d)) / len(q), 6) AS rerank_score FROM s JOIN bt USING (item_id) JOIN dt USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank)::INTEGER AS new_rank FROM c)
SELECT item_id, doc_id, rerank_score, new_rank FROM r WHERE new_rank <= 5""",
)
def rerank_shortlist(spark, sf_dir):
    """The default cross-encoder stand-in: the share of the query's terms that the document has."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(X.terms(F.col("text"))).alias("q"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array_distinct(X.terms(F.col("text"))).alias("d"))
    hits = bm25_hits(spark, sf_dir, 30).join(q, "query").join(d, "doc")
    out = fuse.rerank(hits, F.round(F.size(F.array_intersect("q", "d")) / F.size("q"), 6))
    return out.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rerank_score", "new_rank")


@query(
    "dedupe_cap",
    """WITH k AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '' ELSE role END AS key FROM conversations),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) AS n FROM k) WHERE n = 1 OR key = ''),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS place FROM d) SELECT conv_id, turn, key, place FROM c WHERE place <= 8""",
)
def dedupe_cap(spark, sf_dir):
    """First of each key in order, rows of an empty key all, eight a conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 7 == 6, "").otherwise(F.col("role")).alias("key"))
    out = fuse.first_of_each(rows, "key", "turn", "conv_id")
    return out.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))).filter("place <= 8")


@query("url_dedupe", "SELECT page_id, u AS url FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def url_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"))
    return rows.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id", "url")
