"""Small literal inputs for the operators that queries only meet on large ones."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import agents, bm25, compare, corpus, evaluate, fuse, mining, series
from marlstone.sources import tables
from marlstone.streaming import cache, events


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_metrics(spark):
    hits = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(["x", "g1", "y", "g2"])], "query int, doc string, rank int")
    gold = spark.createDataFrame([(1, "g1"), (1, "g2")], "query int, doc string")
    q = spark.createDataFrame([(1,), (2,)], "query int")
    got = {r["query"]: r for r in evaluate.per_query(hits, gold, q).collect()}
    assert (got[1].recall_5, got[1].mrr_10, got[1].ndcg_10) == (1.0, 0.5, 0.650921)
    assert (got[2].n_gold, got[2].recall_5, got[2].mrr_10, got[2].ndcg_10) == (0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(("values", "median", "p95"), [([10, 20, 30, 40], 30, 40), (list(range(31)), 15, 28)])
def test_latency(spark, values, median, p95):
    r = evaluate.latency(spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("g", F.lit(1)), "v", "g").first()
    assert (r.median_ms, r.p95_ms) == (median, p95)


def test_fusion(spark):
    lists = lambda names: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(names)], "query int, doc string, rank int")
    out = {r.doc: r for r in fuse.reciprocal_rank(lists("ab"), lists("bc")).collect()}
    assert [round(out[d].score, 6) for d in "bac"] == [0.032522, 0.016393, 0.016129]
    tie = {r.doc: r["rank"] for r in fuse.reciprocal_rank(lists("x"), lists("y")).collect()}
    assert tie == {"x": 1, "y": 2}


def test_first_of_each_keeps_empty_keys(spark):
    df = spark.createDataFrame([(0, "c0"), (1, "c1"), (2, "c0"), (3, ""), (4, ""), (5, "c2")], "pos int, id string")
    assert rows(fuse.first_of_each(df, "id", "pos"), "pos") == [(0,), (1,), (3,), (4,), (5,)]


def test_idf(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "df int")
    got = df.orderBy("df").select(F.round(bm25.idf_script(F.lit(3), F.col("df")), 6), F.round(bm25.idf_okapi(F.lit(3), F.col("df")), 6)).collect()
    assert [tuple(r) for r in got] == [(0.980829, 0.510826), (0.470004, -0.510826), (0.133531, -1.94591)]


def test_sets(spark):
    a = lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    r = spark.range(1).select(
        evaluate.jaccard(a(), a()).alias("j"), evaluate.tool_recall(a("a"), a()).alias("r"), evaluate.tool_recall(a(), a()).alias("e"), evaluate.tool_precision(a("a"), a()).alias("p"),
        F.round(evaluate.trajectory(F.lit(2), a("a", "b"), a("a")), 6).alias("t"), evaluate.publisher_recall(a(), a()).alias("u"),
    ).first()
    assert tuple(r) == (1.0, 0.0, 1.0, 0.0, 0.333333, 1.0)


def test_paired_runs_must_match(spark):
    one = spark.createDataFrame([(1, 0.5)], "query int, m double")
    two = spark.createDataFrame([(2, 0.5)], "query int, m double")
    with pytest.raises(Exception, match="only one run"):
        compare.paired(one, two, "query", "m").collect()


def test_lookup_of_a_missing_key(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="no row has the key 2"):
        mining.checked_lookup(left, right, "k").collect()


def test_as_of(spark):
    s = spark.createDataFrame([("s", "2024-01-31", 1.0), ("s", "2024-02-29", 2.0)], "k string, d string, value double").select("k", F.col("d").cast("date").alias("period_end"), "value")
    at = lambda d: [r.value for r in series.as_of_date(s, "k", F.lit(d).cast("date")).collect()]
    assert (at("2024-02-29"), at("2024-02-28"), at("2024-01-01")) == ([2.0], [1.0], [])


def test_pack():
    stream = [(["A"], "a b c"), (["A"], "d e"), (["B"], "f g h")]
    assert corpus.pack_paragraphs(stream, 3, 6, 2) == [(["A"], "a b c\n\nd e", 5), (["B"], "d e\n\nf g h", 5)]
    assert corpus.pack_paragraphs(stream, 3, 6, 4)[1] == (["B"], "f g h", 3)
    assert corpus.pack_paragraphs([([], "a b c d e f g")], 1, 3, 0) == [([], "a b c", 3), ([], "d e f", 3), ([], "g", 1)]
    assert corpus.pack_paragraphs([], 1, 3, 0) == []


def test_chunks_of_byte_pairs():
    import public_tokenizers as P

    codec = corpus.bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    encode, decode = codec()
    text = "Some words of a paragraph, <|endoftext|> and é too. " * 40
    chunks = corpus.pack_paragraphs([(["A"], text), (["B"], "short one"), (["C"], "another")], 20, 60, 10, codec)
    assert all(n == len(encode(t)) and n <= 80 for _, t, n in chunks)
    assert chunks[1][1].startswith(decode(encode(chunks[0][1])[-10:])) or len(encode(chunks[0][1])) + 10 > 60
    assert "another" in chunks[-1][1]


def test_markdown():
    page = "<html><head><title>T</title></head><body><nav>menu</nav><h2>H</h2><p>one <b>two</b></p><ul><li>x</li></ul><script>p</script></body></html>"
    assert corpus.markdown(page) == "# T\n\n## H\n\none two\n\n- x\n"
    assert corpus.markdown(None) == "\n"
    assert corpus.paragraph_stream("# A\np\n## B\nq\n\nr\n# C\ns\n#  \nt") == [(["A"], "p"), (["A", "B"], "q"), (["A", "B"], "r"), (["C"], "s"), (["C"], "t")]


def test_grounding():
    assert agents.grounded("4.10% [tool:t, retrieved:2026-04-26]") == (1.0, 1, 1)
    assert agents.grounded("17.4%" + " filler" * 40 + " [source:P]") == (0.0, 1, 0)
    assert agents.grounded("") == (1.0, 0, 0)


def test_citation_marks():
    out, n = agents.enforce("a [source: P, page: 2] b [source: Q] c [tool: t, retrieved: d]", {"P": {"1"}}, set())
    assert n == 3 and "[source: P, page: 2] (page-unverified)" in out and out.endswith("Sources (auto):\n- Documents: P")
    assert agents.renumbered("x [source: P] [tool: t, retrieved: d] [source: P]") == ("x [1] [2] [1]", 2)


def test_places():
    assert [p[1] for p in agents.places("Richmond median")] == ["Richmond"]
    assert agents.places("Richmond VIC median") == []


def test_cache_replay(spark):
    log = spark.createDataFrame([("k", t, t) for t in (0, 30, 59, 60, 100)], "key string, t long, id long")
    assert rows(cache.replay(log, "key", "t", "id", 60), "id", "outcome") == [(0, "miss"), (30, "hit"), (59, "hit"), (60, "evict"), (100, "hit")]


def test_cache_stream_equals_replay(spark, tmp_path):
    log = spark.createDataFrame([(f"k{i % 3}", i * 7 % 100, i) for i in range(60)], "key string, t long, id long")
    log.write.parquet(str(tmp_path / "in"))
    stream = cache.stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")), "key", "t", "id", 20)
    q = stream.writeStream.format("memory").queryName("cache_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("cache_out"), "id", "outcome") == rows(cache.replay(log, "key", "t", "id", 20), "id", "outcome")


def test_append_each_batch_twice(spark, tmp_path):
    pd.DataFrame({"event_id": [1, 2, 2], "v": [1, 2, 2]}).to_parquet(tmp_path / "a.parquet")
    src = lambda: spark.readStream.schema("event_id long, v long").parquet(str(tmp_path / "*.parquet"))
    for i in range(2):
        events.append_each_batch(src(), str(tmp_path / "out"), str(tmp_path / f"ck{i}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"title": "T", "publisher": "P", "url": "u"}\n\nnot json\n{"title": "x"}\n')
    good, bad = tables.jsonl(spark, str(tmp_path / "a.jsonl"), tables.SOURCE, ("title", "publisher", "url"))
    assert [r.title for r in good.collect()] == ["T"] and bad.count() == 2
    (tmp_path / "s.csv").write_text('Title,x\nnote\n"31-Jan-24",4.1\n29-Feb-2024,n/a\n2024-03-31,4.3\n')
    assert [(str(r.period_end), r.value) for r in tables.dated_csv(spark, str(tmp_path / "s.csv")).orderBy("period_end").collect()] == [("2024-01-31", 4.1), ("2024-03-31", 4.3)]
    (tmp_path / "w.csv").write_text("x,y,z\nSeries ID,A,B\n31/01/2024,1,2\n29/02/2024,,3\n")
    assert rows(tables.wide_csv(spark, str(tmp_path / "w.csv"), ["A", "B"]), "series_id", "value") == [("A", 1.0), ("B", 2.0), ("B", 3.0)]
    (tmp_path / "md" / "eval").mkdir(parents=True)
    (tmp_path / "md" / "a.md").write_text("x\ny")
    (tmp_path / "md" / "eval" / "b.md").write_text("z")
    assert [r.text for r in tables.whole_files(spark, str(tmp_path / "md")).collect()] == ["x\ny"]
    xml = spark.createDataFrame([("<loc>https://a/b/rental-home</loc><loc>https://a/other</loc>",)], "xml string")
    assert rows(tables.sitemap(xml), "url", "title") == [("https://a/b/rental-home", "Rental Home")]


def test_gold_pairs_are_all_that_contain_an_item(spark, tmp_path):
    from marlstone.plans import retrieval

    items = ["two words", "one", "just three words", "one of seven words in a row", "art of a longer item with more than eight words in i", None]
    texts = ["has two words", "twotwo wordsy", "one", "adjust three wordsmiths", "x one of seven words in a row.", "part of a longer item with more than eight words in it", "nothing", None, ""]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.query, r.doc) for r in retrieval.gold_pairs(spark, str(tmp_path)).collect())
    assert got == sorted((i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if x is not None and t is not None and x in t)


def test_shared_folder_is_not_guessed_on_a_cluster():
    from types import SimpleNamespace as O

    from marlstone.sources.tables import shared_root

    session = lambda master, root=None: O(conf=O(get=lambda k, default=None: root or default), sparkContext=O(master=master))
    assert shared_root(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_root(session("local[4]")).startswith("/tmp/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(session("spark://host:7077"))
