"""Queries of the sources: files are written from the tables in each format, and read back by the library's readers."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import keys
from marlstone.plans.corpus import UUID
from marlstone.plans.registry import query
from marlstone.sources import tables
from marlstone.sources.tables import scratch, table

LINES = """SELECT item_id, text, CASE WHEN item_id % 7 = 0 THEN '  ' WHEN item_id % 5 = 0 THEN '{broken' WHEN item_id % 3 = 0 THEN '{"item_id": 1}' END AS odd FROM benchmark"""


def _jsonl(spark, sf_dir):
    path = scratch(spark, "lines")
    line = F.when(F.col("item_id") % 7 == 0, "  ").when(F.col("item_id") % 5 == 0, "{broken").when(F.col("item_id") % 3 == 0, '{"item_id": 1}').otherwise(F.to_json(F.struct("item_id", "text")))
    table(spark, sf_dir, "benchmark").select(line.alias("value")).write.text(path)
    return tables.jsonl(spark, path, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]), ("item_id", "text"))


@query("jsonl_rows", f"SELECT item_id, text FROM ({LINES}) WHERE odd IS NULL")
def jsonl_rows(spark, sf_dir):
    """JSON lines: blank ones are skipped, broken ones and those without a required key are rejects."""
    return _jsonl(spark, sf_dir)[0]


@query("jsonl_rejects", f"SELECT odd AS value, count(*)::BIGINT AS n FROM ({LINES}) WHERE trim(odd) <> '' GROUP BY odd")
def jsonl_rejects(spark, sf_dir):
    return _jsonl(spark, sf_dir)[1].groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("jsonl_sink", "SELECT doc_id, text, lang FROM documents")
def jsonl_sink(spark, sf_dir):
    """Documents written as JSON lines and read again."""
    path = scratch(spark, "sink")
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    tables.write_jsonl(df, path)
    return spark.read.schema(df.schema).json(path)


@query("file_discovery", "SELECT 'r' || n_regionkey AS folder, n_name AS text FROM nation WHERE n_regionkey <> 0")
def file_discovery(spark, sf_dir):
    """Text files below a folder, one row a file, without the folders to skip."""
    path = scratch(spark, "tree")
    table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("d"), F.col("n_name").alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("d").text(path)
    rows = tables.whole_files(spark, path, "*.txt", skip=("d=r0",))
    return rows.select(F.regexp_extract("path", "/d=([^/]*)/", 1).alias("folder"), F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


DAY = "DATE '2020-01-31' + (n_nationkey * 40)::INTEGER"


def _day(fmt):
    return F.date_format(F.date_add(F.lit("2020-01-31").cast("date"), F.col("n_nationkey") * 40), fmt)


@query("dated_csv", f"SELECT {DAY} AS period_end, 1000.5 + n_nationkey AS value FROM nation WHERE n_nationkey % 6 <> 5".replace("1000.5", "1000.5::DOUBLE"))
def dated_csv(spark, sf_dir):
    """A series below other lines, in four date formats, with quoted cells and thousands separators."""
    path, k = scratch(spark, "series"), F.col("n_nationkey")
    day = F.when(k % 4 == 0, _day("dd-MMM-yy")).when(k % 4 == 1, _day("dd-MMM-yyyy")).when(k % 4 == 2, _day("dd/MM/yyyy")).otherwise(_day("yyyy-MM-dd"))
    value = F.when(k % 6 == 5, "n.a.").when(k % 2 == 0, F.concat(F.lit('"'), F.format_number(k + 1000.5, 1), F.lit('"'))).otherwise((k + 1000.5).cast("string"))
    rows = table(spark, sf_dir, "nation").select(F.concat_ws(",", day, value).alias("value"))
    rows.unionByName(spark.createDataFrame([("Title,\"a, b\"",), ("Units,%",), ("",)], "value string")).write.text(path)
    return tables.dated_csv(spark, path)


@query("wide_csv", f"SELECT s.id AS series_id, {DAY} AS period_end, n_nationkey * s.k AS value FROM nation, (VALUES ('S1', 1.5::DOUBLE), ('S3', 3.5::DOUBLE)) s(id, k) WHERE NOT (s.id = 'S3' AND n_nationkey % 3 = 0)")
def wide_csv(spark, sf_dir):
    """Chosen columns of a wide file whose header row is found by its first cell."""
    path, k = scratch(spark, "wide"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.concat_ws(",", _day("dd-MMM-yyyy"), (k * 1.5).cast("string"), F.lit("2.5"), F.when(k % 3 == 0, "").otherwise((k * 3.5).cast("string"))).alias("value"))
    rows.unionByName(spark.createDataFrame([('Title,"One, with a comma",Two,Three',), ("Series ID,S1,S2,S3",)], "value string")).write.text(path)
    return tables.wide_csv(spark, path, ["S1", "S3"])


def _npy(batches):
    import pandas as pd

    for f in batches:
        for shard, vectors in zip(f["shard"], f["m"], strict=True):
            out = io.BytesIO()
            np.save(out, np.stack([np.asarray(v, np.float32) for v in vectors]))
            yield pd.DataFrame({"shard": [shard], "content": [out.getvalue()]})


@query("npy_vectors", "SELECT 'v' || vec_id AS key, round(embedding[1], 4)::DOUBLE + 0.0 AS first FROM embeddings")
def npy_vectors(spark, sf_dir):
    """Matrices of 100 vectors with a sidecar of keys each, zipped by place."""
    path = scratch(spark, "npy")
    e = table(spark, sf_dir, "embeddings").withColumn("shard", F.floor(F.col("vec_id") / 100).cast("string"))
    e = e.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("l"))
    files = e.select("shard", F.transform("l", lambda x: x["embedding"]).alias("m")).mapInPandas(_npy, "shard string, content binary")
    names = e.select("shard", F.array_join(F.transform("l", lambda x: F.concat(F.lit("v"), x["vec_id"].cast("string"))), "\n").alias("keys"))
    tables.write_files(files.select(F.concat("shard", F.lit(".npy")).alias("name"), "content").unionByName(names.select(F.concat("shard", F.lit(".keys")).alias("name"), F.col("keys").cast("binary").alias("content"))), path)
    return tables.npy_vectors(spark, path).select("key", (F.round(F.col("embedding")[0].cast("float"), 4).cast("double") + 0.0).alias("first"))


@query("metric_curves", "SELECT n_regionkey AS epoch, n_nationkey AS steps, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS map, n_nationkey / 8 AS mrr_at_10, 0::DOUBLE AS ndcg_at_10 FROM nation")
def metric_curves(spark, sf_dir):
    """Curves of the first metrics file by name: blanks and missing columns are 0."""
    path, k = scratch(spark, "metrics"), F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.concat_ws(",", F.concat(F.col("n_regionkey").cast("string"), F.lit(".0")), k.cast("string"), F.when(k % 2 == 0, "0.5").otherwise(""), (k / 8).cast("string")).alias("l"))
    text = rows.agg(F.concat(F.lit("epoch,steps,MAP,MRR@10\n"), F.array_join(F.collect_list("l"), "\n"), F.lit("\n")).alias("t"))  # a small file, made in one piece
    files = text.select(F.lit("dev_results_a.csv").alias("name"), F.col("t").cast("binary").alias("content"))
    tables.write_files(files.unionByName(files.select(F.lit("dev_results_b.csv").alias("name"), F.lit("epoch,steps\n9,9\n").cast("binary").alias("content"))), path)
    return tables.metric_curves(spark, path, "dev_results*.csv")


@query("available_sources", "SELECT 'nation' AS origin, n_name AS name FROM nation UNION ALL SELECT 'region', r_name FROM region")
def available_sources(spark, sf_dir):
    """The union of sources of which one does not open."""
    gone = scratch(spark, "nowhere")
    out, failed = tables.union_available({
        "nation": lambda: table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")),
        "gone": lambda: spark.read.parquet(gone).select("name"),
        "region": lambda: table(spark, sf_dir, "region").select(F.col("r_name").alias("name")),
    })
    if list(failed) != ["gone"]:
        raise ValueError(f"other sources failed: {failed}")
    return out.select("origin", "name")


@query("sitemap_urls", "WITH u AS (SELECT DISTINCT 'https://x.example/' || CASE page_id % 3 WHEN 0 THEN 'housing-supply' WHEN 1 THEN 'annual_report' ELSE 'rent-review' END || '-' || (page_id % 40) || '.html' AS url, page_id % 3 AS k, page_id % 40 AS n FROM pages) SELECT url, CASE k WHEN 0 THEN 'Housing Supply ' ELSE 'Rent Review ' END || n AS title FROM u WHERE k <> 1")
def sitemap_urls(spark, sf_dir):
    """Locations of sitemaps, once each, whose title from the address is about housing."""
    k = F.col("page_id") % 3
    slug = F.when(k == 0, "housing-supply").when(k == 1, "annual_report").otherwise("rent-review")
    loc = F.concat(F.lit("<url><loc> https://x.example/"), slug, F.lit("-"), (F.col("page_id") % 40).cast("string"), F.lit(".html</loc></url>"))
    maps = table(spark, sf_dir, "pages").groupBy((F.floor(F.col("page_id") / 500)).alias("map")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml"))
    return tables.sitemap(maps)


@query("idempotent_append", "SELECT doc_id, lang FROM documents")
def idempotent_append(spark, sf_dir):
    """Two overlapping appends leave each key once."""
    path = scratch(spark, "append")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    tables.append_new(d.filter("doc_id % 2 = 0"), path, "doc_id")
    tables.append_new(d, path, "doc_id")
    return spark.read.parquet(path)


@query("vector_points", "WITH x AS (SELECT vec_id, label, len(embedding)::BIGINT AS dims, sha1(unhex('" + keys.URL_SPACE + "') || ('v' || vec_id::VARCHAR)::BLOB) AS h FROM embeddings) SELECT vec_id, label, dims, " + UUID + " AS id FROM x")
def vector_points(spark, sf_dir):
    """Points with deterministic ids, written anew and then upserted with an overlap: each once, and all counted."""
    path = scratch(spark, "points")
    p = table(spark, sf_dir, "embeddings").select(keys.uuid5(F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("id"), "vec_id", "label", F.size("embedding").cast("long").alias("dims"))
    tables.upsert(p.filter("vec_id % 3 = 0"), path, "id", recreate=True)
    tables.upsert(p, path, "id")
    return spark.read.parquet(path).select("vec_id", "label", "dims", "id")
