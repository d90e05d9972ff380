"""Reading and writing: tables, line-delimited JSON, published series, pages, sitemaps and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.dates import loose_date
from marlstone.functions.text import about_housing, title_of_url

SOURCE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "publisher", "url", "date", "category")] + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])
CHUNK = T.StructType([T.StructField(n, T.StringType()) for n in ("chunk_id", "publisher", "title", "date", "url", "source", "section_heading")] + [T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("token_count", T.IntegerType())])
PAYLOAD = ["chunk_id", "publisher", "title", "date", "url", "source", "section_heading", "page", "text", "token_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the session's cluster shares (``spark.checkpoint.dir``).

    A session of one machine that names none, as in tests, takes one below /tmp; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "/tmp/marlstone-checkpoint"
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/marlstone-{uuid.uuid4().hex}/{name}"


def spread(df: DataFrame, each: int = 1 << 20) -> DataFrame:
    """A scan of too few splits for the session's cores, dealt out to them, a piece of ``each`` bytes at least to each.

    Small files of one row group are read by one task, which leaves the other cores idle in what follows.
    A large scan has more splits than cores and is left alone.  What is dealt out is put in order, so that a
    task that is run again sees its rows as before.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(df.sparkSession.sparkContext.defaultParallelism, size // each)
    if df.rdd.getNumPartitions() >= n:
        return df
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.repartition(n).sortWithinPartitions(*(F.col(f"`{c}`") for c in plain))


def jsonl(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): blank lines are skipped; lines that are no JSON or lack a required key are rejects."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    row = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    both = lines.select("value", row.alias("r"))
    ok = F.col("r._bad").isNull()
    for k in required:
        ok = ok & F.col(f"r.{k}").isNotNull()
    return both.filter(ok).select(*(F.col(f"r.{f.name}") for f in schema.fields)), both.filter(~ok).select("value")


def whole_files(spark: SparkSession, folder: str, glob: str = "*.md", skip: tuple[str, ...] = ("eval", "training")) -> DataFrame:
    """(path, text) of each file below a folder, without the folders to skip."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for s in skip:
        rows = rows.filter(~F.contains("path", F.lit(f"/{s}/")))
    return rows


def cells(line: Column) -> Column:
    """The cells of a CSV line, trimmed and unquoted; commas inside quotes do not part cells."""
    bare = F.transform(F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.trim(c))
    return F.transform(bare, lambda c: F.when(c.rlike('(?s)^".*"$'), F.trim(F.replace(F.regexp_replace(c, '(?s)^"|"$', ""), F.lit('""'), F.lit('"')))).otherwise(c))


def number(text: Column) -> Column:
    """A number with or without thousands separators, else null."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def dated_csv(spark: SparkSession, path: str) -> DataFrame:
    """(period_end, value) of a two-column series whose file starts with other lines: rows whose cells parse."""
    c = spark.read.text(path).select(cells(F.col("value")).alias("c"))
    rows = c.select(loose_date(F.get("c", F.lit(0))).alias("period_end"), number(F.get("c", F.lit(1))).alias("value"))
    return rows.filter("period_end IS NOT NULL AND value IS NOT NULL")


def wide_csv(spark: SparkSession, path: str, series: list[str], header: str = "Series ID") -> DataFrame:
    """(series_id, period_end, value) of chosen columns of a wide file, whose header row is the one that starts with ``header``."""
    c = spark.read.text(path).select(cells(F.col("value")).alias("c"))
    names = c.filter(F.get("c", F.lit(0)) == header).limit(1).select(F.col("c").alias("ids"))  # one row
    rows = c.join(F.broadcast(names), how="cross").select(loose_date(F.get("c", F.lit(0))).alias("period_end"), F.explode(F.arrays_zip("ids", "c")).alias("x"))
    rows = rows.filter(F.col("period_end").isNotNull() & F.col("x.ids").isin(series))
    return rows.select(F.col("x.ids").alias("series_id"), "period_end", number(F.col("x.c")).alias("value")).filter("value IS NOT NULL")


def npy_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, pos, key, embedding) of ``x.npy`` matrices zipped by place with the lines of ``x.keys``; unequal lengths are an error.

    A shard is read by one task, so a large set is kept as many shards.
    """
    import io

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                stem = path.rsplit("/", 1)[-1].removesuffix(".npy")
                yield pd.DataFrame({"shard": stem, "pos": range(len(m)), "embedding": [x.astype(np.float64) for x in m]})

    m = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content").mapInPandas(rows, "shard string, pos long, embedding array<double>")
    keys = spark.read.option("pathGlobFilter", "*.keys").text(folder, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)\.keys$", 1).alias("shard")
    keys = keys.select(stem, F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("pos", "key"))
    both = m.join(keys.withColumn("pos", F.col("pos").cast("long")), ["shard", "pos"], "full")
    whole = F.col("key").isNotNull() & F.col("embedding").isNotNull()
    told = F.when(whole, F.col("shard")).otherwise(F.raise_error(F.concat(F.lit("vectors and keys differ in number: "), "shard")).cast("string"))
    return both.select(told.alias("shard"), "pos", "key", "embedding")


def metric_curves(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(epoch, steps, map, mrr_at_10, ndcg_at_10) of the first file, by name, that fits; blanks are 0; no file gives no rows."""
    kinds = {"epoch": ("epoch", "double", "int"), "steps": ("steps", "int", "int"), "MAP": ("map", "double", "double"), "MRR@10": ("mrr_at_10", "double", "double"), "NDCG@10": ("ndcg_at_10", "double", "double")}
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).agg(F.min("path").alias("p")).first()["p"]
    if found is None:
        return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, _, k in kinds.values()))
    rows = spark.read.option("header", True).csv(found)
    value = lambda c, kind: F.coalesce(F.col(f"`{c}`").try_cast(kind), F.lit(0).cast(kind)) if c in rows.columns else F.lit(0).cast(kind)
    return rows.select(*(value(c, read).cast(kind).alias(name) for c, (name, read, kind) in kinds.items()))


def union_available(readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(union by name of the sources that open, why the others do not): a failing source contributes nothing."""
    out, failed = None, {}
    for name, read in readers.items():
        try:
            df = read().withColumn("origin", F.lit(name))
            df.schema  # noqa: B018  a path that is not there shows here, not while the union runs
        except Exception as error:  # told to the caller, by source
            failed[name] = str(error).split("\n")[0]
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed


def upsert(df: DataFrame, path: str, key: str, recreate: bool = False) -> int:
    """Write points with a deterministic key, anew or those that the sink lacks, and give the sink's number of points.

    Raises if that is less than the number of distinct keys that were given.
    """
    spark = df.sparkSession
    if recreate:
        df.dropDuplicates([key]).write.mode("overwrite").parquet(path)
    else:
        append_new(df, path, key)
    n, asked = spark.read.parquet(path).count(), df.select(key).distinct().count()
    if n < asked:
        raise ValueError(f"the sink holds {n} points of at least {asked}")
    return n


def embedded_json(html: Column, name: str, schema: str) -> Column:
    """The array assigned to a script variable, as structs; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(html, rf"(?s)var\s+{name}\s*=\s*(\[.*?\])\s*;", 1), F.lit("")), schema)


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, href, text) of each anchor of a page."""
    pattern = r'(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("pos", "a"))
    return found.select(key, "pos", F.regexp_extract("a", pattern, 1).alias("href"), F.trim(F.regexp_replace(F.regexp_extract("a", pattern, 2), "<[^>]*>", "")).alias("text"))


def sitemap(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(url, title) of the locations of sitemaps whose title is about housing."""
    urls = xml.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()
    return urls.withColumn("title", title_of_url(F.col("url"))).filter(about_housing(F.col("title")))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not in the sink yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Idempotent append of rows whose key the Parquet sink lacks."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(key)
    except Exception as error:  # only a sink that is not there yet counts as empty
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        have = None
    (df if have is None else resume(df, have, key)).dropDuplicates([key]).write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name, content) as files of these names, through the file system that the folder belongs to."""
    import pyarrow.fs as pfs

    url = folder if "://" in folder else f"file://{folder}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pfs.FileSystem.from_uri(url)
        fs.create_dir(root, recursive=True)
        for f in frames:
            for name, content in zip(f["name"], f["content"], strict=True):
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield f[["name"]]

    files.select("name", "content").mapInPandas(run, "name string").count()


def content_kind(content_type: Column, url: Column, body: Column, least: int = 1024) -> Column:
    """How a download is kept: pdf, follow (a page that links a PDF), html, or fail."""
    pdf = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("pdf")) | F.lower(url).endswith(".pdf")
    follow = F.coalesce(body, F.lit("")).rlike(r'(?i)href\s*=\s*"[^"]*\.pdf')
    return F.when(pdf, "pdf").when(follow, "follow").when(F.octet_length(F.coalesce(body, F.lit(""))) >= least, "html").otherwise("fail")
