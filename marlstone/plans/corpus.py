"""Queries of corpus preparation: filters, keys, dates, pages, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.functions import dates, keys, rules
from marlstone.functions import text as X
from marlstone.operators import corpus
from marlstone.operators.order import numbered
from marlstone.plans.registry import query
from marlstone.sources import tables
from marlstone.sources.tables import table


@query("scan_filter_project", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200")
def scan_filter_project(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("lang = 'en' AND n_chars >= 200").select("doc_id", "source", "n_chars")


@query("publisher_counts", "SELECT source AS publisher, count(*)::BIGINT AS n FROM documents GROUP BY source")
def publisher_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("publisher")).agg(F.count(F.lit(1)).alias("n"))


@query("status_tally", "SELECT count(*) FILTER (o_orderstatus = 'F')::BIGINT AS ok, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS skipped, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS failed FROM orders")
def status_tally(spark, sf_dir):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf_dir, "orders").agg(n("F").alias("ok"), n("P").alias("skipped"), n("O").alias("failed"))


@query("headline_split", "SELECT coalesce(CASE toxic WHEN 1 THEN 'pre_2026_reform' WHEN 0 THEN 'regime_neutral' END, 'regime_neutral') AS regime, coalesce(toxic, 0) <> 1 AS headline, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def headline_split(spark, sf_dir):
    """Legacy rows are those marked; rows without a mark are neutral."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "pre_2026_reform").when(F.col("toxic") == 0, "").alias("tag")), "doc_id", "left")
    regime = F.coalesce(F.nullif("tag", F.lit("")), F.lit("regime_neutral"))
    return d.groupBy(regime.alias("regime"), (regime != "pre_2026_reform").alias("headline")).agg(F.count(F.lit(1)).alias("n"))


@query("payload_projection", "SELECT doc_id::VARCHAR AS chunk_id, source AS publisher, text, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::BIGINT AS token_count FROM documents")
def payload_projection(spark, sf_dir):
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).cast("long")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("publisher"), "text", n.alias("token_count"))


@query("keyword_filter", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{'|'.join(X.HOUSING)}')")
def keyword_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(X.about_housing(F.col("text"))).select("doc_id")


def _i(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


ACTION = "CASE WHEN trim(q) = '' THEN 'allow' " + " ".join(f"WHEN regexp_matches(q, '{_i(p)}') THEN 'refuse'" for _, p in rules.REFUSED) + f" WHEN regexp_matches(q, '{_i(rules.ANNOTATED)}') THEN 'annotate' ELSE 'allow' END"
CATEGORY = "CASE WHEN trim(q) = '' THEN NULL " + " ".join(f"WHEN regexp_matches(q, '{_i(p)}') THEN '{n}'" for n, p in rules.REFUSED) + f" WHEN regexp_matches(q, '{_i(rules.ANNOTATED)}') THEN 'temporal_currency' END"
OPENINGS = ["which mortgage should I take", "best landlord insurance", "how does negative gearing work", "should I buy shares", "recommend a super fund", "capital growth"]
OPENING_SQL = "[" + ", ".join(f"'{x}'" for x in OPENINGS) + "]"


@query("guardrail_screen", f"WITH x AS (SELECT conv_id, turn, ({OPENING_SQL})[(conv_id + turn) % 6 + 1] || ' ' || text AS q FROM conversations) SELECT conv_id, turn, {ACTION} AS action, {CATEGORY} AS category FROM x")
def guardrail_screen(spark, sf_dir):
    """Each message after one of six openings, so that every rule is met."""
    opening = F.element_at(F.array(*(F.lit(x) for x in OPENINGS)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    action, category = rules.screen(F.concat_ws(" ", opening, "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", action.alias("action"), category.alias("category"))


SECTIONS = ["References", "Appendix 2 tables", "Skip to content", "Method", "RBA—see bank", "Download"]
SECTION_SQL = "[" + ", ".join(f"'{x}'" for x in SECTIONS) + "]"


@query("noise_filter", f"WITH x AS (SELECT doc_id, ({SECTION_SQL})[doc_id % 6 + 1] AS s, trim(text) AS t FROM documents) SELECT doc_id, regexp_matches(s, '{_i(rules.NOISE_TITLE)}') OR regexp_matches(s, '{_i(rules.NOISE_SECTION)}') OR starts_with(t, '**==>') OR starts_with(t, '<!-- image -->') AS noise FROM x")
def noise_filter(spark, sf_dir):
    s = F.element_at(F.array(*(F.lit(x) for x in SECTIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.is_noise(s, s, F.col("text")).alias("noise"))


@query("substantive_filter", f"WITH x AS (SELECT doc_id, ({SECTION_SQL})[doc_id % 6 + 1] AS s, text FROM documents) SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}+')))::BIGINT AS words, text <> '' AND NOT regexp_matches(s, '{_i(rules.THIN_SECTION)}') AND len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}+'))) >= 60 AS substantive FROM x")
def substantive_filter(spark, sf_dir):
    s = F.element_at(F.array(*(F.lit(x) for x in SECTIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.alphabetic_words(F.col("text")).cast("long").alias("words"), rules.is_substantive(F.lit(None), s, F.col("text")).alias("substantive"))


SLUG = "trim(left(regexp_replace(lower(trim(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'))), '[\\s_-]+', '-', 'g'), {}), '-')"


@query("slugify", f"SELECT doc_id, {SLUG.format('text', 80)} AS slug FROM documents")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("date_prefixes", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y-00') ELSE 'unknown' END AS prefix FROM orders")
def date_prefixes(spark, sf_dir):
    """Six ways to write a date, one for each remainder of the key."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-M-d")).when(k == 2, F.date_format(d, "d MMMM yyyy")).when(k == 3, F.date_format(d, "yyyy-MM")).when(k == 4, F.concat(F.lit("in "), F.date_format(d, "yyyy"))).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_prefix(t).alias("prefix"))


@query("unique_stems", "WITH s AS (SELECT page_id, url, 'host/' || split_part(split_part(url, '//', 2), '/', 1) AS stem FROM pages) SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN stem || '_' || left(md5(url), 8) ELSE stem END AS stem FROM s")
def unique_stems(spark, sf_dir):
    """Stems that several addresses share get a piece of the address's digest; counted first, then joined."""
    s = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("host/"), F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))).alias("stem"))
    n = s.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "stem").select("page_id", keys.unique_stem(F.col("stem"), F.col("url"), F.col("n")).alias("stem"))


@query("stem_collisions", "SELECT stem, count(*)::BIGINT AS n FROM (SELECT split_part(split_part(url, '//', 2), '/', 1) AS stem FROM pages) GROUP BY stem HAVING count(*) > 1")
def stem_collisions(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("stem")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("url_predicates", "WITH u AS (SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host, regexp_extract(url, '^[^:]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT page_id, host, path, ends_with(path, '.html') AS is_html, starts_with(path, '/en/') AS is_en, len(list_filter(string_split(path, '/'), lambda s: s <> ''))::BIGINT AS segments FROM u")
def url_predicates(spark, sf_dir):
    p = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), p.alias("path"), p.endswith(".html").alias("is_html"), p.startswith("/en/").alias("is_en"), F.size(F.filter(F.split(p, "/"), lambda s: s != "")).cast("long").alias("segments"))


UUID = "left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("uuid5_ids", f"WITH x AS (SELECT doc_id, sha1(unhex('{keys.URL_SPACE}') || (source || '/' || doc_id::VARCHAR)::BLOB) AS h FROM documents) SELECT doc_id, {UUID} AS id FROM x")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.uuid5(F.concat_ws("/", "source", F.col("doc_id").cast("string"))).alias("id"))


@query("chunk_keys", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) SELECT doc_id, source || '/stem__' || lpad(i::VARCHAR, 4, '0') AS chunk_id, source || '/stem' AS document FROM r")
def chunk_keys(spark, sf_dir):
    d = numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    d = d.select("doc_id", keys.chunk_id(F.col("source"), F.lit("stem"), F.col("place")).alias("chunk_id"))
    return d.withColumn("document", keys.document_of_chunk(F.col("chunk_id")))


@query("target_stems", f"SELECT doc_id, source || '/' || 'unknown_' || coalesce(nullif({SLUG.format('text', 80)}, ''), 'untitled') AS stem FROM documents")
def target_stems(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.target_stem(F.col("source"), F.lit(None), F.col("text")).alias("stem"))


@query("call_keys", "SELECT event_id, event_type || '::' || '{\"k\":\"' || (props::JSON->>'k') || '\",\"u\":\"' || user_id || '\"}' AS key FROM events")
def call_keys(spark, sf_dir):
    args = F.create_map(F.lit("u"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", keys.call_key(F.col("event_type"), args).alias("key"))


@query("embedding_cache_keys", "SELECT item_id, sha256('m|q: |' || text) AS key FROM benchmark")
def embedding_cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", keys.vector_key(F.lit("m"), F.lit("q: "), F.col("text")).alias("key"))


@query("snippets", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 160) AS snippet, CASE WHEN length(text) <= 320 THEN text ELSE regexp_replace(left(text, 320), '\s+$', '') || '…' END AS excerpt, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END AS title FROM documents")
def snippets(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(t).alias("snippet"), X.excerpt(t).alias("excerpt"), X.short_title(t).alias("title"))


@query("content_decision", r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pdf' WHEN regexp_matches(html, '(?i)href\s*=\s*"[^"]*\.pdf') THEN 'follow' WHEN strlen(html) >= 1024 THEN 'html' ELSE 'fail' END AS kind FROM pages""")
def content_decision(spark, sf_dir):
    kind = F.when(F.col("page_id") % 5 == 0, "application/PDF").otherwise("text/html")
    return table(spark, sf_dir, "pages").select("page_id", tables.content_kind(kind, F.col("url"), F.col("html")).alias("kind"))


@query("link_extraction", r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>')) AS a, unnest(range(0, len(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*"[^"]*"[^>]*>.*?</a>')))) AS pos FROM pages)
SELECT page_id, pos::INTEGER AS pos, regexp_extract(a, '(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a, '(?is)<a\b[^>]*?href\s*=\s*"[^"]*"[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g')) AS text FROM a""")
def link_extraction(spark, sf_dir):
    return tables.links(table(spark, sf_dir, "pages"), "page_id")


@query("html_to_markdown")
def html_to_markdown(spark, sf_dir):
    return corpus.html_to_markdown(tables.spread(table(spark, sf_dir, "pages")), "page_id", "html")


@query("chunk_pack")
def chunk_pack(spark, sf_dir):
    """Pages as Markdown, packed into chunks of 500 to 800 byte-pair tokens with an overlap of 100."""
    import public_tokenizers as P

    md = corpus.html_to_markdown(tables.spread(table(spark, sf_dir, "pages")), "page_id", "html")
    return corpus.pack(md, "page_id", "markdown", least=500, most=800, overlap=100, codec=corpus.bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


@query("heading_stack", """WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS x FROM documents),
p AS (SELECT doc_id, 0 AS k, source AS heading, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS paragraph FROM t UNION ALL SELECT doc_id, 1, source || ' > ' || lang, 'middle of ' || doc_id FROM t UNION ALL SELECT doc_id, 2, source || ' > Tail end', 'first' || chr(10) || 'second' FROM t UNION ALL SELECT doc_id, 3, source || ' > Tail end', 'last' FROM t)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS pos, heading, paragraph FROM p WHERE paragraph <> ''""")
def heading_stack(spark, sf_dir):
    """Paragraphs with the headings above them: each document below its source, then a section of its language, which a higher one closes."""
    md = F.concat(F.lit("# "), "source", F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n### *"), "lang", F.lit("*\n\nmiddle of "), F.col("doc_id").cast("string"), F.lit("\n## `Tail` end  \nfirst\nsecond\n \nlast"))
    return corpus.paragraphs(table(spark, sf_dir, "documents").select("doc_id", md.alias("markdown")), "doc_id", "markdown")


@query("stem_join", "SELECT p.page_id, d.doc_id FROM (SELECT page_id, page_id % 500 AS stem FROM pages) p LEFT JOIN (SELECT doc_id, doc_id % 500 AS stem, row_number() OVER (PARTITION BY doc_id % 500 ORDER BY doc_id DESC) AS n FROM documents) d ON d.stem = p.stem AND n = 1")
def stem_join(spark, sf_dir):
    """Pages with their source by stem; of several sources of a stem the last wins; pages without one are kept and null."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 500).alias("stem"))
    d = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 500).alias("stem")).agg(F.max("doc_id").alias("doc_id"))
    return p.join(d, "stem", "left").select("page_id", "doc_id")


@query("payload_lookup", "SELECT e.vec_id, d.source, length(d.text)::BIGINT AS n FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def payload_lookup(spark, sf_dir):
    from marlstone.operators.mining import checked_lookup

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.length("text").cast("long").alias("n"))
    have = table(spark, sf_dir, "embeddings").select("vec_id").join(d.select("vec_id"), "vec_id", "left_semi")
    return checked_lookup(have, d, "vec_id")


@query("new_urls_per_page", "WITH f AS (SELECT split_part(split_part(url, '//', 2), '/', 1) AS host, min(page_id // 25) AS first FROM pages GROUP BY 1), b AS (SELECT DISTINCT page_id // 25 AS batch FROM pages) SELECT batch, count(host)::BIGINT AS n_new, count(host) < 2 AS stop FROM b LEFT JOIN f ON f.first = b.batch GROUP BY batch")
def new_urls_per_page(spark, sf_dir):
    """Hosts first seen in each batch of 25 pages, and whether a crawl would stop there."""
    p = table(spark, sf_dir, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host"), F.floor(F.col("page_id") / 25).alias("batch"))
    first = p.groupBy("host").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("k"))
    n = F.coalesce("k", F.lit(0))
    return p.select("batch").distinct().join(first, "batch", "left").select("batch", n.alias("n_new"), (n < 2).alias("stop"))


@query("embedded_json", "SELECT page_id, 2020 AS year, (page_id % 12 + 1)::INTEGER AS month, 5 AS listings FROM pages")
def embedded_json(spark, sf_dir):
    """The rows of a script variable of each page, as structs (the pages' scripts hold none: a series is built from the id)."""
    html = F.concat(F.col("html"), F.lit('<script>var data=[{"year":2020,"month":'), (F.col("page_id") % 12 + 1).cast("string"), F.lit(',"listings":5},{"year":"x"}];</script>'))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(tables.embedded_json(html, "data", "array<struct<year:string,month:string,listings:string>>")).alias("r"))
    n = lambda c: F.col(f"r.{c}").try_cast("int").alias(c)
    return rows.select("page_id", n("year"), n("month"), n("listings")).filter("year IS NOT NULL AND month IS NOT NULL")


@query("union_first_wins", "WITH u AS (SELECT url, 'a' AS src, page_id, 0 AS p FROM pages WHERE starts_with(url, 'https') UNION ALL SELECT url, 'b', page_id, 1 FROM pages) SELECT url, arg_min(src, p) AS src FROM u GROUP BY url")
def union_first_wins(spark, sf_dir):
    """Two scrapers' rows, distinct by address, the first scraper's where both have it."""
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    u = p.filter(F.startswith("url", F.lit("https"))).select("url", F.lit("a").alias("src"), F.lit(0).alias("p")).unionByName(p.select("url", F.lit("b").alias("src"), F.lit(1).alias("p")))
    return u.groupBy("url").agg(F.min_by("src", "p").alias("src"))
