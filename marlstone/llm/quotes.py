"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that start with '>' marks are quoted, as deep as they have marks; the rest is the message's own.
Neighbouring lines of one level are a passage, whatever their line breaks.  Its words, lower-cased, are hashed
in windows of ``WIDTH``, a shorter passage as a whole; the windows are joined to those of the messages' own words,
the short passages to their whole lines, and each goes to the nearest earlier message of the conversation that
has it.  The message that gave most of the shallowest level that is found is the one replied to.

A conversation is read thread by thread (a thread is called by its first turn), each in the order of its
turns: a reply comes after what it replies to.  ``place`` is a message's number in that order, and
``conversations`` gives the messages so ordered, without what they quote.

Defined results: a null text counts as empty; messages with a null conversation or turn stand alone and have
no place; rows that share both are one message for linking, and each keeps its row; rows that share the text
too share their place; a message replies only to an earlier turn; a quote that no earlier message has links
nothing and is taken out all the same.  Turns are whole numbers.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marlstone.llm import _base as B

MARKS = r"^[ \t]*>[> \t]*"
WIDTH = 5
SPAN = 1024  # turns that are put in order together
PART = 1000  # messages of a row of ``conversations``


def level(line: Column) -> Column:
    """Marks before the text of a line; 0 if it is not quoted."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def passage(line: Column) -> Column:
    """A line without marks, lower-cased, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), B.SPACE, " "))


def windows(words: Column) -> Column:
    """The distinct digests of an array's windows of WIDTH words; none if it has fewer."""
    at = F.when(F.size(words) >= WIDTH, F.sequence(F.lit(1), F.size(words) - WIDTH + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.md5(F.array_join(F.slice(words, i, WIDTH), " "))))


def _nearest(holders: DataFrame, quoted: DataFrame) -> DataFrame:
    """quoted (conv, turn, level, hash) with origin: the last earlier turn of holders (conv, hash, turn); those of none are left out."""
    blk = F.floor(F.col("turn") / SPAN)
    asked = quoted.select("conv", "hash", "turn").distinct()
    rows = holders.select("conv", "hash", "turn", F.col("turn").alias("has")).unionByName(asked.withColumn("has", F.lit(None).cast("long"))).withColumn("blk", blk)
    near = W.partitionBy("conv", "hash", "blk").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("near", F.max("has").over(near)).filter("has IS NULL").select("conv", "hash", "turn", "blk", "near")
    last = rows.filter("has IS NOT NULL").groupBy("conv", "hash", "blk").agg(F.max("has").alias("last"))
    every = last.unionByName(rows.select("conv", "hash", "blk").distinct().withColumn("last", F.lit(None).cast("long"))).groupBy("conv", "hash", "blk").agg(F.max("last").alias("last"))
    before = every.withColumn("before", F.max("last").over(W.partitionBy("conv", "hash").orderBy("blk").rowsBetween(W.unboundedPreceding, -1))).drop("last")
    origin = inside.join(before, ["conv", "hash", "blk"]).select("conv", "hash", "turn", F.coalesce("near", "before").alias("origin")).filter("origin IS NOT NULL")
    return quoted.join(origin, ["conv", "hash", "turn"])


def _replies(said: DataFrame) -> DataFrame:
    """(conv, turn, reply_to) of the messages whose quotes are found."""
    known = said.filter("conv IS NOT NULL AND turn IS NOT NULL")
    quoting = known.filter(F.col("text").rlike(rf"(?m){MARKS}")).select("conv", "turn", "text_md5", "text").distinct()
    lines = quoting.select("conv", "turn", "text_md5", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select("conv", "turn", "text_md5", "i", level(F.col("line")).alias("level"), passage(F.col("line")).alias("body")).filter("body <> ''")
    message = W.partitionBy("conv", "turn", "text_md5").orderBy("i")
    lines = lines.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(message)).cast("int")).withColumn("run", F.sum("new").over(message))
    runs = lines.filter("level > 0").groupBy("conv", "turn", "text_md5", "run", "level").agg(F.array_sort(F.collect_list(F.struct("i", "body"))).alias("l"))
    words = runs.select("conv", "turn", "level", F.split(F.array_join(F.transform("l", lambda x: x["body"]), " "), " ").alias("w"))
    keys = F.when(F.size("w") >= WIDTH, windows(F.col("w"))).otherwise(F.array(F.md5(F.concat(F.lit("\n"), F.array_join("w", " ")))))
    quoted = B.written(words.select("conv", "turn", "level", F.explode(keys).alias("hash")).distinct(), "quoted")
    wanted = quoted.select("conv", "hash").distinct()
    talked = known.join(B.held(B.written(wanted.select("conv").distinct(), "talked")), "conv", "left_semi")
    own = F.transform(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(MARKS)), lambda x: passage(x))
    own = talked.select("conv", "turn", F.filter(own, lambda x: x != "").alias("lines"))
    short = F.transform(F.filter("lines", lambda x: F.size(F.split(x, " ")) < WIDTH), lambda x: F.md5(F.concat(F.lit("\n"), x)))
    # the words are a column of their own: inside the windows' function they would be split again for each
    own = own.select("conv", "turn", short.alias("short"), F.split(F.array_join("lines", " "), " ").alias("w"))
    held = own.select("conv", "turn", F.explode(F.concat(windows(F.col("w")), "short")).alias("hash"))
    holders = held.join(wanted, ["conv", "hash"], "left_semi").select("conv", "hash", "turn").distinct()
    match = _nearest(holders, quoted).groupBy("conv", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("n"))
    return match.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "origin")).alias("m")).select("conv", "turn", F.col("m.origin").alias("reply_to"))


def numbered(df: DataFrame, by: str, *order: str, name: str = "place") -> DataFrame:
    """Rows with their number from 0 in the order of their group; a group that fills many partitions is numbered by them side by side."""
    rows = B.written(df.repartitionByRange(by, *order).withColumn("part", F.spark_partition_id()), "ordered")
    sizes = rows.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy(by).orderBy("part")) - F.col("n")).drop("n")
    local = rows.withColumn("local", F.row_number().over(W.partitionBy(by, "part").orderBy(*order)) - 1)
    return local.join(before, [by, "part"]).withColumn(name, F.col("before") + F.col("local")).drop("part", "before", "local")


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (conversation, turn, *keep, n_quoted long, reply_to, thread, depth long, place long, clean_text), one for each input row."""
    said = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))
    said = said.withColumn("text_md5", F.md5("text"))
    reply = B.written(_replies(said), "reply")
    # pointer doubling: each round doubles the part of the way to the thread's first message that is known
    way = reply.select("conv", "turn", F.col("reply_to").alias("top"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = way.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("top").alias("top2"), F.col("depth").alias("more"))
        on = (F.col("conv") == F.col("c")) & (F.col("top") == F.col("t"))
        if not way.join(up, on, "left_semi").take(1):
            break
        way = way.join(up, on, "left").select("conv", "turn", F.coalesce("top2", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        way = B.written(way, "way")
    known = reply.join(way, ["conv", "turn"])
    messages = said.filter("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", "text_md5").distinct().join(known, ["conv", "turn"], "left")
    messages = messages.select("conv", "turn", "text_md5", "reply_to", F.coalesce("top", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    placed = numbered(messages, "conv", "thread", "turn", "text_md5").select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("text_md5").alias("h"), "reply_to", "thread", "depth", "place")
    out = said.join(placed, (F.col("conv") == F.col("c")) & (F.col("turn") == F.col("t")) & (F.col("text_md5") == F.col("h")), "left")
    parts = F.split("text", "\n")
    own = F.filter(parts, lambda x: ~x.rlike(MARKS))
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)),
        F.size(F.filter(parts, lambda x: x.rlike(MARKS))).cast("long").alias("n_quoted"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.col("place").cast("long").alias("place"),
        F.regexp_replace(F.array_join(own, "\n"), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("clean_text"),
    )


def conversations(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """Rows (conversation, part, messages array of structs place, thread, depth, turn, role, text) of PART places each, of what ``link_quotes`` gave with the role kept."""
    one = F.struct("place", "thread", "depth", F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col("clean_text").alias("text"))
    rows = linked.filter("place IS NOT NULL").select(F.col(conv_col), F.floor(F.col("place") / PART).alias("part"), one.alias("m"))
    return rows.groupBy(conv_col, "part").agg(F.array_sort(F.collect_set("m")).alias("messages"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(B.table(spark, sf_dir, "conversations"), keep=("role",))


OP9_SQL = r"""
WITH RECURSIVE msg AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
raw AS (SELECT conv_id, turn, md5(text) AS h, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM msg),
ln AS (SELECT conv_id, turn, h, i, length(regexp_replace(regexp_extract(line, '^[ \t]*>[> \t]*'), '[^>]', '', 'g')) AS level,
              trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*>[> \t]*', '')), '[ \t\n\x0B\x0C\r]+', ' ', 'g'), ' ') AS body FROM raw),
fl AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn, h ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM ln WHERE body <> ''),
rn AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn, h ORDER BY i) AS run FROM fl),
pw AS (SELECT conv_id, turn, level, string_split(string_agg(body, ' ' ORDER BY i), ' ') AS w FROM rn WHERE level > 0 GROUP BY conv_id, turn, h, run, level),
q AS (SELECT DISTINCT conv_id, turn, level, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j+4], ' ')) ELSE [chr(10) || array_to_string(w, ' ')] END) AS k FROM pw),
ow AS (SELECT conv_id, turn, string_split(string_agg(body, ' ' ORDER BY i), ' ') AS w FROM rn WHERE level = 0 GROUP BY conv_id, turn, h),
o AS (SELECT DISTINCT conv_id, turn, k FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j+4], ' '))) AS k FROM ow UNION ALL SELECT conv_id, turn, chr(10) || body FROM ln WHERE level = 0 AND body <> '' AND len(string_split(body, ' ')) < 5)),
g AS (SELECT q.conv_id, q.turn, q.level, q.k, max(o.turn) AS origin FROM q JOIN o ON o.conv_id = q.conv_id AND o.k = q.k AND o.turn < q.turn GROUP BY ALL),
m AS (SELECT conv_id, turn, level, origin, count(*) AS n FROM g GROUP BY ALL),
rep AS (SELECT conv_id, turn, origin AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) AS rn FROM m) WHERE rn = 1),
way(conv_id, turn, top, depth) AS (SELECT conv_id, turn, reply_to, 1 FROM rep UNION ALL SELECT way.conv_id, way.turn, rep.reply_to, way.depth + 1 FROM way JOIN rep ON rep.conv_id = way.conv_id AND rep.turn = way.top),
root AS (SELECT conv_id, turn, min(top) AS top, max(depth) AS depth FROM way GROUP BY conv_id, turn),
pl AS (SELECT msg.conv_id, msg.turn, md5(text) AS h, row_number() OVER (PARTITION BY msg.conv_id ORDER BY coalesce(top, msg.turn), msg.turn, md5(text)) - 1 AS place FROM msg LEFT JOIN root ON root.conv_id = msg.conv_id AND root.turn = msg.turn)
SELECT c.conv_id, c.turn, c.role,
       (SELECT count(*) FROM (SELECT unnest(string_split(coalesce(c.text, ''), chr(10))) AS x) WHERE regexp_matches(x, '^[ \t]*>[> \t]*'))::BIGINT AS n_quoted,
       rep.reply_to, coalesce(root.top, c.turn) AS thread, coalesce(root.depth, 0)::BIGINT AS depth, pl.place::BIGINT AS place,
       trim(coalesce((SELECT string_agg(x, chr(10) ORDER BY i) FROM (SELECT unnest(string_split(coalesce(c.text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(c.text, ''), chr(10)), 1) AS i) WHERE NOT regexp_matches(x, '^[ \t]*>[> \t]*')), ''), E' \t\n\x0B\x0C\r') AS clean_text
FROM conversations c LEFT JOIN rep ON rep.conv_id = c.conv_id AND rep.turn = c.turn LEFT JOIN root ON root.conv_id = c.conv_id AND root.turn = c.turn
LEFT JOIN pl ON pl.conv_id = c.conv_id AND pl.turn = c.turn AND pl.h = md5(coalesce(c.text, ''))
"""
