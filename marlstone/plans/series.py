"""Queries over published series: periods, as-of look-ups, finance, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import dates, money
from marlstone.operators import series
from marlstone.plans.registry import query
from marlstone.sources.tables import table

MONTHLY = "m AS (SELECT o_orderpriority AS series, last_day(o_orderdate::DATE) AS period_end, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"


def monthly(spark, sf_dir):
    """A published series for each order priority: totals by month end."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), dates.month_end(F.col("o_orderdate").cast("date")).alias("period_end"), "o_totalprice")
    return o.groupBy("series", "period_end").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("series_monthly", f"WITH {MONTHLY} SELECT series, period_end, round(value, 0) AS value FROM m")
def series_monthly(spark, sf_dir):
    return monthly(spark, sf_dir).withColumn("value", F.round("value", 0))


@query("asof_latest_value", f"WITH {MONTHLY} SELECT series, max(period_end) AS period_end, round(arg_max(value, period_end), 0) AS value FROM m WHERE period_end <= DATE '1998-02-15' GROUP BY series")
def asof_latest_value(spark, sf_dir):
    return series.as_of_date(monthly(spark, sf_dir), "series", F.lit("1998-02-15").cast("date")).withColumn("value", F.round("value", 0))


@query(
    "asof_many",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY user_id, ts)
SELECT l.event_id, r.event_id AS last_event FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_many(spark, sf_dir):
    """For each click or view of a user, the last other event up to then."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    asked = F.col("event_type").isin("click", "view")
    left = e.filter(asked).select("event_id", "user_id", "ts")
    right = e.filter(~asked).groupBy("user_id", "ts").agg(F.max("event_id").alias("last_event"))
    return series.as_of_join(left, right, "user_id", "ts", ["event_id"], ["last_event"])


PERIODS = ["latest", "2024", "2024-02", "2024-02-10", "x", "1996-11"]
PERIOD_SQL = """CASE WHEN p = 'latest' THEN DATE '2026-05-31' WHEN regexp_full_match(p, '\\d{4}-\\d{2}-\\d{2}') THEN p::DATE
 WHEN regexp_full_match(p, '\\d{4}-\\d{2}') THEN last_day((p || '-01')::DATE) WHEN regexp_full_match(p, '\\d{4}') THEN make_date(p::INTEGER, 12, 31) END"""


@query("period_resolve", f"WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'latest' END AS p FROM orders) SELECT o_orderkey, p AS period, {PERIOD_SQL} AS period_end FROM o")
def period_resolve(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    p = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("latest")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("period"), dates.period_end(p, F.lit("2026-05-31").cast("date")).alias("period_end"))


@query("month_quarter_end", "SELECT o_orderkey, last_day(o_orderdate::DATE) AS month_end, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS quarter_end FROM orders")
def month_quarter_end(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.month_end(d).alias("month_end"), dates.quarter_end(d).alias("quarter_end"))


@query(
    "series_unpivot",
    """WITH w AS (SELECT last_day(o_orderdate::DATE) AS period_end, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT period_end, 'F' AS series, f::BIGINT AS value FROM w WHERE f > 0 UNION ALL SELECT period_end, 'O', o::BIGINT FROM w WHERE o > 0 UNION ALL SELECT period_end, 'P', p::BIGINT FROM w WHERE p > 0""",
)
def series_unpivot(spark, sf_dir):
    """A wide table of counts by month as rows; absent figures are absent, not zero."""
    wide = table(spark, sf_dir, "orders").groupBy(dates.month_end(F.col("o_orderdate").cast("date")).alias("period_end")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.unpivot("period_end", ["F", "O", "P"], "series", "value").filter("value IS NOT NULL")


@query(
    "structural_break",
    f"""WITH e AS (SELECT o_orderkey, (o_orderdate::DATE + 10000)::DATE AS as_of FROM orders)
SELECT o_orderkey, as_of, CASE WHEN as_of >= DATE '{dates.BREAK_DAY}' THEN 'source [{dates.BREAK_NOTE}]' ELSE 'source' END AS citation FROM e""",
)
def structural_break(spark, sf_dir):
    as_of = F.date_add(F.col("o_orderdate").cast("date"), 10000)
    once = dates.break_note(F.lit("source"), as_of)
    return table(spark, sf_dir, "orders").select("o_orderkey", as_of.alias("as_of"), dates.break_note(once, as_of).alias("citation"))


CENTS = "floor(({}) * 100 + 0.5) / 100"


@query("rental_yield", f"SELECT l_orderkey, l_linenumber, {CENTS.format('(l_quantity * 52) / l_extendedprice * 100')} AS rental_yield FROM lineitem")
def rental_yield(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money.rental_yield(F.col("l_quantity") * 52, F.col("l_extendedprice")).alias("rental_yield"))


@query(
    "mortgage_repayment",
    f"""WITH x AS (SELECT o_orderkey, o_totalprice AS p, 6.05::DOUBLE / 100 / 12 AS r FROM orders), y AS (SELECT o_orderkey, p, p * r / (1 - pow(1 + r, -360)) AS a FROM x)
SELECT o_orderkey, {CENTS.format('a')} AS repayment, {CENTS.format('a * 360')} AS total, {CENTS.format('a * 360 - p')} AS interest FROM y""",
)
def mortgage_repayment(spark, sf_dir):
    p = F.col("o_totalprice")
    a = money.repayment(p, F.lit(6.05), F.lit(30.0), F.lit(12))
    return table(spark, sf_dir, "orders").select("o_orderkey", money.cents(a).alias("repayment"), money.cents(a * 360).alias("total"), money.cents(a * 360 - p).alias("interest"))


def duty_sql(p: str) -> str:
    parts, lower = [], 0.0
    for upper, base, rate in money.DUTY:
        value = CENTS.format(f"{base}::DOUBLE + ({p} - {lower}::DOUBLE) * {rate}::DOUBLE")
        parts.append(f"WHEN {p} <= {upper} THEN {value}" if upper else f"ELSE {value}")
        lower = upper
    return "CASE " + " ".join(parts) + " END"


@query("stamp_duty", f"SELECT o_orderkey, {duty_sql('p')} AS duty FROM (SELECT o_orderkey, o_totalprice * 5 AS p FROM orders)")
def stamp_duty(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", money.duty(F.col("o_totalprice") * 5).alias("duty"))


@query(
    "stamp_duty_fhb",
    f"SELECT o_orderkey, CASE WHEN p <= 800000 THEN 0.0::DOUBLE WHEN p < 1000000 THEN {CENTS.format('(' + duty_sql('p') + ') * ((p - 800000::DOUBLE) / 200000::DOUBLE)')} ELSE {duty_sql('p')} END AS duty FROM (SELECT o_orderkey, o_totalprice * 5 AS p FROM orders)",
)
def stamp_duty_fhb(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", money.first_buyer_duty(F.col("o_totalprice") * 5).alias("duty"))


RATES = [("small", 1.0, 5.0), ("large", 3.0, 15.0)]


@query(
    "llm_cost_rollup",
    """WITH u AS (SELECT l_returnflag AS node, CASE l_linestatus WHEN 'O' THEN 'small' WHEN 'F' THEN 'large' END AS model, (l_orderkey % 5000)::DOUBLE AS i, (l_partkey % 900)::DOUBLE AS o, (l_suppkey % 700)::DOUBLE AS r, (l_linenumber * 10)::DOUBLE AS w FROM lineitem),
c AS (SELECT node, i, o, (i * rin + o * rout + r * rin * 0.1::DOUBLE + w * rin * 1.25::DOUBLE) / 1e6 AS usd FROM u JOIN (VALUES ('small', 1.0::DOUBLE, 5.0::DOUBLE), ('large', 3.0::DOUBLE, 15.0::DOUBLE)) p(model, rin, rout) USING (model))
SELECT coalesce(node, 'all') AS node, count(*)::BIGINT AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(usd), 4) AS usd FROM c GROUP BY ROLLUP (node)""",
)
def llm_cost_rollup(spark, sf_dir):
    """Token and dollar totals by node and over all."""
    u = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("node"), F.when(F.col("l_linestatus") == "O", "small").otherwise("large").alias("model"), (F.col("l_orderkey") % 5000).alias("i"), (F.col("l_partkey") % 900).alias("o"), (F.col("l_suppkey") % 700).alias("r"), (F.col("l_linenumber") * 10).alias("w")
    )
    rates = spark.createDataFrame(RATES, "model string, rate_in double, rate_out double")
    c = u.join(F.broadcast(rates), "model", "left").withColumn("usd", money.usage_cost(*(F.col(x) for x in ("i", "o", "r", "w", "rate_in", "rate_out"))))
    out = c.rollup("node").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.round(F.sum("usd"), 4).alias("usd"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("node")).alias("node"), "calls", "input_tokens", "output_tokens", "usd")


@query("cost_projection", "SELECT count(*)::BIGINT AS n, (sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) + 460))::BIGINT AS input_tokens, (count(*) * 150)::BIGINT AS output_tokens, round((sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) + 460) * 1.0::DOUBLE + count(*) * 150 * 5.0::DOUBLE) / 1e6, 6) AS usd FROM documents")
def cost_projection(spark, sf_dir):
    """What a generation run over all documents would cost: a 400-token system prompt and 60 of frame each, 150 out."""
    n = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != ""))
    t = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.sum(n + 460).alias("input_tokens"))
    out = t.withColumn("output_tokens", F.col("n") * 150)
    return out.withColumn("usd", F.round((F.col("input_tokens") * 1.0 + F.col("output_tokens") * 5.0) / 1e6, 6))


@query("thousands_to_units", "SELECT l_orderkey, l_linenumber, floor(l_discount * 1000 + 0.5)::BIGINT AS units, floor(l_tax * 100 * 100 + 0.5) / 100 AS percent FROM lineitem")
def thousands_to_units(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_discount") * 1000 + 0.5).alias("units"), money.cents(F.col("l_tax") * 100).alias("percent"))


@query("fresh_input_tokens", "SELECT event_type, sum(greatest(0, event_id % 900 - event_id % 400))::BIGINT AS fresh FROM events GROUP BY event_type")
def fresh_input_tokens(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(money.fresh_input(F.col("event_id") % 900, F.col("event_id") % 400)).alias("fresh"))


@query(
    "chart_payload",
    f"""WITH {MONTHLY}, x AS (SELECT DISTINCT period_end FROM m), s AS (SELECT DISTINCT series FROM m)
SELECT period_end, series, round(value, 0) AS value, (SELECT count(*) FROM x)::BIGINT AS n_points FROM x CROSS JOIN s LEFT JOIN m USING (period_end, series)""",
)
def chart_payload(spark, sf_dir):
    """Every series on the union of all dates; what a series lacks is a gap."""
    return series.aligned(monthly(spark, sf_dir)).withColumn("value", F.round("value", 0))


@query("series_envelope", f"WITH {MONTHLY}, a AS (SELECT series, max(period_end) AS as_of, arg_max(value, period_end) AS value FROM m WHERE period_end <= DATE '2001-12-31' GROUP BY series) SELECT series, '2001' AS queried_period, DATE '2001-12-31' AS resolved_date, as_of, round(value, 0) AS value, 'orders, ' || as_of AS citation FROM a")
def series_envelope(spark, sf_dir):
    """Resolve a period, look the series up as of its end, and cite it."""
    out = series.envelope(monthly(spark, sf_dir), "series", "2001", F.lit("2026-05-31").cast("date"), "orders")
    return out.withColumn("value", F.round("value", 0))


@query("tag_projection", "SELECT period_end, count(*)::BIGINT AS n_tags, string_agg(series, ',' ORDER BY series) AS tags FROM (SELECT last_day(o_orderdate::DATE) AS period_end, o_orderstatus AS series FROM orders GROUP BY ALL) GROUP BY period_end")
def tag_projection(spark, sf_dir):
    """The tags that a month has, as a map's keys."""
    o = table(spark, sf_dir, "orders").groupBy(dates.month_end(F.col("o_orderdate").cast("date")).alias("period_end"), F.col("o_orderstatus").alias("series")).agg(F.count(F.lit(1)).alias("n"))
    m = o.groupBy("period_end").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("series", "n")))).alias("m"))
    return m.select("period_end", F.size("m").cast("long").alias("n_tags"), F.array_join(F.map_keys("m"), ",").alias("tags"))
