"""Literal cases of the column functions."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates, keys, money, rules
from marlstone.functions import text as X


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("price", "full", "first"),
    [(1_500_000, 64910.0, 64910.0), (800_000, 30530.0, 0.0), (850_000, 32780.0, 8195.0), (900_000, 35030.0, 17515.0), (1_000_000, 39530.0, 39530.0), (0, None, None), (-1, None, None)],
)
def test_duty(spark, price, full, first):
    p = F.lit(float(price))
    assert one(spark, money.duty(p)) == full
    assert one(spark, money.first_buyer_duty(p)) == first


def test_finance(spark):
    assert one(spark, money.rental_yield(F.lit(36400.0), F.lit(950000.0))) == 3.83
    assert one(spark, money.rental_yield(F.lit(36400.0), F.lit(0.0))) is None
    assert one(spark, money.cents(money.repayment(F.lit(800000.0), F.lit(6.05), F.lit(30.0), F.lit(12)))) == 4822.15
    assert one(spark, money.cents(money.repayment(F.lit(700000.0), F.lit(0.0), F.lit(30.0), F.lit(12)))) == 1944.44
    cost = money.usage_cost(F.lit(512), F.lit(128), F.lit(None).cast("int"), F.lit(2048), F.lit(1.0), F.lit(5.0))
    assert one(spark, F.round(cost, 6)) == 0.003712
    assert one(spark, money.usage_cost(F.lit(5), F.lit(5), F.lit(5), F.lit(5), F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0


@pytest.mark.parametrize(("period", "end"), [("2024", "2024-12-31"), ("2024-02", "2024-02-29"), ("2024-02-10", "2024-02-10"), ("latest", "2026-01-02"), ("x", None), (None, None)])
def test_period(spark, period, end):
    got = one(spark, dates.period_end(F.lit(period), F.lit("2026-01-02").cast("date")))
    assert got == (end and dt.date.fromisoformat(end))


@pytest.mark.parametrize(("text", "prefix"), [("2024", "2024-00"), ("2024-3-1", "2024-03"), ("12 March 2024", "2024-03"), ("2024-oct", "2024-00"), ("n/a", "unknown"), (None, "unknown"), ("", "unknown")])
def test_date_prefix(spark, text, prefix):
    assert one(spark, dates.date_prefix(F.lit(text).cast("string"))) == prefix


def test_break_note_once(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.break_note(F.lit("c"), day("2026-05-11"))) == "c"
    once = one(spark, dates.break_note(F.lit("c"), day("2026-05-12")))
    assert once.startswith("c [structural break")
    assert one(spark, dates.break_note(F.lit(once), day("2026-05-12"))) == once


def test_text(spark):
    assert one(spark, X.slug(F.lit("Foo  Bar_baz!"))) == "foo-bar-baz"
    assert one(spark, X.terms(F.lit("The Housing Été of 2 banks"))) == ["t", "2", "banks"]
    assert one(spark, X.terms(F.lit(None).cast("string"))) == []
    marks = "[tool: t, retrieved: d] x [source: P] y [source: P]"
    assert one(spark, X.citations(F.lit(marks))) == ["tool|t|d", "source|P|"]
    assert one(spark, X.short_title(F.lit("a" * 90))) == "a" * 79 + "…"
    assert one(spark, X.greedy_json(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'


def test_keys(spark):
    assert one(spark, keys.uuid5(F.lit("a/b__0001"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/b__0001")) == "ae05ea87-d3c0-5024-9a1a-5878e585daf1"
    assert one(spark, keys.document_of_chunk(F.lit("p/s__0012"))) == "p/s"
    assert one(spark, keys.target_stem(F.lit(""), F.lit("2024-05"), F.lit("!!"))) == "unknown/2024-05_untitled"


@pytest.mark.parametrize(
    ("query", "action", "category"),
    [("best home loan for me", "refuse", "mortgage_product"), ("how does negative gearing work", "annotate", "temporal_currency"), ("capital growth", "allow", None), ("", "allow", None), (None, "allow", None), ("should I refinance my CGT", "refuse", "mortgage_product")],
)
def test_screen(spark, query, action, category):
    a, c = rules.screen(F.lit(query).cast("string"))
    assert (one(spark, a), one(spark, c)) == (action, category)


def test_noise(spark):
    n = lambda t, s, x: one(spark, rules.is_noise(F.lit(t), F.lit(s), F.lit(x)))
    assert n("Download", "", "x") and n("", "Appendix 3", "x") and n("", "", "**==> picture")
    assert not n("Report", "Method", "text")
