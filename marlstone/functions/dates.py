"""Column functions over dates and reporting periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import MONTHS

# The day of the announced reform and what is said of figures from that day on.
BREAK_DAY = "2026-05-12"
BREAK_NOTE = (
    "structural break: this figure is dated on or after the 12 May 2026 negative-gearing / CGT reform announcement, "
    "so investor-driven lending, price, and rental series may not be comparable across that date — do not extrapolate a trend through it"
)


def month_end(day: Column) -> Column:
    return F.last_day(day)


def quarter_end(day: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def period_end(period: Column, today: Column) -> Column:
    """'latest', a year, a month or a day as the last day it covers; null for anything else."""
    p = F.trim(period)
    return (
        F.when(F.lower(p) == "latest", today)
        .when(p.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(p, F.lit("yyyy-MM-dd")).cast("date"))
        .when(p.rlike(r"^\d{4}-\d{2}$"), F.last_day(F.try_to_timestamp(F.concat(p, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")))
        .when(p.rlike(r"^\d{4}$"), F.make_date(p.cast("int"), F.lit(12), F.lit(31)))
    )


def date_prefix(text: Column) -> Column:
    """A free-form date as 'YYYY-MM', 'YYYY-00' or 'unknown'."""
    t = F.trim(F.coalesce(text, F.lit("")))
    dashed, named, year = r"^(\d{4})-(\d{1,2})", r"([A-Za-z]{3,})\s+(\d{4})", r"\b((?:19|20)\d{2})\b"
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(F.substring(F.regexp_extract(t, named, 1), 1, 3)))
    return (
        F.when(t.rlike(dashed), F.concat(F.regexp_extract(t, dashed, 1), F.lit("-"), F.lpad(F.regexp_extract(t, dashed, 2).cast("int").cast("string"), 2, "0")))
        .when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-00")))
        .when(t.rlike(named) & (month > 0), F.concat(F.regexp_extract(t, named, 2), F.lit("-"), F.lpad(month.cast("string"), 2, "0")))
        .when(t.rlike(year), F.concat(F.regexp_extract(t, year, 1), F.lit("-00")))
        .otherwise("unknown")
    )


def loose_date(text: Column) -> Column:
    """The first of four published formats that fits, or null."""
    t = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("dd-MMM-yy", "dd-MMM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd")))


def break_note(citation: Column, as_of: Column) -> Column:
    """The citation with the note, once, for days from the announcement on."""
    late = as_of >= F.lit(BREAK_DAY).cast("date")
    return F.when(late & ~F.contains(citation, F.lit("structural break")), F.concat(citation, F.lit(f" [{BREAK_NOTE}]"))).otherwise(citation)
