"""Closed-form finance as column functions over doubles.  Domain errors give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bound, duty below the bracket, rate within it.
DUTY = [(17000.0, 0.0, 0.0125), (36000.0, 212.5, 0.015), (97000.0, 497.5, 0.0175), (364000.0, 1565.0, 0.035), (1212000.0, 10910.0, 0.045), (3636000.0, 49070.0, 0.055), (None, 182390.0, 0.07)]
EXEMPT, TAPERED = 800000.0, 1000000.0
CACHE_WRITE, CACHE_READ = 1.25, 0.10


def cents(x: Column, places: int = 2) -> Column:
    """Half up on the double itself, which every engine computes alike."""
    k = float(10**places)
    return F.floor(x * k + 0.5) / k


def half_away(x: Column, places: int = 6) -> Column:
    """The double times a power of ten to the nearest whole number, halves away from zero: DuckDB's ``round``, where Spark's goes by the printed decimals."""
    k = float(10**places)
    return F.round(x * k) / k


def rental_yield(rent: Column, value: Column) -> Column:
    return F.when((rent >= 0) & (value > 0), cents(rent / value * 100))


def repayment(principal: Column, rate_percent: Column, years: Column, per_year: Column) -> Column:
    """The payment each period of an annuity, unrounded."""
    n, r = F.floor(years * per_year + 0.5), rate_percent / 100 / per_year
    level = F.when(r == 0, principal / n).otherwise(principal * r / (1 - F.pow(1 + r, -n)))
    return F.when((principal > 0) & (rate_percent >= 0) & (years > 0), level)


def duty(price: Column) -> Column:
    out, lower = None, 0.0
    for upper, base, rate in DUTY:
        value = base + (price - lower) * rate
        if out is None:
            out = F.when(price <= upper, value)
        elif upper is None:
            out = out.otherwise(value)
        else:
            out = out.when(price <= upper, value)
        lower = upper
    return F.when(price > 0, cents(out))


def first_buyer_duty(price: Column) -> Column:
    full = duty(price)
    return F.when(price <= EXEMPT, F.when(price > 0, 0.0)).when(price < TAPERED, cents(full * ((price - EXEMPT) / (TAPERED - EXEMPT)))).otherwise(full)


def usage_cost(tokens_in: Column, tokens_out: Column, read: Column, write: Column, rate_in: Column, rate_out: Column) -> Column:
    """Dollars for four meters at dollars a million; absent meters and unknown rates count 0."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return (z(tokens_in) * z(rate_in) + z(tokens_out) * z(rate_out) + z(read) * z(rate_in) * CACHE_READ + z(write) * z(rate_in) * CACHE_WRITE) / 1e6


def fresh_input(prompt: Column, cached: Column) -> Column:
    """Prompt tokens that were not read from a cache."""
    return F.greatest(F.lit(0), F.coalesce(prompt, F.lit(0)) - F.coalesce(cached, F.lit(0)))
